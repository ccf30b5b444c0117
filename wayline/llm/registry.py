"""Queries of the subpackage; each operator module holds its own query and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import (
    bit_planes,
    compression,
    distinct_words,
    langmask,
    licenses,
    line_frequency,
    merkle,
    neighbours,
    packing,
    personal_data,
    setsketch,
    suffix_index,
    variants,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (
    suffix_index, line_frequency, compression, packing, licenses, setsketch, neighbours, langmask, distinct_words, personal_data, variants, bit_planes, merkle,
):
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})

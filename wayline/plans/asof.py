"""As-of and bracketing joins: union both sides, then carry the nearest hit along."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunked import scan

#: A task merges and sorts both sides' rows, forwards and backwards: smaller tasks keep that memory low.
FINER = 4


def bracket(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    chunk: Column,
    *,
    tie: str | None = None,
    before: str = "before",
    after: str | None = None,
) -> DataFrame:
    """Every ``left`` row with the ``right`` row at or before it, and the one after it.

    Both sides carry ``keys`` and ``at``; ``tie`` orders right rows of equal ``at``.
    ``before`` / ``after`` become STRUCT columns of ``values``, NULL when there is none.
    """
    keys = list(keys)
    hit = F.struct(*[F.col(v) for v in values])
    r = right.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_tie"),
        hit.alias("_hit"),
    )
    row = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(0).cast("bigint").alias("_tie"),
        row.alias("_row"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    done = scan(
        both, keys, ["_at", "_side", "_tie"], chunk,
        fill={before: "_hit"},
        fill_back={after: "_hit"} if after else None, finer=FINER,
    )
    extra = [before] + ([after] if after else [])
    return done.filter("_side = 1").select("_row.*", *extra)

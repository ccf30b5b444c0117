"""Run history: numbering, filters, tail and the log lines of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.ids import Interval
from ..plans.chunked import scan
from ..plans.overlap import overlap_join

# Entries shown by default, slack around a run when matching log lines.
TAIL = 15
SLACK_S = 2


def numbered(entries: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Stable 1-based ``number`` over the entries that survived reading."""
    return scan(entries, keys, order, chunk, number="number")


def filtered(
    entries: DataFrame, *, command: str | None = None, source: str | None = None, failed_only: bool = False,
    camera: str | None = None, search: str | None = None, interval: Interval | None = None,
) -> DataFrame:
    """Entries meeting every given condition; numbers stay as they are."""
    out = entries
    if command is not None:
        out = out.filter(F.lower("command") == command.lower())
    if source is not None:
        out = out.filter(F.col("source") == source)
    if failed_only:
        out = out.filter(F.col("status").isin("failed", "interrupted"))
    for word in (camera, search):
        if word is not None:
            out = out.filter(F.contains(F.lower("command_line"), F.lit(word.lower())))
    if interval is not None:
        out = out.filter(interval.contains_stamp(clock.stamp_from_iso("started_at")))
    return out


def tail(entries: DataFrame, keys: Sequence[str], count: int | None = TAIL, chunk_rows: int = 4096) -> DataFrame:
    """The last ``count`` entries of each history, numbers kept.

    Entries before the tail are found from the rank among those left after filtering.
    """
    if count is None:
        return entries
    chunk = F.floor(F.col("number") / chunk_rows).cast("bigint")
    known = scan(
        entries, keys, ["number"], chunk, number="_rank", whole={"_all": (F.count(F.lit(1)), F.sum)}
    )
    return known.filter(F.col("_rank") > F.col("_all") - count).drop("_rank", "_all")


def run_lines(
    entries: DataFrame, records: DataFrame, keys: Sequence[str] = ("stream",), *, zone: str = "UTC",
    width_s: int = 600,
) -> DataFrame:
    """Pairs of run ``number`` and log ``record_no`` of the same command and time.

    Log stamps are local to ``zone``; run starts are UTC texts with an offset.
    """
    utc = clock.from_epoch_us(F.unix_micros(F.col("started_at").cast("timestamp")))
    utc = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    begin = clock.epoch_us(utc) / 1_000_000
    runs = entries.select(
        *keys, "number", F.col("command").alias("source"), (begin - SLACK_S).alias("_a"),
        (begin + F.col("duration_seconds") + SLACK_S).alias("_b"),
    )
    at = clock.epoch_us("ts") / 1_000_000
    lines = records.select(*keys, "record_no", "source", at.alias("_c"))
    met = overlap_join(runs, lines, [*keys, "source"], ("_a", "_b"), ("_c", "_c"), width_s)
    return met.select(*keys, "number", "record_no")

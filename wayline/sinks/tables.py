"""Trip summaries, run history and derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock_text, size_text


def _fixed(value: Column, places: int) -> Column:
    # format_string prints NULL as text
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value, places)))


def _line(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), text)


def trip_info(trips: DataFrame) -> DataFrame:
    """Add ``text``: the short summary of each trip, unknown values left out.

    Reads start_text, end_text, duration_s, the columns of trip statistics,
    start_address, end_address, has_parking and size_bytes.
    """
    lo, hi = F.col("min_altitude_m"), F.col("max_altitude_m")
    lines = F.concat_ws(
        "\n",
        _line("Started", F.col("start_text")),
        _line("Ended", F.col("end_text")),
        _line("Duration", clock_text("duration_s")),
        _line("Distance", F.concat(_fixed(F.col("distance_km"), 2), F.lit(" km"))),
        _line("Average speed", F.concat(_fixed(F.col("average_speed_kmh"), 1), F.lit(" km/h"))),
        _line("Max speed", F.concat(_fixed(F.col("max_speed_kmh"), 1), F.lit(" km/h"))),
        _line("Moving time", clock_text(F.bround("moving_seconds", 0))),
        _line("Idle time", clock_text(F.bround("idle_seconds", 0))),
        _line("Elevation", F.concat(_fixed(lo, 0), F.lit(" m to "), _fixed(hi, 0), F.lit(" m"))),
        _line("Elevation gain", F.concat(_fixed(F.col("elevation_gain_m"), 0), F.lit(" m"))),
        _line("Start location", F.nullif(F.col("start_address"), F.lit(""))),
        _line("End location", F.nullif(F.col("end_address"), F.lit(""))),
        F.when(F.col("has_parking"), F.lit("Includes Parking-mode footage")),
        _line("Total size", size_text("size_bytes", long=True)),
    )
    return trips.withColumn("text", F.concat(lines, F.lit("\n")))


HISTORY_COLUMNS = (
    "command", "command_line", "source", "username", "started_at", "duration_seconds", "status", "params"
)


def append_history(entries: DataFrame, path: str) -> None:
    """Append run entries as JSON lines; NULL fields are written, so every key exists."""
    entries.select(*HISTORY_COLUMNS).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, order: Sequence[str], partitions: Sequence[str] = ("camera_id", "date")) -> None:
    """Parquet by camera and date, sorted inside the files.

    Ranges are drawn over partition columns and order together, so one crowded camera
    day becomes several files written by several tasks.
    """
    by = [*partitions, *order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(*partitions).parquet(path)

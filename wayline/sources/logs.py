"""Readers for run history, job logs and exported trip folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chunked import scan
from ..schemas import HISTORY

# History keys, log header line, trip log title and exported file names.
HISTORY_REQUIRED = (
    "command", "command_line", "source", "username", "started_at", "duration_seconds", "status"
)
HISTORY_OPTIONAL = ("params",)
LOG_HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d{3} \[([^\]]*)\] (.*)$"
TRIP_TITLE = r"^=== \S+ trip log: (.+) ===$"
TRIP_VIDEOS = ("stitch.mp4", "front.mp4", "rear.mp4")
TRIP_FLAGS = {
    "map": "map.mp4", "map_track_up": "map_tu.mp4", "gsensor": "gsensor.mp4", "gpx": "trip.gpx",
    "srt": "trip.srt", "info": "trip_info.txt", "narrative": "trip_summary.txt",
}


def history(lines: DataFrame, text: str = "value") -> DataFrame:
    """History entries of JSON lines; lines with bad JSON or wrong keys are dropped."""
    kept = [c for c in lines.columns if c != text]
    keys = F.array_sort(F.array_distinct(F.json_object_keys(F.trim(text))))
    complete = [sorted(HISTORY_REQUIRED), sorted(HISTORY_REQUIRED + HISTORY_OPTIONAL)]
    good = keys.isin(*[F.array(*[F.lit(k) for k in names]) for names in complete])
    return lines.filter(F.coalesce(good, F.lit(False))).select(*kept, F.from_json(text, HISTORY).alias("_h")).select(
        *kept, "_h.*"
    )


def read_job_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain and gzip log files, one row per file with its month as ``file_order``."""
    month = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2})\.log(?:\.gz)?$", 1)
    return spark.read.text(path, wholetext=True).select(month.alias("file_order"), F.col("value").alias("text"))


def job_log_lines(files: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """Log lines with the record they belong to.

    A header line opens record ``record_no``; every other line continues the record
    before it, across files too. Headers with an impossible date are dropped, as are
    lines before the first header. Nothing is gathered, a record may be any size.
    """
    keys = list(keys)
    body = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    body = F.when(F.element_at(body, -1) == "", F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    lines = files.select(*keys, "file_order", F.posexplode(body).alias("line_no", "line"))
    header = F.col("line").rlike(LOG_HEADER)
    when = F.regexp_extract("line", LOG_HEADER, 1).try_cast("timestamp_ntz")
    lines = lines.withColumns(
        {
            "line_no": F.col("line_no").cast("bigint"),
            "opens": header,
            "_when": F.when(header, when),
        }
    ).filter("NOT opens OR _when IS NOT NULL")
    numbered = scan(
        lines, keys, ["file_order", "line_no"],
        F.struct(F.col("file_order"), F.floor(F.col("line_no") / 65536).alias("part")),
        total={"record_no": F.col("opens").cast("bigint")},
    ).filter("record_no > 0")
    return numbered.select(
        *keys, "record_no", "file_order", "line_no", "opens", F.col("_when").alias("ts"),
        F.when(F.col("opens"), F.regexp_extract("line", LOG_HEADER, 2)).alias("source"),
        F.when(F.col("opens"), F.regexp_extract("line", LOG_HEADER, 3)).otherwise(F.col("line")).alias("message"),
    )


def job_log_records(lines: DataFrame, keys: Sequence[str] = ("stream",)) -> DataFrame:
    """One row per record with its whole message."""
    part = F.struct("file_order", "line_no", "message")
    return lines.groupBy(*keys, "record_no").agg(
        F.max("ts").alias("ts"), F.max("source").alias("source"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(part)), lambda p: p["message"]), "\n"
        ).alias("message"),
    )


def trip_folders(files: DataFrame) -> DataFrame:
    """Exported trips of many roots, one row per folder that holds a trip log.

    ``files`` has root_rank (scan order), camera_id (NULL for the fallback root),
    folder_path (resolved), folder, name and, for the trip log, first_line.
    """
    per_root = files.groupBy("root_rank", "camera_id", "folder_path", "folder").agg(
        F.bool_or(F.col("name") == "trip.log").alias("_trip"),
        F.max(F.when(F.col("name") == "trip.log", F.col("first_line"))).alias("_title"),
        *[F.bool_or(F.col("name") == n).alias(f"_v{i}") for i, n in enumerate(TRIP_VIDEOS)],
        *[F.bool_or(F.col("name") == n).alias(f"has_{k}") for k, n in TRIP_FLAGS.items()],
        F.array_sort(F.collect_set(F.when(F.col("name").rlike(r"^map_zoom_.*\.mp4$"), F.col("name")))).alias("map_zooms"),
    ).filter("_trip")
    title = F.regexp_extract(F.regexp_replace("_title", r"^\s+|\s+$", ""), TRIP_TITLE, 1)
    label = F.when(title != "", title).otherwise(F.col("folder"))
    videos = F.array_compact(F.array(*[F.when(F.col(f"_v{i}"), n) for i, n in enumerate(TRIP_VIDEOS)]))
    trips = per_root.withColumns(
        {
            "label": label,
            "videos": F.array_join(videos, ","),
            "trip_id": F.concat_ws("/", F.col("camera_id").cast("string"), "folder"),
        }
    ).withColumn(
        "prefix",
        F.when(
            F.endswith(F.col("folder"), F.concat(F.lit("_"), "label")) & (F.col("folder") != F.col("label")),
            F.nullif(F.expr("left(folder, length(folder) - length(label) - 1)"), F.lit("")),
        ),
    )
    cols = [
        "trip_id", "label", "prefix", "videos", "map_zooms", *[f"has_{k}" for k in TRIP_FLAGS], "folder"
    ]
    return trips.groupBy("folder_path").agg(
        F.min_by(F.struct(*cols), F.struct("root_rank", "camera_id")).alias("_t")
    ).select("folder_path", "_t.*")


def trip_info_pairs(files: DataFrame, text: str = "text") -> DataFrame:
    """``Label: value`` lines of trip summaries; a line without the mark is all label."""
    from .texts import text_lines

    lines = text_lines(files, text).filter(F.trim("line") != "")
    cut = F.instr("line", ": ")
    kept = [c for c in files.columns if c != text]
    return lines.select(
        *kept, "line_no",
        F.when(cut > 0, F.expr("substring(line, 1, instr(line, ': ') - 1)")).otherwise(F.col("line")).alias("label"),
        F.when(cut > 0, F.expr("substring(line, instr(line, ': ') + 2)")).otherwise(F.lit("")).alias("value"),
    )

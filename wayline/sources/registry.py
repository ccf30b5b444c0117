"""Camera adapters: named reader functions giving the common schemas.

An adapter is a function ``(spark, root) -> Archive``; its frames have the columns of
``wayline.schemas``. Trip rules plug in as Column expressions, see ``operators.trips.Rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, ids
from . import camera_files, catalogue, telemetry_files


@dataclass(frozen=True)
class Archive:
    recordings: DataFrame
    fixes: DataFrame | None = None
    samples: DataFrame | None = None
    snapshots: DataFrame | None = None


Adapter = Callable[[SparkSession, str], Archive]
_ADAPTERS: dict[str, Adapter] = {}


def register(name: str) -> Callable[[Adapter], Adapter]:
    def keep(adapter: Adapter) -> Adapter:
        if name in _ADAPTERS:
            raise ValueError(f"adapter {name!r} exists")
        _ADAPTERS[name] = adapter
        return adapter

    return keep


def adapter(name: str) -> Adapter:
    try:
        return _ADAPTERS[name]
    except KeyError:
        raise ValueError(f"no adapter {name!r}; known: {', '.join(sorted(_ADAPTERS))}") from None


def names() -> tuple[str, ...]:
    return tuple(sorted(_ADAPTERS))


def _camera(df: DataFrame) -> DataFrame:
    """Camera id from the folder holding the files."""
    return df.withColumn("camera_id", F.element_at(F.split("path", "/"), -2))


def timed(recordings: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """What trip detection reads: ``start_s``, ``recording_key``, ``kind``, ``duration_s``, ``timestamp_reliable``.

    The start comes from the recording id. Ids are unique in a camera and in time order, so they are the key
    that settles equal starts.
    """
    out = recordings.withColumns(
        {
            "start_s": clock.epoch_s(ids.start_of("recording_id")), "recording_key": F.col("recording_id"),
            "kind": ids.kind_of("recording_id"),
        }
    )
    if "timestamp_reliable" not in out.columns:
        out = out.withColumn("timestamp_reliable", F.lit(True))
    if durations is None:
        return out.withColumn("duration_s", F.lit(None).cast("bigint"))
    return out.join(durations, ["camera_id", "recording_id"], "left")


def camera_logs(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """Files of ``root/<camera>/`` with an ending, through the data source: filters on names reach its listing."""
    camera_files.register(spark)
    return spark.read.format("camera_files").option("ending", ending).load(root)


def gps_logs(spark: SparkSession, root: str) -> DataFrame:
    """Fixes of all GPS logs below ``root``."""
    files = camera_logs(spark, root, ".gps").select("camera_id", "recording_id", F.col("content").cast("string").alias("text"))
    return telemetry_files.gps_fixes(files)


@register("dashcam")
def dashcam(spark: SparkSession, root: str) -> Archive:
    """``root/<camera>/<recording files>`` with GPS, g-sensor, duration and setting files beside the videos.

    Any of them may be missing everywhere.
    """
    files = _camera(catalogue.list_files(spark, root))

    def raw(ending: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}")
        return _camera(found.load(root))

    telemetry = raw(".gps").select(
        "camera_id", F.regexp_replace(catalogue.file_name("path"), r"\.gps$", "").alias("recording_id"),
        F.col("content").cast("string").alias("text"),
    )
    gsensor = raw(".3gf").select(
        "camera_id", F.regexp_replace(catalogue.file_name("path"), r"\.3gf$", "").alias("recording_id"), "content"
    )
    settings = raw(".record_time.txt").select(
        "camera_id", "path", F.col("content").cast("string").alias("value")
    )
    seconds = F.trim(F.translate(F.col("content").cast("string"), "\r\n", "")).try_cast("double")
    durations = raw(".duration.txt").groupBy("camera_id", ids.recording_id_of(catalogue.file_name("path")).alias("recording_id")).agg(
        F.max(F.round(seconds).cast("bigint")).alias("duration_s")
    )
    return Archive(
        timed(catalogue.catalogue(files), durations), telemetry_files.gps_fixes(telemetry),
        telemetry_files.gsensor_samples(gsensor), catalogue.snapshots(settings),
    )


@register("folder")
def folder(spark: SparkSession, root: str) -> Archive:
    """Any tree of videos and photos, ids given by file time."""
    files = catalogue.list_files(spark, root).withColumn("camera_id", F.lit("folder"))
    kinds = (".mp4", ".mov", ".avi", ".mkv", *catalogue.PHOTO_EXTENSIONS, *catalogue.GIF_EXTENSIONS)
    videos = catalogue.scan_files(files, kinds, [".thumb.jpg"])
    # a copy may have changed the file time, so it is never called reliable
    known = catalogue.resolve_timestamps(
        videos.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("exif_ts", "container_ts", "telemetry_ts")}).withColumn(
            "mtime_ts", F.col("modificationTime").cast("timestamp_ntz")
        )
    ).drop("exif_ts", "container_ts", "telemetry_ts", "mtime_ts")
    return Archive(timed(catalogue.assign_ids(known, "V")))

"""Archive catalogues: file listings to recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, ids
from ..plans.chunked import scan, spread

# Asset of a file name ending, longer endings before the ones they end in.
ASSET_SUFFIXES = (
    ("F.mp4", "FRONT"), ("R.mp4", "REAR"), ("I.mp4", "INTERIOR"), (".gps", "GPS"), (".3gf", "GSENSOR"),
    ("F.thm", "FRONT_THUMBNAIL"), ("R.thm", "REAR_THUMBNAIL"), ("I.thm", "INTERIOR_THUMBNAIL"),
    (".aac", "AUDIO"), (".duration.txt", "DURATION"), (".thumb.jpg", "THUMBNAIL"),
    (".diarized.transcript.txt", "TRANSCRIPT_DIARIZED"),
    (".diarized.translation.txt", "TRANSLATION_DIARIZED"),
    (".transcript.txt", "TRANSCRIPT"), (".translation.txt", "TRANSLATION"), (".srt", "SUBTITLES"),
    (".rear.scene.txt", "SCENE_DESCRIPTION_REAR"), (".scene.txt", "SCENE_DESCRIPTION"),
)

# Still-image and animation file extensions, seconds a photo is shown.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".gpr")
GIF_EXTENSIONS = (".gif",)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing with sizes and times only; file contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", "modificationTime"
    )


def file_name(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Last extension in lower case, with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def asset_of(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for suffix, asset in reversed(ASSET_SUFFIXES):
        found = F.when(F.endswith(name, F.lit(suffix)), asset).otherwise(found)
    return found


def catalogue(files: DataFrame, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """One row per recording: asset map and summed size. Other files are skipped."""
    name = file_name("path")
    named = files.select(
        *keys, "path", "length", ids.recording_id_of(name).alias("recording_id"), asset_of(name).alias("asset")
    ).filter("recording_id IS NOT NULL AND asset IS NOT NULL")
    per_asset = named.groupBy(*keys, "recording_id", "asset").agg(
        F.max("path").alias("path"), F.sum("length").alias("_bytes")
    )
    return per_asset.groupBy(*keys, "recording_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "path")))).alias("assets"),
        F.sum("_bytes").alias("size_bytes"),
    ).withColumn("kind", ids.kind_of("recording_id")).withColumn("start_ts", ids.start_of("recording_id"))


def scan_files(files: DataFrame, extensions: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Files with one of the extensions (any case) and none of the excluded endings."""
    name = file_name("path")
    keep = extension(name).isin(*[e.lower() for e in extensions])
    for suffix in exclude:
        keep = keep & ~F.endswith(name, F.lit(suffix))
    return files.filter(keep)


def first_by_name(files: DataFrame, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """One file per name: the first path in sort order."""
    rest = [c for c in files.columns if c not in keys]
    picked = files.groupBy(*keys, file_name("path").alias("name")).agg(
        F.min_by(F.struct(*rest), "path").alias("_f")
    )
    return picked.select(*keys, "name", "_f.*")


def resolve_timestamps(files: DataFrame) -> DataFrame:
    """Add ``start_ts`` and ``timestamp_reliable`` from the best time source of a file.

    Columns exif_ts (photos only), container_ts, telemetry_ts, mtime_ts, in this order.
    """
    photo = extension(file_name("path")).isin(*PHOTO_EXTENSIONS)
    real = F.coalesce(F.when(photo, F.col("exif_ts")), F.col("container_ts"), F.col("telemetry_ts"))
    return files.withColumn("start_ts", F.coalesce(real, F.col("mtime_ts"))).withColumn(
        "timestamp_reliable", real.isNotNull()
    )


def assign_ids(files: DataFrame, kind: str, keys: Sequence[str] = ("camera_id",), chunk_s: int = 86400) -> DataFrame:
    """Add ``recording_id``, unique per second: a taken second moves a file on by one.

    second(i) = max(time(i), second(i-1) + 1) equals i + running max of (time(j) - j).
    """
    at = files.withColumn("_at_us", clock.epoch_us("start_ts"))
    at = at.withColumn("_s", F.floor(F.col("_at_us") / 1_000_000).cast("bigint"))
    chunk = spread("_at_us", chunk_s * 1_000_000)
    order = ["_at_us", "path"]
    numbered = scan(at, keys, order, chunk, number="_i")
    out = scan(numbered, keys, order, chunk, peak={"_peak": F.col("_s") - F.col("_i")})
    stamp = clock.stamp(clock.from_epoch_us((F.col("_peak") + F.col("_i")) * 1_000_000))
    return out.withColumn("recording_id", F.concat(stamp, F.lit(f"_{kind}"))).drop("_at_us", "_s", "_i", "_peak")


def attach_generated(videos: DataFrame, files: DataFrame, suffixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Generated assets of each video: a sibling of the same stem, else ``root/<id><suffix>``.

    ``suffixes`` lists (suffix, asset). Gives recording rows with ``asset`` and ``asset_path``.
    """
    table = F.array(*[F.struct(F.lit(s).alias("suffix"), F.lit(a).alias("asset")) for s, a in suffixes])
    asked = videos.withColumn("_s", F.explode(table)).select(
        *videos.columns, F.col("_s.asset").alias("asset"),
        F.concat(F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", ""), F.col("_s.suffix")).alias("_sibling"),
        F.concat("root", F.lit("/"), "recording_id", F.col("_s.suffix")).alias("_rooted"),
    )
    have = files.select("path").distinct()
    a = have.select(F.col("path").alias("_sibling"), F.lit(True).alias("_a"))
    b = have.select(F.col("path").alias("_rooted"), F.lit(True).alias("_b"))
    found = asked.join(a, "_sibling", "left").join(b, "_rooted", "left")
    path = F.when(F.col("_a"), F.col("_sibling")).when(F.col("_b"), F.col("_rooted"))
    return found.withColumn("asset_path", path).filter("asset_path IS NOT NULL").select(
        *videos.columns, "asset", "asset_path"
    )


def is_photo(path: Column | str, gif_frames: Column) -> Column:
    """Still image by extension; a GIF counts only with exactly one frame."""
    ext = extension(file_name(path))
    return ext.isin(*PHOTO_EXTENSIONS) | (ext.isin(*GIF_EXTENSIONS) & F.coalesce(gif_frames == 1, F.lit(False)))


def location_tag(tag: Column | str) -> Column:
    """STRUCT<lat, lon> of a packed location tag such as ``+59.33+018.06/``, else NULL."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    n = F.regexp_extract_all(tag, F.lit(r"[+-]\d+(?:\.\d+)?"), 0)
    return F.when(
        F.size(n) >= 2, F.struct(n[0].cast("double").alias("lat"), n[1].cast("double").alias("lon"))
    )


def listing(lines: DataFrame, text: str = "value") -> DataFrame:
    """Camera listing lines ``n:path,s:size`` to entries.

    Blank lines and ``v:`` headers are skipped; a line without a path or a time in its
    name keeps NULL fields and its text in ``bad_line``.
    """
    kept = [c for c in lines.columns if c != text]
    rows = lines.filter((F.col(text) != "") & ~F.startswith(F.col(text), F.lit("v:")))
    fields = F.str_to_map(F.col(text), F.lit(","), F.lit(":"))
    path = F.try_element_at(fields, F.lit("n"))
    name = file_name(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    start = ids.start_of(name)
    good = start.isNotNull() & ~F.exists(F.split(F.col(text), ","), lambda p: ~F.contains(p, F.lit(":")))
    return rows.select(
        *kept,
        F.when(good, path).alias("path"),
        F.when(good, fields).alias("fields"),
        F.when(good, F.regexp_replace(stem, "[FRI]$", "")).alias("recording_id"),
        F.when(good, start).alias("start_ts"),
        F.when(good, F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))).alias("extension"),
        F.when(good, F.regexp_extract(stem, "([FRI])$", 1)).alias("direction"),
        F.when(~good, F.col(text)).alias("bad_line"),
    )


def snapshots(files: DataFrame, text: str = "value") -> DataFrame:
    """Record-time snapshots ``<id>.record_time.txt``; unreadable ones are skipped."""
    kept = [c for c in files.columns if c not in (text, "path")]
    name = file_name("path")
    return files.filter(F.endswith(name, F.lit(".record_time.txt"))).select(
        *kept, F.regexp_replace(name, r"\.record_time\.txt$", "").alias("recording_id"),
        F.regexp_replace(F.col(text), r"^\s+|\s+$", "").try_cast("bigint").alias("record_time_s"),
    ).filter("record_time_s IS NOT NULL")

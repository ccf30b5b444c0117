"""Catalogue, configuration, sync, lock, retention, history and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, ids, text
from ..operators import archive, oplog
from ..plans.chunked import spread
from ..sources import catalogue, logs
from .bindings import HOUR, SQL_RECORDINGS, recordings
from .captions import SQL_FULL, _squeezed_lines
from .registry import query

BASE_S = 1704067200
SUFFIXES = [s for s, _ in catalogue.ASSET_SUFFIXES] + [".tmp", "?"]
SQL_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
SQL_ASSET_CASE = "CASE " + " ".join(
    f"WHEN ends_with(name, '{s}') THEN '{a}'" for s, a in catalogue.ASSET_SUFFIXES
) + " END"


def listed(t):
    """Four files per recording and a stray one now and then."""
    d = F.col("doc_id")
    rec = F.floor(d / 4).cast("bigint")
    camera = rec % 7
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), ((d * 7 + rec) % len(SUFFIXES) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ids.KINDS]), (rec % 5 + 1).cast("int"))
    stamp = clock.stamp(clock.from_epoch_us((BASE_S + rec * 61) * 1000000))
    name = F.when(suffix == "?", F.lit("notes.txt")).otherwise(F.concat(stamp, F.lit("_"), kind, suffix))
    return t.documents.select(
        camera.alias("camera_id"), F.concat(F.lit("/archive/c"), camera.cast("string"), F.lit("/"), name).alias("path"),
        F.col("n_chars").alias("length"), "doc_id",
    )


SQL_LISTED = f"""
raw_f AS (SELECT doc_id, doc_id // 4 AS rec, doc_id // 4 % 7 AS camera_id, n_chars AS length,
  {SQL_SUFFIXES}[(doc_id * 7 + doc_id // 4) % {len(SUFFIXES)} + 1] AS suffix,
  ['N', 'E', 'M', 'P', 'A'][doc_id // 4 % 5 + 1] AS kind FROM documents),
files AS (SELECT *, '/archive/c' || camera_id || '/' || name AS path FROM (SELECT *, CASE WHEN suffix = '?' THEN 'notes.txt' ELSE
  strftime(make_timestamp(({BASE_S} + rec * 61) * 1000000), '%Y%m%d_%H%M%S') || '_' || kind || suffix END AS name FROM raw_f))
"""


@query("archive_catalogue", f"""
WITH {SQL_LISTED},
f AS (SELECT *, {SQL_ASSET_CASE} AS asset, name[1:17] AS recording_id FROM files WHERE suffix <> '?'),
a AS (SELECT camera_id, recording_id, asset, max(path) AS path, sum(length) AS bytes FROM f WHERE asset IS NOT NULL GROUP BY ALL)
SELECT camera_id, recording_id, string_agg(asset || '=' || path, ';' ORDER BY asset) AS assets,
  CAST(sum(bytes) AS BIGINT) AS size_bytes, recording_id[17:17] AS kind,
  strptime(recording_id[1:15], '%Y%m%d_%H%M%S') AS start_ts
FROM a GROUP BY camera_id, recording_id
""")
def archive_catalogue(t):
    out = catalogue.catalogue(listed(t))
    pairs = F.transform(F.map_entries("assets"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("assets", F.array_join(F.array_sort(pairs), ";"))


@query("catalogue_timestamps", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN ts - INTERVAL 1 DAY END,
    CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 2 HOUR END, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 3 MINUTE END, ts) AS start_ts,
  (event_id % 3 = 0 AND event_id % 2 = 0) OR event_id % 5 = 0 OR event_id % 7 = 0 AS timestamp_reliable FROM events
""")
def catalogue_timestamps(t):
    e, ts = F.col("event_id"), F.col("ts")
    files = t.events.select(
        "event_id", F.when(e % 2 == 0, "/m/a.b/IMG.JPG").otherwise("/m/a.b/clip.mp4").alias("path"),
        F.when(e % 3 == 0, ts - F.expr("INTERVAL '1' DAY")).alias("exif_ts"),
        F.when(e % 5 == 0, ts - F.expr("INTERVAL '2' HOUR")).alias("container_ts"),
        F.when(e % 7 == 0, ts - F.expr("INTERVAL '3' MINUTE")).alias("telemetry_ts"), ts.alias("mtime_ts"),
    )
    return catalogue.resolve_timestamps(files).select("event_id", "start_ts", "timestamp_reliable")


@query("catalogue_unique_ids", """
WITH RECURSIVE f AS (SELECT user_id AS camera_id, event_id, epoch_us(ts) // 600000000 * 600 AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 600000000, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS rn FROM events),
w AS (SELECT camera_id, event_id, rn, s AS got FROM f WHERE rn = 1
  UNION ALL SELECT f.camera_id, f.event_id, f.rn, greatest(f.s, w.got + 1) FROM w JOIN f ON f.camera_id = w.camera_id AND f.rn = w.rn + 1)
SELECT camera_id, event_id, strftime(make_timestamp(got * 1000000), '%Y%m%d_%H%M%S') || '_V' AS recording_id FROM w
""")
def catalogue_unique_ids(t):
    """Times cut to ten minutes, so that many collide."""
    coarse = clock.from_epoch_us(F.floor(clock.epoch_us("ts") / 600000000).cast("bigint") * 600000000)
    files = t.events.select(
        F.col("user_id").alias("camera_id"), "event_id", coarse.alias("start_ts"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"),
    )
    return catalogue.assign_ids(files, "V").select("camera_id", "event_id", "recording_id")


@query("catalogue_scanned_files", f"""
WITH {SQL_LISTED}
SELECT doc_id, path FROM files WHERE (ends_with(name, '.mp4') OR ends_with(name, '.jpg')) AND NOT ends_with(name, '.thumb.jpg')
""")
def catalogue_scanned(t):
    return catalogue.scan_files(listed(t), [".MP4", ".jpg"], [".thumb.jpg"]).select("doc_id", "path")


@query("catalogue_first_by_name", f"""
WITH {SQL_LISTED}
SELECT camera_id % 2 AS camera_id, name, arg_min(path, (path, doc_id)) AS path, count(*) AS copies FROM files GROUP BY ALL
""")
def catalogue_first_by_name(t):
    two = listed(t).withColumn("camera_id", F.col("camera_id") % 2)
    first = catalogue.first_by_name(two.drop("doc_id"))
    copies = two.groupBy("camera_id", catalogue.file_name("path").alias("name")).agg(F.count(F.lit(1)).alias("copies"))
    return first.join(copies, ["camera_id", "name"]).select("camera_id", "name", "path", "copies")


GENERATED = ((".transcript.txt", "TRANSCRIPT"), (".srt", "SUBTITLES"), (".aac", "AUDIO"))


@query("catalogue_generated_assets", """
WITH v AS (SELECT doc_id, '/g/d.' || doc_id % 3 || '/clip' || doc_id AS stem, 'ID' || doc_id AS rid FROM documents),
s AS (SELECT * FROM v CROSS JOIN (VALUES ('.transcript.txt', 'TRANSCRIPT', 0), ('.srt', 'SUBTITLES', 1), ('.aac', 'AUDIO', 2)) x(suffix, asset, n))
SELECT doc_id, asset, CASE WHEN (doc_id + n) % 3 = 0 THEN stem || suffix ELSE '/g/' || rid || suffix END AS asset_path
FROM s WHERE (doc_id + n) % 3 = 0 OR (doc_id + n) % 4 = 0
""")
def catalogue_generated(t):
    d = F.col("doc_id")
    stem = F.concat(F.lit("/g/d."), (d % 3).cast("string"), F.lit("/clip"), d.cast("string"))
    rid = F.concat(F.lit("ID"), d.cast("string"))
    videos = t.documents.select("doc_id", F.concat(stem, F.lit(".mp4")).alias("path"), F.lit("/g").alias("root"), rid.alias("recording_id"))
    made = [
        F.when((d + n) % 3 == 0, F.concat(stem, F.lit(s))) for n, (s, _) in enumerate(GENERATED)
    ] + [
        F.when((d + n) % 4 == 0, F.concat(F.lit("/g/"), rid, F.lit(s))) for n, (s, _) in enumerate(GENERATED)
    ]
    files = t.documents.select(F.explode(F.array_compact(F.array(*made))).alias("path"))
    return catalogue.attach_generated(videos, files, GENERATED).select("doc_id", "asset", "asset_path")


def vod_lines(t):
    d = F.col("doc_id")
    stamp = clock.stamp(clock.from_epoch_us((BASE_S + F.floor(d / 3).cast("bigint") * 61) * 1000000))
    tail = F.element_at(F.array(F.lit("NF.mp4"), F.lit("NR.mp4"), F.lit("NF.thm")), (d % 3 + 1).cast("int"))
    line = F.concat(F.lit("n:/Record/"), stamp, F.lit("_"), tail, F.lit(",s:"), F.col("n_chars").cast("string"))
    line = F.when(d % 50 == 0, "v:1.00").when(d % 50 == 1, "").when(d % 50 == 2, "n:/Record/broken.mp4,s:1").otherwise(line)
    return t.documents.select("doc_id", line.alias("value"))


SQL_VOD = f"""
vod AS (SELECT doc_id, doc_id % 50 = 2 AS bad, n_chars, strftime(make_timestamp(({BASE_S} + doc_id // 3 * 61) * 1000000), '%Y%m%d_%H%M%S') AS st,
  ['NF.mp4', 'NR.mp4', 'NF.thm'][doc_id % 3 + 1] AS tail FROM documents WHERE doc_id % 50 > 1)
"""


@query("camera_listing_parsed", f"""
WITH {SQL_VOD}
SELECT doc_id, CASE WHEN NOT bad THEN st || '_N' END AS recording_id, CASE WHEN NOT bad THEN '/Record/' || st || '_' || tail END AS path,
  CASE WHEN NOT bad THEN n_chars END AS size, CASE WHEN NOT bad THEN tail[3:] END AS extension,
  CASE WHEN NOT bad THEN tail[2:2] END AS direction, CASE WHEN bad THEN 'n:/Record/broken.mp4,s:1' END AS bad_line FROM vod
""")
def camera_listing(t):
    out = catalogue.listing(vod_lines(t))
    return out.select(
        "doc_id", "recording_id", "path", F.try_element_at("fields", F.lit("s")).cast("bigint").alias("size"),
        "extension", "direction", "bad_line",
    )


def _entries(t):
    return catalogue.listing(vod_lines(t)).filter("bad_line IS NULL").withColumn("camera_id", F.lit(1).cast("bigint"))


SQL_ENTRIES = f"""
{SQL_VOD},
ent AS (SELECT st || '_N' AS recording_id, bool_or(tail = 'NF.mp4') AS f, bool_or(tail = 'NR.mp4') AS r,
  bool_or(tail = 'NF.thm') AS t FROM vod WHERE NOT bad GROUP BY 1)
"""


@query("missing_sidecars", f"""
WITH {SQL_ENTRIES}
SELECT recording_id, s AS suffix FROM ent CROSS JOIN (VALUES ('.gps'), ('.3gf')) x(s)
UNION ALL SELECT recording_id, 'F.thm' FROM ent WHERE f AND NOT t
UNION ALL SELECT recording_id, 'R.thm' FROM ent WHERE r
""")
def missing_sidecars(t):
    return archive.missing_sidecars(_entries(t)).select("recording_id", "suffix")


@query("found_kind_summary", """
WITH f AS (SELECT doc_id // 5 AS rec, ['.gps', '.3gf', '.THM', '.mp4', '.gps'][doc_id * 3 % 7 % 5 + 1] AS e FROM documents),
g AS (SELECT rec, bool_or(e = '.gps') AS a, bool_or(e = '.3gf') AS b, bool_or(e = '.THM') AS c FROM f GROUP BY 1)
SELECT rec AS recording_id, CASE WHEN a AND b AND c THEN 'gps, 3gf and thumbnails' WHEN a AND b THEN 'gps and 3gf'
  WHEN a AND c THEN 'gps and thumbnails' WHEN b AND c THEN '3gf and thumbnails' WHEN a THEN 'gps' WHEN b THEN '3gf'
  WHEN c THEN 'thumbnails' ELSE '' END AS found FROM g
""")
def found_kind_summary(t):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".gps", ".3gf", ".THM", ".mp4", ".gps")]), (d * 3 % 7 % 5 + 1).cast("int"))
    rows = t.documents.select(F.lit(1).alias("camera_id"), F.floor(d / 5).cast("bigint").alias("recording_id"), ext.alias("extension"))
    return archive.found_kinds(rows).drop("camera_id")


# --- configuration ----------------------------------------------------


def snapshot_files(t):
    r = recordings(t).filter("kind = 'M'")
    value = F.when(F.col("recording_key") % 10 == 0, "soon").otherwise(
        F.concat(F.lit(" "), (60 * (F.col("recording_key") % 3 + 1)).cast("string"), F.lit("\n"))
    )
    return r.select(
        "camera_id", F.concat(F.lit("/archive/"), "recording_id", F.lit(".record_time.txt")).alias("path"), value.alias("value")
    )


SQL_SNAPSHOTS = f"""
{SQL_RECORDINGS},
snap AS (SELECT camera_id, recording_id, 60 * (recording_key % 3 + 1) AS record_time_s FROM rec WHERE kind = 'M' AND recording_key % 10 <> 0)
"""


@query("record_time_snapshots", f"WITH {SQL_SNAPSHOTS} SELECT * FROM snap")
def record_time_snapshots(t):
    return catalogue.snapshots(snapshot_files(t))


@query("record_time_as_of", f"""
WITH {SQL_SNAPSHOTS}
SELECT r.recording_key, coalesce(s.record_time_s, 300) AS record_time_s FROM rec r
ASOF LEFT JOIN snap s ON r.camera_id = s.camera_id AND r.recording_id >= s.recording_id
""")
def record_time_as_of(t):
    out = archive.record_time_at(recordings(t), catalogue.snapshots(snapshot_files(t)))
    return out.select("recording_key", "record_time_s")


LATE = ids.interval(since="20240103")


@query("default_max_gap", f"""
WITH {SQL_SNAPSHOTS},
a AS (SELECT camera_id, 'all' AS scope, arg_max(record_time_s, recording_id) AS g FROM snap GROUP BY 1),
f AS (SELECT camera_id, min(recording_id) AS recording_id FROM rec WHERE recording_id[1:15] BETWEEN '{LATE.first}' AND '{LATE.last}' GROUP BY 1),
b AS (SELECT f.camera_id, 'late' AS scope, s.record_time_s AS g FROM f ASOF LEFT JOIN snap s ON f.camera_id = s.camera_id AND f.recording_id >= s.recording_id),
c AS (SELECT DISTINCT camera_id FROM rec)
SELECT c.camera_id, scope, coalesce(g, 300) AS max_gap_s FROM c CROSS JOIN (VALUES ('all'), ('late')) x(scope)
LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) USING (camera_id, scope)
""")
def default_max_gap(t):
    snaps = catalogue.snapshots(snapshot_files(t))
    every = archive.default_max_gap(recordings(t), snaps).withColumn("scope", F.lit("all"))
    late = archive.default_max_gap(recordings(t), snaps, LATE).withColumn("scope", F.lit("late"))
    return every.unionByName(late).select("camera_id", "scope", "max_gap_s")


@query("snapshots_to_write", f"""
WITH {SQL_SNAPSHOTS},
k AS (SELECT camera_id, min(recording_id) AS e, arg_max(record_time_s, recording_id) AS l FROM snap GROUP BY 1)
SELECT recording_key FROM rec LEFT JOIN k USING (camera_id) WHERE kind = 'E'
  AND NOT (coalesce(recording_id >= e, false) AND l IS NOT DISTINCT FROM 60 * (recording_key % 3 + 1))
""")
def snapshots_to_write(t):
    readings = recordings(t).filter("kind = 'E'").withColumn("record_time_s", 60 * (F.col("recording_key") % 3 + 1))
    return archive.snapshots_to_write(readings, catalogue.snapshots(snapshot_files(t))).select("recording_key")


# --- filters and texts --------------------------------------------------


@query("recordings_filtered", f"""
WITH {SQL_RECORDINGS}
SELECT recording_key, recording_id FROM rec WHERE kind IN ('N', 'E') AND recording_id[1:15] BETWEEN '20240105_120000' AND '20240109_999999'
  AND (has_front OR has_rear)
""")
def recordings_filtered(t):
    span = ids.interval(since="20240105_12", until="20240109")
    out = archive.filter_recordings(recordings(t), kinds=ids.parse_kinds("n, E"), interval=span, videos_only=True)
    return out.select("recording_key", "recording_id")


@query("recordings_of_one_day", f"""
WITH {SQL_RECORDINGS} SELECT recording_key FROM rec WHERE recording_id[1:8] = '20240112'
""")
def recordings_of_one_day(t):
    return recordings(t).filter(ids.interval("20240112").contains("recording_id")).select("recording_key")


@query("recordings_with_front", f"""
WITH {SQL_LISTED}
SELECT DISTINCT camera_id, name[1:17] AS recording_id FROM files WHERE suffix = 'F.mp4'
""")
def recordings_with_front(t):
    return archive.with_front_video(catalogue.catalogue(listed(t))).select("camera_id", "recording_id")


@query("recordings_by_source_name", f"WITH {SQL_LISTED} SELECT doc_id FROM files WHERE contains(name, '_EF')")
def recordings_by_source(t):
    return listed(t).filter(F.contains(catalogue.file_name("path"), F.lit("_EF"))).select("doc_id")


@query("recording_ids_parsed", f"""
WITH {SQL_LISTED}
SELECT doc_id, CASE WHEN suffix <> '?' THEN name[1:17] END AS recording_id, CASE WHEN suffix <> '?' THEN kind END AS kind,
  CASE WHEN suffix <> '?' THEN make_timestamp(({BASE_S} + rec * 61) * 1000000) END AS start_ts FROM files
""")
def recording_ids_parsed(t):
    rid = ids.recording_id_of(catalogue.file_name("path"))
    return listed(t).select("doc_id", rid.alias("recording_id"), ids.kind_of(rid).alias("kind"), ids.start_of(rid).alias("start_ts"))


@query("photos_classified", """
SELECT doc_id, e IN ('.JPG', '.png') OR (e = '.gif' AND coalesce(n = 1, false)) AS is_photo
FROM (SELECT doc_id, ['.JPG', '.png', '.gif', '.mp4', ''][doc_id % 5 + 1] AS e, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END AS n FROM documents)
""")
def photos_classified(t):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".png", ".gif", ".mp4", "")]), (d % 5 + 1).cast("int"))
    path = F.concat(F.lit("/p/x.d/file"), d.cast("string"), ext)
    return t.documents.select("doc_id", catalogue.is_photo(path, F.when(d % 4 != 0, d % 3)).alias("is_photo"))


@query("asset_columns_in_use", f"""
WITH {SQL_RECORDINGS}
SELECT camera_id, bool_and(has_front) AS has_front, bool_and(has_gps) AS has_gps FROM rec GROUP BY 1
""")
def asset_columns_in_use(t):
    table = recordings(t).groupBy("camera_id").agg(
        F.bool_and("has_front").alias("has_front"), F.bool_and("has_gps").alias("has_gps"),
    ).withColumn("has_interior", F.lit(False)).withColumn("has_audio", F.lit(None).cast("boolean"))
    used = archive.drop_empty_assets(
        recordings(t).select("has_front", "has_gps", F.lit(False).alias("has_interior"), F.lit(None).cast("boolean").alias("has_audio")),
        ["has_front", "has_gps", "has_interior", "has_audio"],
    )
    return table.select("camera_id", *used.columns)


@query("location_tags_parsed", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN round(doc_id % 90 + 0.25::DOUBLE, 4) END AS lat,
  CASE WHEN doc_id % 4 <> 0 THEN round(-(doc_id % 180) - 0.5::DOUBLE, 4) END AS lon FROM documents
""")
def location_tags(t):
    d = F.col("doc_id")
    full = F.format_string("+%07.4f-%08.4f+12/", d % 90 + F.lit(0.25), d % 180 + F.lit(0.5))
    at = catalogue.location_tag(F.when(d % 4 == 0, "+12.5").otherwise(full))
    return t.documents.select("doc_id", F.round(at["lat"], 4).alias("lat"), F.round(at["lon"], 4).alias("lon"))


def _sql_size(n: str, units: list[str]) -> str:
    steps = " ".join(
        f"WHEN {n} < {1024 ** (i + 1)} THEN printf('%.2f{u}', round_even({n} / {1024 ** i}.0::DOUBLE, 2))"
        for i, u in enumerate(units) if i
    )
    return f"CASE WHEN {n} < 1024 THEN {n} || '{units[0]}' {steps} END"


@query("size_texts", f"""
WITH s AS (SELECT o_orderkey, CAST(pow(o_orderkey + 1, 1 + o_orderkey % 3) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, {_sql_size('n', ['B', 'K', 'M', 'G', 'T'])} AS short_text, {_sql_size('n', [' B', ' KB', ' MB', ' GB', ' TB'])} AS long_text FROM s
""")
def size_texts(t):
    k = F.col("o_orderkey")
    # exact where the power fits an integer, as a double beyond
    square = F.when(F.abs(k) < 3_037_000_499, (k + 1) * (k + 1)).otherwise(F.pow((k + 1).cast("double"), F.lit(2.0)))
    cube = F.when(F.abs(k) < 2_097_151, (k + 1) * (k + 1) * (k + 1)).otherwise(F.pow((k + 1).cast("double"), F.lit(3.0)))
    n = F.when(k % 3 == 0, k + 1).when(k % 3 == 1, square).otherwise(cube)
    sized = t.orders.select("o_orderkey", n.alias("n"))
    return sized.select("o_orderkey", text.size_text("n").alias("short_text"), text.size_text("n", long=True).alias("long_text"))


@query("language_codes", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' WHEN 'de' THEN 'deu' ELSE lang END AS long_code, lang AS short_code
FROM documents
""")
def language_codes(t):
    long = text.language_long(F.concat(F.lit(" "), F.upper("lang")))
    return t.documents.select("doc_id", long.alias("long_code"), text.language_short(long).alias("short_code"))


# --- sync, locks, cursors, retention -------------------------------------


def _sync(t):
    d = F.col("doc_id")
    listing = t.documents.select(
        F.lit(1).alias("camera_id"), d.alias("name"), F.floor(d / 4).cast("bigint").alias("recording_id"),
        F.col("n_chars").alias("size"), (d % 3 != 0).alias("is_video"),
    )
    here = t.labels.select("doc_id").distinct().join(t.documents, "doc_id").select(
        F.lit(1).alias("camera_id"), d.alias("name"), (F.col("n_chars") + (F.floor(d / 2).cast("bigint") % 3 - 1) * 10).alias("size")
    )
    return listing, here


SQL_SYNC = """
loc AS (SELECT doc_id, n_chars + (doc_id // 2 % 3 - 1) * 10 AS here FROM documents SEMI JOIN labels USING (doc_id)),
sy AS (SELECT d.doc_id, n_chars, here FROM documents d LEFT JOIN loc USING (doc_id))
"""


@query("sync_plan", f"""
WITH {SQL_SYNC}
SELECT doc_id AS name, CASE WHEN here IS NULL THEN 'fetch' WHEN doc_id % 3 = 0 OR here = n_chars THEN 'skip'
  WHEN here > n_chars THEN 'restart' ELSE 'resume' END AS action FROM sy
""")
def sync_plan(t):
    return archive.sync_plan(*_sync(t)).select("name", "action")


@query("sync_complete_recordings", f"""
WITH {SQL_SYNC}
SELECT doc_id // 2 AS recording_id FROM sy GROUP BY 1 HAVING bool_and(coalesce(here = n_chars, false))
""")
def sync_complete(t):
    listing, here = _sync(t)
    listing = listing.withColumn("recording_id", F.floor(F.col("name") / 2).cast("bigint"))
    return archive.fully_local(listing, here).select("recording_id")


ASSET_SETS = (("AUDIO", "SRT"), ("AUDIO", "SCENE", "SRT"), ("SCENE",), ("AUDIO",))


def _set_of(n, sets=ASSET_SETS):
    return F.element_at(F.array(*[F.array(*[F.lit(a) for a in s]) for s in sets]), (n + 1).cast("int"))


def _days(t, kind: str):
    day = F.substring("recording_id", 1, 8)
    return recordings(t).filter(F.col("kind") == kind).select("camera_id", "recording_key", "recording_id", day.alias("day"))


def _locks(t):
    k = F.col("recording_key")
    last = F.translate(F.date_add(F.to_date("day", "yyyyMMdd"), (k % 4).cast("int")).cast("string"), "-", "")
    rows = _days(t, "E").select(
        "camera_id", F.concat("day", F.lit("_000000")).alias("first"), F.concat(last, F.lit("_999999")).alias("last"),
        F.array_join(_set_of(k % 4), ",").alias("s"), k,
    )
    best = rows.groupBy("camera_id", "first", "last").agg(F.min_by("s", "recording_key").alias("s"))
    return best.select("camera_id", "first", "last", F.split("s", ",").alias("assets"), F.lit("t0").alias("locked_at"))


def _changes(t):
    return _days(t, "M").select(
        "camera_id", F.concat("day", F.lit("_000000")).alias("first"), F.concat("day", F.lit("_999999")).alias("last"),
        _set_of(F.col("recording_key") % 3).alias("assets"), F.col("recording_id").alias("locked_at"),
    )


SQL_SETS = "[" + ", ".join("'" + ",".join(s) + "'" for s in ASSET_SETS) + "]"
SQL_LOCKS = f"""
{SQL_RECORDINGS},
lk AS (SELECT camera_id, recording_id[1:8] || '_000000' AS first,
    strftime(start_ts + to_days(CAST(recording_key % 4 AS INTEGER)), '%Y%m%d') || '_999999' AS last,
    string_split(arg_min({SQL_SETS}[recording_key % 4 + 1], recording_key), ',') AS assets
  FROM rec WHERE kind = 'E' GROUP BY ALL),
ch AS (SELECT camera_id, recording_id[1:8] || '_000000' AS first, recording_id[1:8] || '_999999' AS last,
  string_split({SQL_SETS}[recording_key % 3 + 1], ',') AS assets, recording_id AS locked_at FROM rec WHERE kind = 'M')
"""


@query("locks_covering_requests", f"""
WITH {SQL_LOCKS},
rq AS (SELECT camera_id, recording_key AS request_id, recording_id[1:15] AS first, recording_id[1:8] || '_999999' AS last,
  CASE WHEN recording_key % 5 = 4 THEN [] ELSE string_split({SQL_SETS}[recording_key % 4 + 1], ',') END AS assets FROM rec WHERE kind = 'N')
SELECT DISTINCT camera_id, request_id FROM rq JOIN lk USING (camera_id)
WHERE len(rq.assets) > 0 AND lk.first <= rq.first AND lk.last >= rq.last AND list_has_all(lk.assets, rq.assets)
""")
def locks_covering(t):
    k = F.col("recording_key")
    asked = _days(t, "N").select(
        "camera_id", k.alias("request_id"), F.substring("recording_id", 1, 15).alias("first"),
        F.concat("day", F.lit("_999999")).alias("last"),
        F.when(k % 5 == 4, F.array().cast("array<string>")).otherwise(_set_of(k % 4)).alias("assets"),
    )
    return archive.locked_requests(asked, _locks(t)).select("camera_id", "request_id")


@query("locks_added", f"""
WITH {SQL_LOCKS},
n AS (SELECT camera_id, first, last, list_distinct(flatten(list(assets))) AS assets, max(locked_at) AS at FROM ch GROUP BY ALL)
SELECT camera_id, first, last, coalesce(n.at, 't0') AS locked_at,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(lk.assets, []), coalesce(n.assets, [])))), ',') AS assets
FROM lk FULL JOIN n USING (camera_id, first, last)
""")
def locks_added(t):
    return archive.lock_assets(_locks(t), _changes(t)).withColumn("assets", F.array_join("assets", ","))


@query("locks_removed", f"""
WITH {SQL_LOCKS},
n AS (SELECT camera_id, first, last, flatten(list(assets)) AS gone FROM ch GROUP BY ALL),
l AS (SELECT camera_id, first, last, list_sort(list_filter(lk.assets, lambda a: NOT list_contains(coalesce(gone, []), a))) AS assets
  FROM lk LEFT JOIN n USING (camera_id, first, last))
SELECT camera_id, first, last, 't0' AS locked_at, array_to_string(assets, ',') AS assets FROM l WHERE len(assets) > 0
""")
def locks_removed(t):
    return archive.unlock_assets(_locks(t), _changes(t)).withColumn("assets", F.array_join("assets", ","))


SQL_CURSORS = f"""
{SQL_RECORDINGS},
cu AS (SELECT camera_id, {SQL_SETS}[recording_key % 4 + 1] AS assets, max(recording_id) AS last_seen FROM rec WHERE kind = 'E' GROUP BY ALL)
"""


def _cursors(t):
    return _days(t, "E").groupBy("camera_id", F.array_sort(_set_of(F.col("recording_key") % 4)).alias("assets")).agg(
        F.max("recording_id").alias("last_seen")
    )


@query("resume_bounds", f"""
WITH {SQL_CURSORS}
SELECT recording_key, greatest(recording_id[1:15], last_seen) AS since FROM
  (SELECT *, {SQL_SETS}[recording_key % 4 + 1] AS assets FROM rec WHERE kind = 'M') LEFT JOIN cu USING (camera_id, assets)
""")
def resume_bounds(t):
    asked = _days(t, "M").select(
        "camera_id", "recording_key", F.substring("recording_id", 1, 15).alias("since"),
        F.reverse(_set_of(F.col("recording_key") % 4)).alias("assets"),
    )
    return archive.resume_bounds(asked, _cursors(t)).select("recording_key", "since")


@query("resume_advanced", f"""
WITH {SQL_CURSORS},
d AS (SELECT camera_id, {SQL_SETS}[recording_key % 3 + 1] AS assets, max(recording_id) AS seen FROM rec WHERE kind = 'P' GROUP BY ALL)
SELECT camera_id, assets, coalesce(seen, last_seen) AS last_seen FROM cu FULL JOIN d USING (camera_id, assets)
""")
def resume_advanced(t):
    done = _days(t, "P").withColumn("assets", _set_of(F.col("recording_key") % 3))
    return archive.advance_cursors(_cursors(t), done).withColumn("assets", F.array_join("assets", ","))


@query("cache_kept_by_size", """
SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) <= 60000 AS keep FROM documents
""")
def cache_kept(t):
    files = t.documents.select(
        "source", "doc_id", F.col("doc_id").alias("written"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size")
    )
    return archive.keep_newest_bytes(files, ["source"], 60000, spread(-F.col("written"), 500)).select("doc_id", "keep")


@query("log_months_kept", """
SELECT stream, month, row_number() OVER (PARTITION BY stream ORDER BY month DESC) <= 12 AS keep
FROM (SELECT DISTINCT o_orderpriority AS stream, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
""")
def log_months(t):
    months = t.orders.select(
        F.col("o_orderpriority").alias("stream"), F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month")
    ).distinct()
    return archive.keep_newest_months(months, ["stream"])


@query("recordings_by_day", f"""
WITH {SQL_RECORDINGS}
SELECT camera_id, recording_id[1:8] AS day, count(*) AS recordings, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  max(recording_id) AS newest_id, min(recording_id) AS oldest_id FROM rec GROUP BY ALL
""")
def recordings_by_day(t):
    return archive.by_day(recordings(t))


@query("sign_reads_unverified", """
SELECT event_id // 2 AS detection, count(*) AS reads, count(DISTINCT event_type) > 1 AS unverified FROM events GROUP BY 1
""")
def reads_unverified(t):
    e = F.col("event_id")
    read = F.when(e % 2 == 0, F.concat(F.lit("  ab "), "event_type")).otherwise(F.concat(F.lit("AB \t"), F.upper("event_type"), F.lit("\n")))
    return archive.unverified_reads(t.events.select(F.floor(e / 2).cast("bigint").alias("detection"), read.alias("text")), ["detection"])


# --- history and logs ------------------------------------------------------


def _history_lines(t):
    """JSON lines with cut, over-full and short ones mixed in."""
    e = F.col("event_id")
    q = F.lit('"')
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "interrupted").otherwise("succeeded")
    start = F.concat(clock.iso_seconds("ts"), F.lit("+00:00"))
    extra = F.when(e % 19 == 0, F.lit(',"shell":1')).when(e % 2 == 0, F.concat(F.lit(',"params":'), "props")).otherwise(F.lit(""))
    last = F.when(e % 23 == 0, F.lit("")).otherwise(F.concat(F.lit(',"status":"'), status, q))
    line = F.concat(
        F.lit('{"command":"'), "event_type", F.lit('","command_line":"Run '), "event_type", F.lit(" Cam"),
        (F.col("user_id") % 7).cast("string"), F.lit('","source":"'), F.when(e % 3 == 0, "web").otherwise("cli"),
        F.lit('","username":null,"started_at":"'), start, F.lit('","duration_seconds":'), F.col("value").cast("string"),
        last, extra, F.lit("}"),
    )
    lines = t.events.select(F.col("user_id").alias("stream"), e.alias("line_no"), line.alias("x"))
    cut = F.when(F.col("line_no") % 17 == 0, F.expr("left(x, length(x) - 9)")).otherwise(F.col("x"))
    return lines.select("stream", "line_no", cut.alias("value"))


SQL_HISTORY = """
hist AS (SELECT user_id AS stream, event_id AS line_no, event_type AS command, 'Run ' || event_type || ' Cam' || user_id % 7 AS command_line,
  CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'cli' END AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS started_at,
  value AS duration_seconds, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'interrupted' ELSE 'succeeded' END AS status,
  CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, ts
  FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0)
"""


def _numbered(t):
    return oplog.numbered(logs.history(_history_lines(t)), ["stream"], ["line_no"], spread("line_no", 100000))


@query("history_numbered", f"""
WITH {SQL_HISTORY}
SELECT stream, line_no, command, command_line, source, started_at, duration_seconds, status, k, number FROM hist
""")
def history_numbered(t):
    return _numbered(t).select(
        "stream", "line_no", "command", "command_line", "source", "started_at", "duration_seconds", "status",
        F.try_element_at("params", F.lit("k")).alias("k"), "number",
    )


@query("history_filtered_tail", f"""
WITH {SQL_HISTORY},
f AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY number DESC) AS back FROM hist
  WHERE status IN ('failed', 'interrupted') AND contains(lower(command_line), 'cam') AND contains(lower(command_line), 'run')
    AND strftime(ts, '%Y%m%d_%H%M%S') BETWEEN '20240102_000000' AND '20240128_999999')
SELECT stream, number, command FROM f WHERE back <= 3
""")
def history_filtered_tail(t):
    some = oplog.filtered(
        _numbered(t), failed_only=True, camera="CAM", search="run", interval=ids.interval(since="20240102", until="20240128")
    )
    return oplog.tail(some, ["stream"], 3).select("stream", "number", "command")


@query("history_by_command", f"""
WITH {SQL_HISTORY} SELECT stream, number FROM hist WHERE lower(command) = 'view' AND source = 'web'
""")
def history_by_command(t):
    return oplog.filtered(_numbered(t), command="View", source="web").select("stream", "number")


@query("run_log_lines", f"""
WITH {SQL_HISTORY},
runs AS (SELECT stream, number, command, epoch_us(ts) // 1000000 - 2 AS a, epoch_us(ts) // 1000000 + duration_seconds * 900 + 2 AS b FROM hist),
rl AS (SELECT user_id AS stream, event_id AS record_no, event_type AS command, epoch_us(ts) / 1000000.0::DOUBLE AS c FROM events)
SELECT stream, number, record_no FROM runs JOIN rl USING (stream, command) WHERE c BETWEEN a AND b
""")
def run_log_lines(t):
    """Log stamps are one hour ahead of UTC (January, so no summer time)."""
    local = F.col("ts") + F.expr("INTERVAL '1' HOUR")
    records = t.events.select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("record_no"), F.col("event_type").alias("source"), local.alias("ts")
    )
    runs = _numbered(t).withColumn("duration_seconds", F.col("duration_seconds") * 900)
    return oplog.run_lines(runs, records, zone="Europe/Stockholm", width_s=12 * HOUR)


def _log_files(t):
    rows = _squeezed_lines(t)

    def line(x, i):
        head = F.concat(
            F.when(i % 16 == 8, F.lit("2024-13-45 10:00:00")).otherwise(
                F.substring(clock.from_epoch_us((BASE_S + F.col("doc_id") * 100 + i) * 1000000).cast("string"), 1, 19)
            ),
            F.lit(",123 [tool"), (i % 3).cast("string"), F.lit("] "),
        )
        return F.when((i + F.col("doc_id")) % 4 == 0, F.concat(head, x)).otherwise(F.concat(F.lit("| "), x))

    body = F.concat(F.array_join(F.transform("l", line), "\n"), F.lit("\n"))
    d = F.col("doc_id")
    return rows.filter(F.size("l") > 0).select(
        F.floor(d / 10).cast("bigint").alias("stream"), F.format_string("2024-%02d", d % 10 + 1).alias("file_order"), body.alias("text")
    )


SQL_LOG = f"""
{SQL_FULL},
ln AS (SELECT doc_id // 10 AS stream, doc_id % 10 AS file_order, doc_id, pos, line, (pos + doc_id) % 4 = 0 AS h FROM full_
  WHERE NOT ((pos + doc_id) % 4 = 0 AND pos % 16 = 8)),
nr AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY file_order, pos) AS BIGINT) AS record_no FROM ln),
rec_ AS (SELECT *, CASE WHEN h THEN make_timestamp(({BASE_S} + doc_id * 100 + pos) * 1000000) END AS ts,
  CASE WHEN h THEN 'tool' || pos % 3 END AS source, CASE WHEN h THEN line ELSE '| ' || line END AS message FROM nr WHERE record_no > 0)
"""


@query("job_log_lines", f"""
WITH {SQL_LOG}
SELECT stream, record_no, pos AS line_no, h AS opens, ts, source, message FROM rec_
""")
def job_log_lines(t):
    return logs.job_log_lines(_log_files(t)).drop("file_order")


@query("job_log_records", f"""
WITH {SQL_LOG}
SELECT stream, record_no, max(ts) AS ts, max(source) AS source, string_agg(message, chr(10) ORDER BY file_order, pos) AS message
FROM rec_ GROUP BY ALL
""")
def job_log_records(t):
    return logs.job_log_records(logs.job_log_lines(_log_files(t)))


NAMES = ("trip.log", "stitch.mp4", "front.mp4", "trip.gpx", "map_zoom_2.mp4", "trip_info.txt")


def _trip_files(t):
    d = F.col("doc_id")
    n = F.floor(d / 6).cast("bigint")
    label = F.concat(F.lit("trip_"), n.cast("string"))
    folder = F.when(n % 2 == 0, F.concat(F.lit("van_"), label)).otherwise(label)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (d % 6 + 1).cast("int"))
    name = F.when((n % 7 == 0) & (name == "trip.log"), "notes.txt").otherwise(name)
    title = F.when(n % 3 != 0, F.concat(F.lit("=== tool trip log: "), label, F.lit(" ===")))
    rows = t.documents.select(
        F.lit(0).alias("root_rank"), (n % 5).alias("camera_id"), F.concat(F.lit("/t/"), folder).alias("folder_path"),
        folder.alias("folder"), name.alias("name"), F.when(name == "trip.log", F.coalesce(title, F.lit("no title"))).alias("first_line"), n.alias("n"),
    )
    fallback = rows.withColumn("root_rank", F.lit(1)).withColumn("camera_id", F.lit(None).cast("bigint"))
    return rows.filter("n % 4 <> 0").unionByName(fallback).drop("n")


@query("trip_folders", """
WITH n AS (SELECT doc_id // 6 AS n, count(*) AS c FROM documents GROUP BY 1),
k AS (SELECT n, c, 'trip_' || n AS plain, CASE WHEN n % 2 = 0 THEN 'van_trip_' || n ELSE 'trip_' || n END AS folder FROM n WHERE n % 7 <> 0 AND c >= 1)
SELECT '/t/' || folder AS folder_path, CASE WHEN n % 4 <> 0 THEN n % 5 || '/' || folder ELSE folder END AS trip_id,
  CASE WHEN n % 3 <> 0 THEN plain ELSE folder END AS label, CASE WHEN n % 3 <> 0 AND n % 2 = 0 THEN 'van' END AS prefix,
  CASE WHEN c >= 3 THEN 'stitch.mp4,front.mp4' WHEN c = 2 THEN 'stitch.mp4' ELSE '' END AS videos, c >= 4 AS has_gpx, false AS has_map, c >= 6 AS has_info,
  CASE WHEN c >= 5 THEN 'map_zoom_2.mp4' ELSE '' END AS map_zooms FROM k
""")
def trip_folders(t):
    out = logs.trip_folders(_trip_files(t)).withColumn("map_zooms", F.array_join("map_zooms", ","))
    return out.select("folder_path", "trip_id", "label", "prefix", "videos", "has_gpx", "has_map", "has_info", "map_zooms")


@query("trip_info_pairs", """
SELECT event_id, 1 AS line_no, 'Started' AS label, strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events
UNION ALL SELECT event_id, 3, 'Distance', event_id || ' km: far' FROM events
UNION ALL SELECT event_id, 4, 'Includes Parking-mode footage', '' FROM events
""")
def trip_info_pairs(t):
    body = F.concat(
        F.lit("Started: "), F.substring(F.col("ts").cast("string"), 1, 19), F.lit("\n  \nDistance: "),
        F.col("event_id").cast("string"), F.lit(" km: far\nIncludes Parking-mode footage\n"),
    )
    return logs.trip_info_pairs(t.events.select("event_id", body.alias("text"))).withColumn("line_no", F.col("line_no").cast("int"))

"""Trip detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import movement, trips
from ..session import scratch_path, settle
from .bindings import (
    HOUR, SQL_DAY_RECORDINGS, SQL_DAY_SAMPLES, SQL_FIXES, SQL_RECORDINGS,
    day_recordings, day_samples, fixes, recordings,
)
from .registry import query

GAP = 6 * HOUR
CAP = 60

SQL_MARKS = f"""
gaps AS (
  SELECT *, lag(recording_id) OVER w AS prev_id, lag(timestamp_reliable) OVER w AS prev_ok,
    start_s - lag(start_s + coalesce(duration_s, 0)) OVER w AS gap_s
  FROM rec WINDOW w AS (PARTITION BY camera_id ORDER BY start_s, recording_key)),
marks AS (
  SELECT *, CASE WHEN prev_id IS NULL THEN 'first'
    WHEN NOT timestamp_reliable OR NOT prev_ok THEN 'unreliable'
    WHEN gap_s > {GAP + 10} THEN 'gap' ELSE 'within' END AS rule FROM gaps),
numbered AS (
  SELECT *, sum(CASE WHEN rule = 'within' THEN 0 ELSE 1 END) OVER
    (PARTITION BY camera_id ORDER BY start_s, recording_key) AS trip_no FROM marks)
"""

SQL_PLAIN = SQL_MARKS.replace("WHEN NOT timestamp_reliable OR NOT prev_ok THEN 'unreliable'", "")


def _reliable(df):
    return df.withColumn("timestamp_reliable", F.lit(True))


@query("trips_gap_split", f"""
WITH {SQL_RECORDINGS}, {SQL_PLAIN}
SELECT camera_id, recording_key, CAST(trip_no AS BIGINT) AS trip_no, gap_s, rule FROM numbered
""")
def gap_split(t):
    found = trips.detect(_reliable(recordings(t)), max_gap_s=GAP)
    return found.select("camera_id", "recording_key", "trip_no", "gap_s", "rule")


@query("trips_unreliable_split", f"""
WITH {SQL_RECORDINGS}, {SQL_MARKS}
SELECT camera_id, recording_key, CAST(trip_no AS BIGINT) AS trip_no, rule FROM numbered
""")
def unreliable_split(t):
    found = trips.detect(recordings(t), max_gap_s=GAP)
    return found.select("camera_id", "recording_key", "trip_no", "rule")


SQL_CAP = f"""
{SQL_MARKS},
seq AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY start_s, recording_key) AS rn,
   CASE WHEN kind = 'P' THEN coalesce(duration_s, 0) ELSE 0 END AS inc FROM marks),
walk AS (
  SELECT camera_id, rn, recording_key, false AS cap, inc AS held, inc AS asked FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.camera_id, s.rn, s.recording_key, w.held + s.inc > {CAP},
    CASE WHEN w.held + s.inc > {CAP} OR s.rule IN ('unreliable', 'gap') THEN s.inc
         WHEN s.kind = 'P' THEN w.held + s.inc ELSE 0 END, w.held + s.inc
  FROM walk w JOIN seq s ON s.camera_id = w.camera_id AND s.rn = w.rn + 1),
capped AS (
  SELECT s.* EXCLUDE (rule), CASE WHEN w.cap THEN 'cap' ELSE s.rule END AS rule,
    CASE WHEN w.cap THEN w.asked END AS asked
  FROM seq s JOIN walk w USING (camera_id, recording_key))
"""


@query("trips_parking_cap", f"""
WITH RECURSIVE {SQL_RECORDINGS}, {SQL_CAP}
SELECT camera_id, recording_key, rule, CAST(asked AS BIGINT) AS parking_total_s,
  CAST(sum(CASE WHEN rule = 'within' THEN 0 ELSE 1 END) OVER
    (PARTITION BY camera_id ORDER BY start_s, recording_key) AS BIGINT) AS trip_no FROM capped
""")
def parking_cap(t):
    found = trips.detect(recordings(t), max_gap_s=GAP, parking_cap_s=CAP)
    return found.select("camera_id", "recording_key", "rule", "parking_total_s", "trip_no")


LIMIT = f"{GAP + 10:.1f}s"


@query("trips_split_reasons", f"""
WITH RECURSIVE {SQL_RECORDINGS}, {SQL_CAP}
SELECT camera_id, recording_key, CASE rule
  WHEN 'first' THEN 'first recording in the archive'
  WHEN 'cap' THEN 'starts a new trip - parking footage would reach '
    || printf('%.1fm', round_even(asked / 60, 1)) || ', over the {CAP / 60:.1f}m limit'
  WHEN 'unreliable' THEN 'starts a new trip - '
    || CASE WHEN NOT prev_ok THEN prev_id || '''s' ELSE 'its own' END || ' timestamp is not reliable'
  WHEN 'gap' THEN 'starts a new trip - gap since ' || prev_id || ' was ' || g
    || ', over the {LIMIT} limit, and no movement bridged it'
  ELSE 'continues the trip - gap since ' || prev_id || ' was ' || g || ', within the {LIMIT} limit'
  END AS reason
FROM (SELECT *, CASE WHEN gap_s < 0 THEN printf('%.1f', -gap_s::DOUBLE)
   || 's before the previous recording ended (overlap or disorder)'
   ELSE printf('%.1f', gap_s::DOUBLE) || 's' END AS g FROM capped)
""")
def split_reasons(t):
    found = trips.detect(recordings(t), max_gap_s=GAP, parking_cap_s=CAP)
    said = trips.explain(found, max_gap_s=GAP, parking_cap_s=CAP)
    return said.select("camera_id", "recording_key", "reason")


SQL_STAMP = "strftime(make_timestamp(({0}) * 1000000), '%Y%m%d_%H%M%S')"


@query("trips_roll_up", f"""
WITH {SQL_RECORDINGS}, {SQL_MARKS},
roll AS (
  SELECT camera_id, min(start_s) AS start_s,
    arg_max(start_s + coalesce(duration_s, 0), (start_s, recording_key)) AS end_s,
    count(*) AS recordings, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
    bool_or(kind = 'P') AS has_parking
  FROM numbered GROUP BY camera_id, trip_no)
SELECT *, end_s - start_s AS duration_s, 'trip_' || {SQL_STAMP.format('start_s')} || '_'
  || {SQL_STAMP.format('end_s')} AS label FROM roll
""")
def roll_up(t):
    return trips.roll_up(trips.detect(recordings(t), max_gap_s=GAP)).drop(
        "trip_start_s", "trip_start_key"
    )


@query("trips_content_bounds", f"""
WITH {SQL_RECORDINGS}, {SQL_MARKS},
cut AS (
  SELECT camera_id, min(start_s) AS trip_start_s,
    coalesce(min(start_s) FILTER (kind <> 'P'), min(start_s)) AS content_start_s,
    coalesce(arg_max(start_s + coalesce(duration_s, 0), (start_s, recording_key)) FILTER (kind <> 'P'),
      arg_max(start_s + coalesce(duration_s, 0), (start_s, recording_key))) AS content_end_s
  FROM numbered GROUP BY camera_id, trip_no)
SELECT *, 'van_trip_' || {SQL_STAMP.format('content_start_s')} || '_'
  || {SQL_STAMP.format('content_end_s')} AS folder FROM cut
""")
def content_bounds(t):
    found = trips.detect(recordings(t), max_gap_s=GAP)
    return trips.content_bounds(found, prefix="van").drop("trip_start_key")


SPAN = ids.interval(since="20240110", until="20240112")


@query("trips_touching_interval", f"""
WITH {SQL_RECORDINGS}, {SQL_MARKS},
hit AS (SELECT DISTINCT camera_id, trip_no FROM numbered
  WHERE recording_id[1:15] BETWEEN '{SPAN.first}' AND '{SPAN.last}')
SELECT camera_id, recording_key, rule FROM numbered SEMI JOIN hit USING (camera_id, trip_no)
""")
def touching_interval(t):
    found = trips.detect(recordings(t), max_gap_s=GAP)
    return trips.touching(found, SPAN).select("camera_id", "recording_key", "rule")


@query("trips_touching_interval_pruned", f"""
WITH {SQL_RECORDINGS}, {SQL_PLAIN},
hit AS (SELECT DISTINCT camera_id, trip_no FROM numbered
  WHERE recording_id[1:15] BETWEEN '{SPAN.first}' AND '{SPAN.last}')
SELECT camera_id, recording_key FROM numbered SEMI JOIN hit USING (camera_id, trip_no)
""")
def touching_interval_pruned(t):
    """From a table partitioned by date, of which only the days of these trips are read."""
    table, zones = dated_table(t)
    return trips.detect_zoned(table, zones, SPAN, max_gap_s=GAP).select("camera_id", "recording_key")


def dated_table(t):
    """Recordings written by date, and their zones, as an archive keeps them."""
    dated = _reliable(recordings(t)).select(*trips.NEEDED, "camera_id", F.substring("recording_id", 1, 8).alias("date"))
    place = scratch_path(t.spark, "by-date")
    dated.repartition("date").write.partitionBy("date").parquet(place)
    table = t.spark.read.schema(dated.schema).parquet(place)
    return table, settle(trips.day_zones(table), "day-zones")


@query("recordings_before_events", f"""
WITH {SQL_RECORDINGS}
SELECT camera_id, recording_key, kind IN ('E', 'M') OR coalesce(lead(kind) OVER
  (PARTITION BY camera_id ORDER BY start_s, recording_key) IN ('E', 'M'), false) AS with_video
FROM rec
""")
def before_events(t):
    return trips.before_events(recordings(t)).select("camera_id", "recording_key", "with_video")


@query("recordings_display_groups", f"""
WITH {SQL_RECORDINGS},
w AS (SELECT *, CASE WHEN lag(kind) OVER o = kind AND lag(has_gps) OVER o = has_gps THEN 0 ELSE 1 END AS n
  FROM rec WINDOW o AS (PARTITION BY camera_id ORDER BY start_s, recording_key)),
g AS (SELECT *, sum(n) OVER (PARTITION BY camera_id ORDER BY start_s, recording_key) AS group_no FROM w)
SELECT camera_id, CAST(group_no AS BIGINT) AS group_no, any_value(kind) AS kind,
  any_value(has_gps) AS has_gps, count(*) AS recordings, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  CASE WHEN count(*) = 1 THEN min(recording_id)
    ELSE arg_min(recording_id, (start_s, recording_key)) || '..'
      || arg_max(recording_id, (start_s, recording_key)) END AS label
FROM g GROUP BY camera_id, group_no
""")
def display_groups(t):
    return trips.display_groups(recordings(t), ("kind", "has_gps")).drop("first_id", "last_id")


@query("recordings_real_elapsed", """
SELECT event_id AS recording_key, CASE WHEN event_id % 10 = 0 THEN 5
  WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT)
  ELSE CAST(round_even(CASE WHEN event_type = 'error' THEN value * 30 ELSE value END, 0) AS BIGINT)
  END AS elapsed_s FROM events
""")
def real_elapsed(t):
    e = F.col("event_id")
    return t.events.select(
        e.alias("recording_key"),
        trips.real_elapsed_s(
            F.when(F.col("event_type") == "error", "P").otherwise("N"),
            F.col("value"), F.lit(30),
            F.when(e % 4 != 0, F.floor("value")), e % 10 == 0,
        ).alias("elapsed_s"),
    )


EDGE = 2 * HOUR
SQL_GPS_EDGES = f"""
ok AS (SELECT * FROM fix WHERE valid AND speed_kmh IS NOT NULL),
lim AS (SELECT camera_id, recording_id, arg_min(ts_us, pos) AS a, arg_max(ts_us, pos) AS b
  FROM ok GROUP BY ALL),
gps AS (SELECT camera_id, recording_id,
  bool_or(speed_kmh >= 30) FILTER (ts_us <= a + {EDGE * 1000000}) AS gps_start,
  bool_or(speed_kmh >= 30) FILTER (ts_us >= b - {EDGE * 1000000}) AS gps_end
  FROM ok JOIN lim USING (camera_id, recording_id) GROUP BY ALL)
"""


@query("movement_gps_edges", f"WITH {SQL_FIXES}, {SQL_GPS_EDGES} SELECT * FROM gps")
def gps_edges(t):
    return movement.gps_edges(fixes(t), edge_s=EDGE, moving_kmh=30)


SQL_VARIANCE = f"""
mag AS (SELECT *, sqrt(CAST(x * x + y * y + z * z AS DOUBLE)) AS m FROM smp),
one AS (SELECT camera_id, recording_id, arg_min(offset_ms, pos) AS a, arg_max(offset_ms, pos) AS b
  FROM mag GROUP BY ALL),
win AS (SELECT camera_id, recording_id, (offset_ms - a) // {EDGE * 1000} AS window_no,
  count(*) AS samples, var_pop(m) AS variance
  FROM mag JOIN one USING (camera_id, recording_id) GROUP BY ALL HAVING count(*) >= 2)
"""


@query("gsensor_window_variance", f"""
WITH {SQL_DAY_SAMPLES}, {SQL_VARIANCE}
SELECT camera_id, recording_id, window_no, samples, round(variance, 3) AS variance FROM win
""")
def window_variance(t):
    out = movement.window_variances(day_samples(t), window_s=EDGE)
    return out.withColumn("variance", F.round("variance", 3))


SQL_GSENSOR_EDGES = f"""
{SQL_VARIANCE},
base AS (SELECT camera_id, recording_id, min(variance) AS baseline FROM win GROUP BY ALL),
edge AS (SELECT camera_id, recording_id,
  var_pop(m) FILTER (offset_ms <= a + {EDGE * 1000}) AS vs, count(*) FILTER (offset_ms <= a + {EDGE * 1000}) AS ns,
  var_pop(m) FILTER (offset_ms >= b - {EDGE * 1000}) AS ve, count(*) FILTER (offset_ms >= b - {EDGE * 1000}) AS ne
  FROM mag JOIN one USING (camera_id, recording_id) GROUP BY ALL),
acc AS (SELECT camera_id, recording_id,
  CASE WHEN ns >= 2 THEN CASE WHEN baseline = 0 THEN vs > 0 ELSE vs >= baseline * 3 END END AS gsensor_start,
  CASE WHEN ne >= 2 THEN CASE WHEN baseline = 0 THEN ve > 0 ELSE ve >= baseline * 3 END END AS gsensor_end
  FROM edge JOIN base USING (camera_id, recording_id))
"""


@query("movement_gsensor_edges",
       f"WITH {SQL_DAY_SAMPLES}, {SQL_GSENSOR_EDGES} SELECT * FROM acc")
def gsensor_edges(t):
    return movement.gsensor_edges(day_samples(t), edge_s=EDGE)


SQL_SPANS = """
span AS (SELECT camera_id, recording_id, min(ts_us) AS a_us, arg_min(lat, pos) AS a_lat,
  arg_min(lon, pos) AS a_lon, arg_max(ts_us, pos) AS b_us, arg_max(lat, pos) AS b_lat,
  arg_max(lon, pos) AS b_lon
  FROM fix WHERE valid AND lat IS NOT NULL GROUP BY ALL)
"""
SQL_SPANS = SQL_SPANS.replace("min(ts_us)", "arg_min(ts_us, pos)")

DAY_GAP = 10 * HOUR
# the CASE keeps NULL points NULL, least() alone would skip them
SQL_HAVERSINE = """CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL AND {2} IS NOT NULL AND {3} IS NOT NULL THEN
  2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2}))
  * pow(sin((radians({3}) - radians({1})) / 2), 2)))) END"""


@query("trips_movement_bridge", f"""
WITH {SQL_FIXES}, {SQL_DAY_SAMPLES}, {SQL_DAY_RECORDINGS}, {SQL_GPS_EDGES}, {SQL_GSENSOR_EDGES},
near AS (
  SELECT *, start_s - lag(start_s + duration_s) OVER w AS gap_s, lag(recording_id) OVER w AS prev_id
  FROM day WINDOW w AS (PARTITION BY camera_id ORDER BY start_s, recording_key)),
flags AS (
  SELECT n.*, e.gps_end AS p_gps, f.gsensor_end AS p_acc, g.gps_start, h.gsensor_start
  FROM near n LEFT JOIN gps e ON e.camera_id = n.camera_id AND e.recording_id = n.prev_id
  LEFT JOIN acc f ON f.camera_id = n.camera_id AND f.recording_id = n.prev_id
  LEFT JOIN gps g ON g.camera_id = n.camera_id AND g.recording_id = n.recording_id
  LEFT JOIN acc h ON h.camera_id = n.camera_id AND h.recording_id = n.recording_id),
why AS (
  SELECT *, CASE WHEN gap_s > {DAY_GAP + 10} THEN CASE
    WHEN p_gps THEN 'GPS speed at or above 30 km/h near the end of ' || prev_id
    WHEN p_acc THEN 'g-sensor variance over its quiet baseline near the end of ' || prev_id
    WHEN gps_start THEN 'GPS speed at or above 30 km/h near the start of ' || recording_id
    WHEN gsensor_start THEN 'g-sensor variance over its quiet baseline near the start of ' || recording_id
    END END AS bridge_reason FROM flags),
marks AS (SELECT *, CASE WHEN prev_id IS NULL THEN 'first'
  WHEN gap_s > {DAY_GAP + 10} AND bridge_reason IS NULL THEN 'gap'
  WHEN gap_s > {DAY_GAP + 10} THEN 'bridged' ELSE 'within' END AS rule FROM why)
SELECT camera_id, recording_id, rule, bridge_reason,
  CAST(sum(CASE WHEN rule IN ('first', 'gap') THEN 1 ELSE 0 END) OVER
    (PARTITION BY camera_id ORDER BY start_s, recording_key) AS BIGINT) AS trip_no FROM marks
""")
def movement_bridge(t):
    known = movement.with_edges(
        day_recordings(t), fixes(t), day_samples(t), max_gap_s=DAY_GAP, edge_s=EDGE, moving_kmh=30
    )
    found = trips.detect(
        known, max_gap_s=DAY_GAP, bridge=movement.bridge_rule(30), extra=movement.EDGE_COLUMNS,
        chunk_s=7 * 24 * HOUR,
    )
    return found.select("camera_id", "recording_id", "rule", "bridge_reason", "trip_no")


@query("recordings_gps_span", f"""
WITH {SQL_FIXES}, {SQL_SPANS},
tag AS (SELECT DISTINCT camera_id, recording_id FROM fix)
SELECT camera_id, recording_id, coalesce(a_lat, 58.5) AS start_lat, coalesce(a_lon, 17.5) AS start_lon,
  coalesce(b_lat, 58.5) AS end_lat, coalesce(b_lon, 17.5) AS end_lon
FROM tag LEFT JOIN span USING (camera_id, recording_id)
""")
def gps_span(t):
    tags = day_recordings(t).select(
        *movement.RECORDING, (F.col("start_s") * 1000000).alias("tag_ts_us"),
        F.lit(58.5).alias("tag_lat"), F.lit(17.5).alias("tag_lon"),
    )
    return movement.gps_span(fixes(t), tags).select(
        *movement.RECORDING,
        F.col("start_fix.lat").alias("start_lat"), F.col("start_fix.lon").alias("start_lon"),
        F.col("end_fix.lat").alias("end_lat"), F.col("end_fix.lon").alias("end_lon"),
    )


JUMP_KMH = 1.5


@query("trips_impossible_jump", f"""
WITH {SQL_FIXES}, {SQL_DAY_RECORDINGS}, {SQL_SPANS},
near AS (
  SELECT d.*, start_s - lag(start_s + duration_s) OVER w AS gap_s, lag(d.recording_id) OVER w AS prev_id,
    a_us, a_lat, a_lon, lag(b_us) OVER w AS p_us, lag(b_lat) OVER w AS p_lat, lag(b_lon) OVER w AS p_lon
  FROM day d LEFT JOIN span USING (camera_id, recording_id)
  WINDOW w AS (PARTITION BY d.camera_id ORDER BY start_s, d.recording_key)),
speed AS (SELECT *, (a_us - p_us) / 1000000.0 AS el,
  (({SQL_HAVERSINE.format('p_lat', 'p_lon', 'a_lat', 'a_lon')}) / 1000) / ((a_us - p_us) / 1000000.0 / 3600) AS kmh
  FROM near),
marks AS (SELECT *, CASE WHEN prev_id IS NULL THEN 'first'
  WHEN el >= 60 AND kmh > {JUMP_KMH} THEN 'force' WHEN gap_s > {DAY_GAP + 10} THEN 'gap'
  ELSE 'within' END AS rule FROM speed)
SELECT camera_id, recording_id, rule, CASE WHEN el >= 60 AND kmh > {JUMP_KMH} THEN
   'implied speed of ' || CAST(round_even(kmh, 0) AS BIGINT) || ' km/h between ' || prev_id || ' and '
   || recording_id || ' is over {JUMP_KMH:g} km/h' END AS force_reason FROM marks
""")
def impossible_jump(t):
    spans = movement.gps_span(fixes(t))
    found = trips.detect(
        day_recordings(t).join(spans, movement.RECORDING, "left"), max_gap_s=DAY_GAP,
        force_split=movement.jump_rule(JUMP_KMH), extra=("start_fix", "end_fix"),
        chunk_s=7 * 24 * HOUR,
    )
    return found.select("camera_id", "recording_id", "rule", "force_reason")

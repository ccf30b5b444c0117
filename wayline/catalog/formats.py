"""File format readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..operators import trajectory, trips
from ..session import scratch_path
from ..sinks import tables, tracks
from ..sources import camera_files, logs, registry, telemetry_files
from .archive import _history_lines
from .bindings import HOUR, SQL_FIXES, SQL_RECORDINGS, fixes, recordings
from .registry import query
from .trajectory import SQL_SEGMENTS, r
from .trips import SQL_HAVERSINE


def _nmea(t):
    """A small GPS log per event: position, altitude twice, a broken and a mode-less sentence."""
    e = F.col("event_id")
    ms = F.floor(clock.epoch_us("ts") / 1000).cast("bigint").cast("string")
    minutes = e * 37 % 6000 / 100
    lat = F.format_string("59%07.4f", minutes)
    lon = F.format_string("018%07.4f", e * 91 % 6000 / 100)
    knots = F.when(e % 5 == 0, F.lit("")).otherwise(F.format_string("%.2f", F.col("value")))
    bracket = F.concat(F.lit("["), ms, F.lit("]"))

    def gga(h):
        return F.concat(bracket, F.lit("$GPGGA,120000.00,,,,,1,08,1.0,"), h, F.lit(",M,,M,,*5B\r\n"))

    rmc = F.concat(
        bracket, F.lit("$GPRMC,120000.00,V,"), lat, F.lit(","), F.when(e % 2 == 0, "N").otherwise("S"), F.lit(","), lon,
        F.lit(",W,"), knots, F.lit(",,010124,,,"), F.when(e % 11 == 0, "N").when(e % 11 == 1, "").otherwise("A"), F.lit("*6D\r\n"),
    )
    text = F.concat(
        gga((e % 50).cast("string")), rmc, gga((e % 70).cast("string")), gga(F.lit("high")),
        bracket, F.lit("$GPRMC,120000.00,A,59,N,018,E,x,,010124,,,A*6D\r\n"),
        bracket, F.lit("$GPRMC,short*00\r\n[7]$GPVTG,ignored*00\r\n"),
        F.lit("[5000]$GPRMC,120000.00,A,,,,,,12.5,010124,,,A*6D\r\n"),
    )
    return t.events.select("event_id", text.alias("text"))


@query("gps_log_parsed", """
WITH e AS (SELECT *, epoch_us(ts) // 1000 * 1000 AS us FROM events)
SELECT event_id, 0::BIGINT AS pos, make_timestamp(us) AS ts, event_id % 11 <> 0 AS valid,
  round(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (59 + round(event_id * 37 % 6000 / 100.0::DOUBLE, 4) / 60), 8) AS lat,
  round(-(18 + round(event_id * 91 % 6000 / 100.0::DOUBLE, 4) / 60), 8) AS lon,
  CASE WHEN event_id % 5 <> 0 THEN round(value * 1.852::DOUBLE, 6) END AS speed_kmh, NULL::DOUBLE AS course, CAST(event_id % 70 AS DOUBLE) AS altitude_m FROM e
UNION ALL SELECT event_id, 1::BIGINT, make_timestamp(5000000), true, NULL, NULL, NULL, 12.5, NULL FROM e
""")
def gps_log_parsed(t):
    out = telemetry_files.gps_fixes(_nmea(t)).drop("ts_us")
    return r(r(out, 8, "lat", "lon"), 6, "speed_kmh")


@query("adapter_gps_fixes", """
WITH e AS (SELECT *, epoch_us(ts) // 1000 * 1000 AS us, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m') ORDER BY event_id) - 1 AS nth,
  last_value(event_id % 70) OVER (PARTITION BY user_id, strftime(ts, '%Y%m'), epoch_us(ts) // 1000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS h FROM events)
SELECT CAST(user_id AS VARCHAR) AS camera_id, strftime(ts, '%Y%m') AS recording_id, 2 * nth AS pos, make_timestamp(us) AS ts, event_id % 11 <> 0 AS valid,
  round(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (59 + round(event_id * 37 % 6000 / 100.0::DOUBLE, 4) / 60), 8) AS lat,
  round(-(18 + round(event_id * 91 % 6000 / 100.0::DOUBLE, 4) / 60), 8) AS lon,
  CASE WHEN event_id % 5 <> 0 THEN round(value * 1.852::DOUBLE, 6) END AS speed_kmh, NULL::DOUBLE AS course, CAST(h AS DOUBLE) AS altitude_m FROM e
UNION ALL SELECT CAST(user_id AS VARCHAR), strftime(ts, '%Y%m'), 2 * nth + 1, make_timestamp(5000000), true, NULL, NULL, NULL, 12.5, NULL FROM e
""")
def adapter_gps_fixes(t):
    """One log file a camera and month, written and read back through the adapter's data source."""
    logs = _nmea(t).join(t.events.select("event_id", "user_id", F.date_format("ts", "yyyyMM").alias("month")), "event_id")
    files = logs.groupBy(F.col("user_id").alias("camera_id"), F.col("month").alias("recording_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"]), "").alias("content")
    )
    root = scratch_path(t.spark, "cameras")
    camera_files.write_files(files, root, ".gps")
    out = registry.gps_logs(t.spark, root).drop("ts_us")
    return r(r(out, 8, "lat", "lon"), 6, "speed_kmh")


@query("gsensor_file_parsed", """
SELECT vec_id, k AS pos, 70000 + k * 100 AS offset_ms,
  CAST(floor(CAST(embedding[k + 1] AS DOUBLE) * 3000) AS INTEGER) AS x, CAST(-k AS INTEGER) AS y, CAST(vec_id % 30000 AS INTEGER) AS z
FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings WHERE vec_id % 9 <> 4)
""")
def gsensor_file_parsed(t):
    """Byte records built from the vectors; every ninth file lost its last byte."""

    def hexa(value, digits: int):
        return F.substring(F.concat(F.lit("0" * digits), F.hex(value.cast("bigint"))), -digits, digits)

    v = F.col("vec_id")
    record = F.transform(
        "embedding",
        lambda x, i: F.concat(
            hexa(70000 + i * 100, 8), hexa(F.floor(x.cast("double") * 3000), 4), hexa(-i, 4), hexa(v % 30000, 4)
        ),
    )
    raw = F.array_join(record, "")
    files = t.embeddings.select("vec_id", raw.alias("h")).select(
        "vec_id", F.unhex(F.when(v % 9 == 4, F.expr("left(h, length(h) - 2)")).otherwise(F.col("h"))).alias("content")
    )
    return telemetry_files.gsensor_samples(files)


SQL_POINT = """
pt AS (SELECT *, '      <trkpt lat="' || lat || '" lon="' || lon || '">' || chr(10) || '        <time>' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z</time>' || chr(10)
  || CASE WHEN speed_kmh IS NULL AND course IS NULL THEN '' ELSE '        <extensions>' || chr(10)
    || CASE WHEN speed_kmh IS NULL THEN '' ELSE '          <speed>' || speed_kmh / 3.6::DOUBLE || '</speed>' || chr(10) END
    || CASE WHEN course IS NULL THEN '' ELSE '          <course>' || course || '</course>' || chr(10) END
    || '        </extensions>' || chr(10) END || '      </trkpt>' AS x FROM fix WHERE valid AND lat IS NOT NULL),
tr AS (SELECT DISTINCT camera_id FROM fix)
"""


def _named(t):
    return t.events.select(F.col("user_id").alias("camera_id")).distinct().withColumn(
        "name", F.concat(F.lit("a<b & "), F.col("camera_id").cast("string"))
    )


@query("gpx_documents", f"""
WITH {SQL_FIXES}, {SQL_POINT}
SELECT camera_id, 0 AS part, 0 AS pos, '<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10)
  || '<gpx xmlns="{tracks.GPX_NS}" version="1.1" creator="{tracks.CREATOR}">' || chr(10) || '  <trk>' || chr(10)
  || '    <name>a&lt;b &amp; ' || camera_id || '</name>' || chr(10) || '    <trkseg>' AS text FROM tr
UNION ALL SELECT camera_id, 1, pos, x FROM pt
UNION ALL SELECT camera_id, 2, 0, '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' FROM tr
""")
def gpx_documents(t):
    return tracks.gpx_pieces(fixes(t), _named(t), ["camera_id"]).select("camera_id", "part", "pos", "text")


@query("kml_documents", f"""
WITH {SQL_FIXES},
ok AS (SELECT * FROM fix WHERE valid AND lat IS NOT NULL),
p AS (SELECT camera_id, arg_min(lon, (ts_us, pos)) AS x, arg_min(lat, (ts_us, pos)) AS y FROM ok GROUP BY 1),
nm AS (SELECT *, 'a&lt;b &amp; ' || camera_id AS n FROM p)
SELECT camera_id, 0 AS part, 0 AS pos, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<kml xmlns="{tracks.KML_NS}">' || chr(10)
  || '  <Document>' || chr(10) || '    <name>' || n || '</name>' || chr(10) || '    <Style id="track">' || chr(10) || '      <LineStyle>' || chr(10)
  || '        <color>ff0000ff</color>' || chr(10) || '        <width>4</width>' || chr(10) || '      </LineStyle>' || chr(10) || '    </Style>' || chr(10)
  || '    <Placemark>' || chr(10) || '      <name>Start</name>' || chr(10) || '      <Point>' || chr(10) || '        <coordinates>' || x || ',' || y
  || '</coordinates>' || chr(10) || '      </Point>' || chr(10) || '    </Placemark>' || chr(10) || '    <Placemark>' || chr(10) || '      <name>' || n
  || '</name>' || chr(10) || '      <styleUrl>#track</styleUrl>' || chr(10) || '      <LineString>' || chr(10) || '        <tessellate>1</tessellate>' || chr(10)
  || '        <coordinates>' AS text FROM nm
UNION ALL SELECT camera_id, 1, pos, lon || ',' || lat FROM ok
UNION ALL SELECT camera_id, 2, 0, '</coordinates>' || chr(10) || '      </LineString>' || chr(10) || '    </Placemark>' || chr(10) || '  </Document>' || chr(10) || '</kml>' FROM p
""")
def kml_documents(t):
    return tracks.kml_pieces(fixes(t), _named(t), ["camera_id"]).select("camera_id", "part", "pos", "text")


SQL_CLOCK = """CASE WHEN {0} < 86400 THEN '' WHEN {0} < 172800 THEN '1 day, ' ELSE {0} // 86400 || ' days, ' END
  || printf('%d:%02d:%02d', {0} // 3600 % 24, {0} // 60 % 60, {0} % 60)"""


@query("trip_info_texts", f"""
WITH {SQL_SEGMENTS}, {SQL_RECORDINGS},
d AS (SELECT camera_id, min(start_ts) AS a, max(start_ts) AS b, max(start_s) - min(start_s) AS el, bool_or(kind = 'P') AS park,
  CAST(sum(size_bytes) AS BIGINT) AS bytes FROM rec GROUP BY 1),
s AS (SELECT camera_id, max(speed_kmh) AS v, min(altitude_m) AS lo, max(altitude_m) AS hi,
  round(sum({SQL_HAVERSINE.format('plat', 'plon', 'lat', 'lon')}) / 1000, 6) AS km, round(avg(speed_kmh), 6) AS mean,
  CAST(round_even(round(sum(CASE WHEN pace >= 5 THEN el WHEN pace IS NOT NULL THEN 0 END), 6), 0) AS BIGINT) AS moving,
  CAST(round_even(round(sum(CASE WHEN pace < 5 THEN el WHEN pace IS NOT NULL THEN 0 END), 6), 0) AS BIGINT) AS idle,
  sum(CASE WHEN altitude_m IS NOT NULL AND palt IS NOT NULL THEN greatest(altitude_m - palt, 0) END) AS gain
  FROM seg GROUP BY 1 HAVING count(*) >= 2)
SELECT camera_id, 'Started: ' || strftime(a, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Ended: ' || strftime(b, '%Y-%m-%d %H:%M:%S') || chr(10)
  || 'Duration: ' || {SQL_CLOCK.format('el')} || chr(10)
  || coalesce('Distance: ' || printf('%.2f', round_even(km, 2)) || ' km' || chr(10), '')
  || coalesce('Average speed: ' || printf('%.1f', round_even(mean, 1)) || ' km/h' || chr(10), '')
  || coalesce('Max speed: ' || printf('%.1f', round_even(v, 1)) || ' km/h' || chr(10), '')
  || coalesce('Moving time: ' || {SQL_CLOCK.format('moving')} || chr(10), '')
  || coalesce('Idle time: ' || {SQL_CLOCK.format('idle')} || chr(10), '')
  || coalesce('Elevation: ' || printf('%.0f', lo) || ' m to ' || printf('%.0f', hi) || ' m' || chr(10), '')
  || coalesce('Elevation gain: ' || printf('%.0f', round_even(gain, 0)) || ' m' || chr(10), '')
  || CASE WHEN camera_id % 2 = 0 THEN 'Start location: Here' || chr(10) ELSE '' END
  || CASE WHEN camera_id % 3 = 0 THEN 'End location: There' || chr(10) ELSE '' END
  || CASE WHEN park THEN 'Includes Parking-mode footage' || chr(10) ELSE '' END
  || 'Total size: ' || CASE WHEN bytes < 1048576 THEN printf('%.2f KB', round_even(bytes / 1024.0::DOUBLE, 2)) ELSE printf('%.2f MB', round_even(bytes / 1048576.0::DOUBLE, 2)) END
  || chr(10) AS text
FROM d LEFT JOIN s USING (camera_id)
""")
def trip_info_texts(t):
    """All lines of the short summary; the places are known for some cameras only."""
    days = recordings(t).groupBy("camera_id").agg(
        F.min("start_s").alias("a"), F.max("start_s").alias("b"), F.bool_or(F.col("kind") == "P").alias("has_parking"),
        F.sum("size_bytes").alias("size_bytes"),
    )
    stats = trajectory.trip_stats(fixes(t), ["camera_id"], chunk_us=24 * HOUR * 1000000)
    # sums of doubles differ in their last digits with the order of their rows
    stats = r(stats, 6, "distance_km", "average_speed_kmh", "moving_seconds", "idle_seconds")

    def text(c):
        return F.substring(clock.from_epoch_us(F.col(c) * 1000000).cast("string"), 1, 19)

    out = days.join(stats, "camera_id", "left").select(
        "*", text("a").alias("start_text"), text("b").alias("end_text"), (F.col("b") - F.col("a")).alias("duration_s"),
        F.when(F.col("camera_id") % 2 == 0, "Here").alias("start_address"), F.when(F.col("camera_id") % 3 == 0, "There").otherwise("").alias("end_address"),
    )
    return tables.trip_info(out).select("camera_id", "text")


@query("history_appended", """
SELECT user_id AS stream, event_type AS command, value AS duration_seconds, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k
FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0
UNION ALL SELECT user_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END
FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0
""")
def history_appended(t):
    """Entries written twice to one history, then read back."""
    path = scratch_path(t.spark, "history")
    entries = logs.history(_history_lines(t)).withColumn("username", F.col("stream").cast("string"))
    tables.append_history(entries, path)
    tables.append_history(entries, path)
    return logs.history(t.spark.read.text(path)).select(
        F.col("username").cast("bigint").alias("stream"), "command", "duration_seconds",
        F.try_element_at("params", F.lit("k")).alias("k"),
    )


@query("derived_table_written", f"""
WITH {SQL_RECORDINGS} SELECT camera_id, recording_key, recording_id[1:8] AS date FROM rec
""")
def derived_table(t):
    """Trips written by camera and date; everything is read back."""
    return _trips_read_back(t)


@query("derived_table_pruned", f"""
WITH {SQL_RECORDINGS} SELECT camera_id, recording_key, recording_id[1:8] AS date FROM rec WHERE recording_id[1:8] BETWEEN '20240110' AND '20240120'
""")
def derived_table_pruned(t):
    """The same table, read for a range of dates: only their folders are opened."""
    return _trips_read_back(t).filter("date BETWEEN '20240110' AND '20240120'")


def _trips_read_back(t):
    path = scratch_path(t.spark, "trips")
    found = trips.detect(recordings(t), max_gap_s=6 * HOUR).select(
        "camera_id", "recording_key", "start_s", "trip_no", F.substring("recording_id", 1, 8).alias("date")
    )
    tables.write_table(found, path, ["start_s", "recording_key"], ["date"])
    back = t.spark.read.schema("camera_id BIGINT, recording_key BIGINT, start_s BIGINT, trip_no BIGINT, date STRING").parquet(path)
    return back.select("camera_id", "recording_key", "date")

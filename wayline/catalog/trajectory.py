"""Trajectory and g-sensor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import gsensor, movement, trajectory
from .bindings import HOUR, SQL_FIXES, SQL_SAMPLES, fixes, samples
from .registry import query
from .trips import SQL_HAVERSINE

CAMERA = ["camera_id"]
DAY_CHUNK = 86400 * 1_000_000


def r(df, places: int, *names: str):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("fixes_positioned", f"""
WITH {SQL_FIXES}
SELECT pos, valid AND lat IS NOT NULL AND lon IS NOT NULL AS positioned, NOT (lat = 0 AND lon = 0) AS live_fix
FROM fix
""")
def positioned(t):
    return fixes(t).select(
        "pos", movement.positioned().alias("positioned"),
        movement.live_fix(F.col("lat"), F.col("lon")).alias("live_fix"),
    )


SQL_SEGMENTS = f"""{SQL_FIXES},
ok AS (SELECT *, last_value(speed_kmh IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY ts_us, pos) AS eff
  FROM fix WHERE valid AND lat IS NOT NULL),
step AS (SELECT *, lag(eff) OVER w AS peff, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
  lag(ts_us) OVER w AS pts, lag(altitude_m) OVER w AS palt
  FROM ok WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, pos)),
seg AS (SELECT *, (ts_us - pts) / 1000000.0::DOUBLE AS el,
  CASE WHEN pts IS NOT NULL THEN coalesce((eff + peff) / 2, eff, peff) END AS pace FROM step)"""


@query("trip_statistics", f"""
WITH {SQL_SEGMENTS}
SELECT camera_id, count(*) AS fixes,
  round(sum(({SQL_HAVERSINE.format('plat', 'plon', 'lat', 'lon')})) / 1000, 6) AS distance_km,
  round(avg(speed_kmh), 6) AS average_speed_kmh, round(max(speed_kmh), 6) AS max_speed_kmh,
  round(sum(CASE WHEN pace >= 5 THEN el WHEN pace IS NOT NULL THEN 0 END), 3) AS moving_seconds,
  round(sum(CASE WHEN pace < 5 THEN el WHEN pace IS NOT NULL THEN 0 END), 3) AS idle_seconds,
  min(altitude_m) AS min_altitude_m, max(altitude_m) AS max_altitude_m,
  sum(CASE WHEN altitude_m IS NOT NULL AND palt IS NOT NULL THEN greatest(altitude_m - palt, 0) END) AS elevation_gain_m
FROM seg GROUP BY camera_id HAVING count(*) >= 2
""")
def trip_statistics(t):
    out = trajectory.trip_stats(fixes(t), CAMERA, chunk_us=DAY_CHUNK)
    out = r(out, 6, "distance_km", "average_speed_kmh", "max_speed_kmh")
    return r(out, 3, "moving_seconds", "idle_seconds")


@query("fixes_carried_speed", f"""
WITH {SQL_FIXES}
SELECT pos, round(last_value(speed_kmh IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY ts_us, pos), 6)
  AS known_speed_kmh FROM fix WHERE valid AND lat IS NOT NULL
""")
def carried_speed(t):
    out = trajectory.carried_speed(fixes(t), CAMERA, DAY_CHUNK)
    return r(out.select("pos", "known_speed_kmh"), 6, "known_speed_kmh")


AHEAD_US = 1800 * 1_000_000
SQL_BRACKET = f"""
ok AS (SELECT * FROM fix WHERE valid AND lat IS NOT NULL),
ask AS (SELECT camera_id, pos AS ask_id, ts_us + {AHEAD_US} AS at_us FROM fix
  UNION ALL SELECT camera_id, -pos - 1, ts_us FROM fix),
br AS (SELECT ask.*, a.ts_us AS a_us, a.lat AS a_lat, a.lon AS a_lon, a.speed_kmh AS a_v, a.course AS a_c,
    b.ts_us AS b_us, b.lat AS b_lat, b.lon AS b_lon, b.speed_kmh AS b_v, b.course AS b_c
  FROM ask ASOF LEFT JOIN ok a ON a.camera_id = ask.camera_id AND ask.at_us >= a.ts_us
  ASOF LEFT JOIN ok b ON b.camera_id = ask.camera_id AND ask.at_us < b.ts_us),
tt AS (SELECT *, a_us IS NOT NULL AND b_us IS NOT NULL AS inside, (at_us - a_us) / (b_us - a_us)::DOUBLE AS t FROM br)
"""


def _asked(t):
    f = fixes(t)
    later = f.select("camera_id", F.col("pos").alias("ask_id"), (F.col("ts_us") + AHEAD_US).alias("at_us"))
    return later.unionByName(
        f.select("camera_id", (-F.col("pos") - 1).alias("ask_id"), F.col("ts_us").alias("at_us"))
    )


@query("positions_interpolated", f"""
WITH {SQL_FIXES}, {SQL_BRACKET},
cv AS (SELECT *, (1 - t) * cos(radians(a_c)) + t * cos(radians(b_c)) AS cx,
  (1 - t) * sin(radians(a_c)) + t * sin(radians(b_c)) AS cy FROM tt),
cw AS (SELECT *, CASE WHEN cx = 0 AND cy = 0 THEN a_c ELSE degrees(atan2(cy, cx)) END AS cd FROM cv)
SELECT ask_id, camera_id, at_us,
  round(CASE WHEN inside THEN a_lat + (b_lat - a_lat) * t ELSE coalesce(a_lat, b_lat) END, 6) AS lat,
  round(CASE WHEN inside THEN a_lon + (b_lon - a_lon) * t ELSE coalesce(a_lon, b_lon) END, 6) AS lon,
  round(CASE WHEN inside THEN CASE WHEN a_v IS NOT NULL AND b_v IS NOT NULL THEN a_v + (b_v - a_v) * t
      WHEN a_v <> 0 THEN a_v ELSE b_v END
    WHEN a_us IS NOT NULL THEN a_v ELSE b_v END, 6) AS speed_kmh,
  round(CASE WHEN inside THEN CASE WHEN a_c IS NULL THEN b_c WHEN b_c IS NULL THEN a_c
      WHEN cd < 0 THEN cd + 360 ELSE cd END
    WHEN a_us IS NOT NULL THEN a_c ELSE b_c END, 4) % 360 AS course
FROM cw
""")
def interpolated(t):
    out = trajectory.interpolate_positions(_asked(t), fixes(t), CAMERA, DAY_CHUNK)
    out = r(out, 6, "lat", "lon", "speed_kmh")
    return out.withColumn("course", F.round("course", 4) % 360)


@query("positions_live_flag", f"""
WITH {SQL_FIXES}, {SQL_BRACKET}
SELECT ask_id, camera_id, at_us, coalesce(a_us = at_us, false) OR coalesce(b_us - a_us <= {6 * HOUR * 1000000}, false) AS live
FROM tt
""")
def live_flag(t):
    return trajectory.live_positions(
        _asked(t), fixes(t), CAMERA, max_gap_s=6 * HOUR, chunk_us=DAY_CHUNK
    )


SQL_BEARING = """((degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})),
  cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360) % 360)"""


@query("fixes_heading", f"""
WITH {SQL_FIXES},
g AS (SELECT * REPLACE (round(lat, 1) AS lat, round(lon, 1) AS lon) FROM fix WHERE valid AND lat IS NOT NULL),
p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM g
  WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, pos)),
c AS (SELECT *, CASE WHEN plat <> lat OR plon <> lon THEN plat END AS clat,
  CASE WHEN plat <> lat OR plon <> lon THEN plon END AS clon FROM p),
f AS (SELECT *, last_value(clat IGNORE NULLS) OVER w AS flat, last_value(clon IGNORE NULLS) OVER w AS flon
  FROM c WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, pos))
SELECT pos, round({SQL_BEARING.format('flat', 'flon', 'lat', 'lon')}, 4) % 360 AS heading FROM f
""")
def heading(t):
    coarse = r(fixes(t), 1, "lat", "lon")
    out = trajectory.headings(coarse, CAMERA, DAY_CHUNK)
    return out.select("pos", (F.round("heading", 4) % 360).alias("heading"))


SQL_BOX = """
bx AS (SELECT camera_id, recording_id, min(lat) - 0.01::DOUBLE AS a, min(lon) - 0.01::DOUBLE AS b,
  max(lat) + 0.01::DOUBLE AS c, max(lon) + 0.01::DOUBLE AS d
  FROM fix WHERE valid AND lat IS NOT NULL GROUP BY ALL),
sz AS (SELECT *, cos(radians((a + c) / 2)) AS k, (d - b) * cos(radians((a + c) / 2)) AS w, c - a AS h FROM bx)
"""


@query("trip_bounding_boxes", f"""
WITH {SQL_FIXES}, {SQL_BOX}
SELECT camera_id, recording_id,
  round(a - CASE WHEN w < h * 1.5 THEN 0 ELSE (w / 1.5 - h) / 2 END, 6) AS min_lat,
  round(b - CASE WHEN w < h * 1.5 THEN (h * 1.5 - w) / k / 2 ELSE 0 END, 6) AS min_lon,
  round(c + CASE WHEN w < h * 1.5 THEN 0 ELSE (w / 1.5 - h) / 2 END, 6) AS max_lat,
  round(d + CASE WHEN w < h * 1.5 THEN (h * 1.5 - w) / k / 2 ELSE 0 END, 6) AS max_lon
FROM sz
""")
def bounding_boxes(t):
    out = trajectory.trip_boxes(fixes(t), movement.RECORDING, aspect=1.5)
    return r(out.select(*movement.RECORDING, "bbox.*"), 6, "min_lat", "min_lon", "max_lat", "max_lon")


@query("trip_panel_layout", f"""
WITH {SQL_FIXES}, {SQL_BOX}
SELECT camera_id, recording_id, round(w / h, 6) AS ratio,
  CASE WHEN w / h >= 1 THEN 'side_by_side' ELSE 'top_down' END AS layout,
  CASE WHEN w / h < 1 THEN 'left' ELSE 'down' END AS mirror_map_side FROM sz
""")
def panel_layout(t):
    out = trajectory.layouts(trajectory.trip_boxes(fixes(t), movement.RECORDING)).drop("bbox")
    return r(out, 6, "ratio")


@query("boxes_around_fixes", f"""
WITH {SQL_FIXES},
o AS (SELECT pos, lat, lon, CASE WHEN altitude_m IS NOT NULL THEN greatest(altitude_m, 5) END AS rad, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
  FROM fix WHERE valid AND lat IS NOT NULL WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, pos)),
b AS (SELECT *, degrees(rad * 8 / 6371000.0::DOUBLE) AS dl, degrees(greatest(rad, 5) / 6371000.0::DOUBLE) AS ds FROM o
  WHERE rad IS NOT NULL AND nlat IS NOT NULL),
e AS (SELECT *, dl * 1.0 / cos(radians(lat)) AS dlo, ds / cos(radians(nlat)) AS dso FROM b)
SELECT pos, round(least(lat - dl, nlat - ds), 6) AS min_lat, round(greatest(lon + dlo, nlon + dso), 6) AS max_lon,
  lat - dl <= nlat - ds AND lat + dl >= nlat + ds AND lon - dlo <= nlon - dso AND lon + dlo >= nlon + dso AS covered,
  lat - dl <= nlat + ds AND lat + dl >= nlat - ds AND lon - dlo <= nlon + dso AND lon + dlo >= nlon - dso AS touched
FROM e
""")
def boxes_around(t):
    from ..plans.chunked import scan, spread

    ok = fixes(t).filter(movement.positioned())
    pairs = scan(
        ok, CAMERA, ["ts_us", "pos"], spread("ts_us", DAY_CHUNK),
        nxt={"nlat": F.col("lat"), "nlon": F.col("lon")},
    ).filter("altitude_m IS NOT NULL AND nlat IS NOT NULL")
    big = geo.box_around("lat", "lon", F.greatest(F.col("altitude_m"), F.lit(5.0)) * 8)
    small = geo.box_around("nlat", "nlon", F.col("altitude_m"))
    both = geo.box_union(big, small)
    out = pairs.select(
        "pos", both["min_lat"].alias("min_lat"), both["max_lon"].alias("max_lon"),
        geo.box_contains(big, small).alias("covered"), geo.box_overlaps(big, small).alias("touched"),
    )
    return r(out, 6, "min_lat", "max_lon")


SQL_TARGET = "59.05, 18.05"


@query("fixes_crop_box", f"""
WITH {SQL_FIXES},
d AS (SELECT pos, course, speed_kmh, {SQL_HAVERSINE.format('lat', 'lon', '59.05', '18.05')} AS m,
  {SQL_BEARING.format('lat', 'lon', '59.05', '18.05')} AS brg FROM fix WHERE valid AND lat IS NOT NULL),
q AS (SELECT *, ((brg - course + 180) % 360 + 360) % 360 - 180 AS rel,
  greatest(0.12::DOUBLE, least(0.9::DOUBLE, CASE WHEN m <= 0 THEN 0.9::DOUBLE ELSE 7.5 / m END)) AS w FROM d)
SELECT pos, round(m, 3) AS distance_m, round(brg, 4) % 360 AS bearing,
  CASE WHEN ok THEN round(greatest(w / 2, least(1 - w / 2, 0.5 + rel / 136)), 6) END AS crop_x,
  CASE WHEN ok THEN round(w, 6) END AS crop_width
FROM (SELECT *, course IS NOT NULL AND coalesce(speed_kmh >= 5, false) AND abs(rel) <= 68 AS ok FROM q)
""")
def crop_boxes(t):
    lat, lon = F.lit(59.05), F.lit(18.05)
    ok = fixes(t).filter(movement.positioned())
    away = geo.haversine_m("lat", "lon", lat, lon)
    crop = geo.crop_box("lat", "lon", "course", "speed_kmh", lat, lon, F.col("m"))
    out = ok.withColumn("m", away).withColumn("crop", crop)
    return out.select(
        "pos", F.round("m", 3).alias("distance_m"),
        (F.round(geo.bearing_deg("lat", "lon", lat, lon), 4) % 360).alias("bearing"),
        F.round("crop.x", 6).alias("crop_x"), F.round("crop.width", 6).alias("crop_width"),
    )


TRACK = ["recording_id"]


@query("gsensor_baselines", f"""
WITH {SQL_SAMPLES},
m AS (SELECT recording_id, CAST(median(x) AS DOUBLE) AS base_x, CAST(median(y) AS DOUBLE) AS base_y,
  CAST(median(z) AS DOUBLE) AS base_z FROM smp GROUP BY 1)
SELECT recording_id, any_value(base_x) AS base_x, any_value(base_y) AS base_y, any_value(base_z) AS base_z,
  round(greatest(max(abs(x - base_x)) * 1.2::DOUBLE, 1), 6) AS scale_x,
  round(greatest(max(abs(y - base_y)) * 1.2::DOUBLE, 1), 6) AS scale_y,
  round(greatest(max(abs(z - base_z)) * 1.2::DOUBLE, 1), 6) AS scale_z,
  greatest(max(greatest(abs(y - base_y), abs(z - base_z))), 1.0::DOUBLE) AS gauge_scale
FROM smp JOIN m USING (recording_id) GROUP BY recording_id
""")
def gsensor_baselines(t):
    return r(gsensor.baselines(samples(t), TRACK), 6, "scale_x", "scale_y", "scale_z")


@query("gsensor_smoothed", f"""
WITH {SQL_SAMPLES}
SELECT recording_id, pos, round(avg(x) OVER w, 6) AS x_smooth, round(avg(y) OVER w, 6) AS y_smooth,
  round(avg(z) OVER w, 6) AS z_smooth
FROM smp WINDOW w AS (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def gsensor_smoothed(t):
    out = gsensor.smoothed(samples(t), TRACK)
    names = ["x_smooth", "y_smooth", "z_smooth"]
    return r(out.select("recording_id", "pos", *names), 6, *names)


@query("gsensor_interpolated", f"""
WITH {SQL_SAMPLES},
ask AS (SELECT recording_id, offset_ms + 37 AS at_ms FROM smp),
br AS (SELECT ask.*, a.offset_ms AS ao, a.x AS ax, a.y AS ay, a.z AS az, b.offset_ms AS bo, b.x AS bx, b.y AS by_, b.z AS bz
  FROM ask ASOF LEFT JOIN smp a ON a.recording_id = ask.recording_id AND ask.at_ms >= a.offset_ms
  ASOF LEFT JOIN smp b ON b.recording_id = ask.recording_id AND ask.at_ms < b.offset_ms)
SELECT recording_id, at_ms,
  round(CASE WHEN bo IS NULL THEN ax ELSE ax + (bx - ax) * ((at_ms - ao) / (bo - ao)::DOUBLE) END, 6) AS x,
  round(CASE WHEN bo IS NULL THEN ay ELSE ay + (by_ - ay) * ((at_ms - ao) / (bo - ao)::DOUBLE) END, 6) AS y,
  round(CASE WHEN bo IS NULL THEN az ELSE az + (bz - az) * ((at_ms - ao) / (bo - ao)::DOUBLE) END, 6) AS z
FROM br
""")
def gsensor_interpolated(t):
    asked = samples(t).select("recording_id", (F.col("offset_ms") + 37).alias("at_ms"))
    return r(gsensor.interpolate_samples(asked, samples(t), TRACK), 6, "x", "y", "z")


@query("gsensor_head_trimmed", f"""
WITH {SQL_SAMPLES}
SELECT recording_id, pos, offset_ms - 1500 AS offset_ms, x, round(sqrt(CAST(x * x + y * y + z * z AS DOUBLE)), 6) AS magnitude
FROM smp WHERE offset_ms >= 1500
""")
def gsensor_trimmed(t):
    out = gsensor.trim_head(samples(t), 1500).withColumn("magnitude", movement.magnitude())
    return r(out.select("recording_id", "pos", "offset_ms", "x", "magnitude"), 6, "magnitude")


@query("gsensor_pages", f"""
WITH {SQL_SAMPLES},
e AS (SELECT recording_id, max(offset_ms) AS e FROM smp GROUP BY 1),
p AS (SELECT recording_id, e, unnest(range(0, e, 2000)) AS s FROM e WHERE e > 0)
SELECT p.recording_id, s // 2000 AS page, s AS start_ms, least(s + 2000, e) AS end_ms, count(*) AS samples
FROM p JOIN smp ON smp.recording_id = p.recording_id AND offset_ms BETWEEN s AND least(s + 2000, e)
GROUP BY ALL
""")
def gsensor_pages(t):
    table = gsensor.pages(samples(t), TRACK, 2000)
    placed = gsensor.on_pages(samples(t), table, TRACK, 2000)
    return placed.groupBy("recording_id", "page", "start_ms", "end_ms").agg(
        F.count(F.lit(1)).alias("samples")
    )


def _at(track: str, ms: str) -> str:
    """Value of a track of ten samples a second at a time in ms, between its ends."""
    return f"({track}[{ms} // 100 + 1] * (1 - {ms} % 100 / 100.0::DOUBLE) + coalesce({track}[{ms} // 100 + 2], 0) * ({ms} % 100 / 100.0::DOUBLE))"


@query("gsensor_overlap", f"""
WITH {SQL_SAMPLES},
cut AS (SELECT 'S' || vec_id AS recording_id, pos - (20 + vec_id % 14) AS pos, offset_ms - 100 * (20 + vec_id % 14) AS offset_ms, x, y, z, vec_id
  FROM smp WHERE pos >= 20 + vec_id % 14),
tr AS (SELECT recording_id, vec_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys, list(z ORDER BY pos) AS zs, max(offset_ms) AS e
  FROM (SELECT recording_id, pos, offset_ms, x, y, z, vec_id FROM smp UNION ALL SELECT * FROM cut) GROUP BY ALL),
pr AS (SELECT a.recording_id AS before_id, b.recording_id AS after_id, [a.xs, a.ys, a.zs] AS v, [b.xs, b.ys, b.zs] AS h, a.e AS ae, b.e AS be
  FROM tr a JOIN tr b ON a.recording_id[1] = 'V' AND (b.recording_id[1] = 'V' AND b.vec_id = a.vec_id + 1 OR b.recording_id[1] = 'S' AND b.vec_id = a.vec_id)),
ax AS (SELECT before_id, after_id, ae, axis, v[axis] AS v, h[axis] AS h,
    CAST(floor((least(12, ae / 1000.0::DOUBLE) - 3::DOUBLE) / 0.02::DOUBLE) AS INTEGER) AS last
  FROM pr, range(1, 4) r(axis) WHERE be >= 3000 AND least(12000, ae) > 3000),
hd AS (SELECT before_id, after_id, axis, j, {_at('h', '(20 * j)')} AS hv FROM ax, range(151) g(j)),
hs AS (SELECT before_id, after_id, axis, avg(hv) AS hm, stddev_pop(hv) AS hsd FROM hd GROUP BY ALL),
hn AS (SELECT before_id, after_id, axis, j, CASE WHEN hsd < 1e-9 THEN 0 ELSE (hv - hm) / hsd END AS hv FROM hd JOIN hs USING (before_id, after_id, axis)),
tl AS (SELECT before_id, after_id, axis, k, j, {_at('v', '(ae - 3000 - 20 * k + 20 * j)')} AS tv FROM ax, range(151) g(j), range(451) b(k) WHERE k <= last),
one AS (SELECT before_id, after_id, axis, k, CASE WHEN stddev_pop(tv) < 1e-9 THEN 0 ELSE sum(tv * hv) / stddev_pop(tv) END AS s
  FROM tl JOIN hn USING (before_id, after_id, axis, j) GROUP BY ALL),
sc AS (SELECT before_id, after_id, k, sum(s) / 453 AS s FROM one GROUP BY ALL),
best AS (SELECT before_id, after_id, arg_min(k, (-round(s, 9), k)) AS k, max(s) AS s FROM sc GROUP BY ALL)
SELECT before_id, after_id, CASE WHEN s > 0.75 THEN 3::DOUBLE + k * 0.02::DOUBLE END AS overlap_s FROM pr LEFT JOIN best USING (before_id, after_id)
""")
def gsensor_overlap(t):
    """Each track with the next one, which is unrelated, and with a copy of its own end, which overlaps."""
    own = samples(t)
    skip = 20 + F.col("vec_id") % 14
    cut = own.filter(F.col("pos") >= skip).withColumns(
        {"recording_id": F.concat(F.lit("S"), F.col("vec_id")), "pos": F.col("pos") - skip, "offset_ms": F.col("offset_ms") - 100 * skip}
    )
    ids = own.select("vec_id", "recording_id").distinct()
    follows = ids.select((F.col("vec_id") - 1).alias("vec_id"), F.col("recording_id").alias("after_id"))
    pairs = ids.withColumnRenamed("recording_id", "before_id").join(follows, "vec_id").drop("vec_id")
    ends = cut.select("vec_id", F.col("recording_id").alias("after_id")).distinct()
    pairs = pairs.unionByName(ids.withColumnRenamed("recording_id", "before_id").join(ends, "vec_id").drop("vec_id"))
    return gsensor.overlaps(pairs, own.unionByName(cut.select(*own.columns)))

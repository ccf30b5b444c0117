"""Domain tables derived from the given tables, in Spark and as SQL text.

The given tables hold no camera data, so each domain column is a fixed formula
over one of them. The SQL twins are written by hand for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from .registry import Tables

HOUR = 3600


def _int(value) -> Column:
    return F.col(value).cast("bigint")


def recordings(t: Tables) -> DataFrame:
    """One recording per event, one camera per user."""
    e = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "purchase", "E")
        .when(F.col("event_type") == "signup", "M")
        .when(F.col("event_type") == "error", "P")
        .otherwise("N")
    )
    whole = clock.from_epoch_us(F.floor(clock.epoch_us("ts") / 1000000).cast("bigint") * 1000000)
    return t.events.select(
        F.col("user_id").alias("camera_id"),
        e.alias("recording_key"),
        F.concat(clock.stamp("ts"), F.lit("_"), kind).alias("recording_id"),
        whole.alias("start_ts"),
        clock.epoch_s("ts").alias("start_s"),
        kind.alias("kind"),
        F.when(e % 4 != 0, F.floor("value").cast("bigint")).alias("duration_s"),
        (e * 7919 % 1000000 + 1000).alias("size_bytes"),
        (e % 5 != 0).alias("has_front"),
        (e % 3 == 0).alias("has_rear"),
        (e % 2 == 0).alias("has_gps"),
        (e % 29 != 0).alias("timestamp_reliable"),
    )


SQL_RECORDINGS = """
rec AS (
  SELECT user_id AS camera_id, event_id AS recording_key,
    strftime(ts, '%Y%m%d_%H%M%S') || '_' || k AS recording_id,
    date_trunc('second', ts) AS start_ts, epoch_us(ts) // 1000000 AS start_s, k AS kind,
    CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS duration_s,
    event_id * 7919 % 1000000 + 1000 AS size_bytes, event_id % 5 <> 0 AS has_front,
    event_id % 3 = 0 AS has_rear, event_id % 2 = 0 AS has_gps,
    event_id % 29 <> 0 AS timestamp_reliable
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'M'
          WHEN 'error' THEN 'P' ELSE 'N' END AS k FROM events))
"""


def fixes(t: Tables) -> DataFrame:
    """One GPS fix per event; a recording is one camera day."""
    e = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("camera_id"),
        F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit("_"),
                 F.substring(clock.stamp("ts"), 1, 8)).alias("recording_id"),
        e.alias("pos"),
        F.col("ts"),
        clock.epoch_us("ts").alias("ts_us"),
        (e % 11 != 0).alias("valid"),
        F.when(e % 13 != 0, 59 + (e * 37 % 1000) / 10000).alias("lat"),
        F.when(e % 13 != 0, 18 + (e * 91 % 1000) / 10000).alias("lon"),
        F.when(e % 5 != 0, F.col("value") / 3).alias("speed_kmh"),
        F.when(e % 3 != 0, (e * 17 % 360).cast("double")).alias("course"),
        F.when(e % 7 != 0, (e % 50).cast("double")).alias("altitude_m"),
    )


SQL_FIXES = """
fix AS (
  SELECT user_id AS camera_id, 'R' || user_id || '_' || strftime(ts, '%Y%m%d') AS recording_id,
    event_id AS pos, ts, epoch_us(ts) AS ts_us, event_id % 11 <> 0 AS valid,
    CASE WHEN event_id % 13 <> 0 THEN 59 + (event_id * 37 % 1000) / 10000.0::DOUBLE END AS lat,
    CASE WHEN event_id % 13 <> 0 THEN 18 + (event_id * 91 % 1000) / 10000.0::DOUBLE END AS lon,
    CASE WHEN event_id % 5 <> 0 THEN value / 3 END AS speed_kmh,
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id * 17 % 360 AS DOUBLE) END AS course,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS altitude_m
  FROM events)
"""


def day_samples(t: Tables) -> DataFrame:
    """G-sensor samples per camera day, offset from midnight."""
    e = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("camera_id"),
        F.concat(F.lit("R"), F.col("user_id").cast("string"), F.lit("_"),
                 F.substring(clock.stamp("ts"), 1, 8)).alias("recording_id"),
        e.alias("pos"),
        F.floor(F.pmod(clock.epoch_us("ts"), F.lit(86400000000)) / 1000).cast("bigint").alias("offset_ms"),
        (F.floor(F.col("value") * 10).cast("bigint") - 300).alias("x"),
        (e * 31 % 200 - 100).alias("y"),
        (e * 53 % 400 - 100).alias("z"),
    )


SQL_DAY_SAMPLES = """
smp AS (
  SELECT user_id AS camera_id, 'R' || user_id || '_' || strftime(ts, '%Y%m%d') AS recording_id,
    event_id AS pos, (epoch_us(ts) % 86400000000) // 1000 AS offset_ms,
    CAST(floor(value * 10) AS BIGINT) - 300 AS x, event_id * 31 % 200 - 100 AS y,
    event_id * 53 % 400 - 100 AS z
  FROM events)
"""


def day_recordings(t: Tables) -> DataFrame:
    """One recording per camera day, spanning its first to last event."""
    f = fixes(t)
    return f.groupBy("camera_id", "recording_id").agg(
        F.floor(F.min("ts_us") / 1000000).cast("bigint").alias("start_s"),
        F.floor((F.max("ts_us") - F.min("ts_us")) / 1000000).cast("bigint").alias("duration_s"),
        F.lit("N").alias("kind"),
        F.lit(True).alias("timestamp_reliable"),
        F.min("pos").alias("recording_key"),
    )


SQL_DAY_RECORDINGS = """
day AS (
  SELECT camera_id, recording_id, min(ts_us) // 1000000 AS start_s,
    (max(ts_us) - min(ts_us)) // 1000000 AS duration_s, 'N' AS kind,
    true AS timestamp_reliable, min(pos) AS recording_key
  FROM fix GROUP BY ALL)
"""


def samples(t: Tables) -> DataFrame:
    """G-sensor samples per embedding vector, 10 per second."""
    v = F.col("embedding")
    rows = t.embeddings.select("vec_id", v, F.posexplode("embedding").alias("pos", "value"))

    def scaled(value: Column, factor: int) -> Column:
        return F.floor(value.cast("double") * factor).cast("bigint")

    def at(step: int) -> Column:
        return F.element_at(v, (F.pmod(F.col("pos") + step, F.size(v)) + 1).cast("int"))

    return rows.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("recording_id"),
        F.col("vec_id"),
        F.col("pos").cast("bigint").alias("pos"),
        (F.col("pos") * 100).cast("bigint").alias("offset_ms"),
        scaled(F.col("value"), 1000).alias("x"),
        scaled(at(1), 1000).alias("y"),
        scaled(at(2), 800).alias("z"),
    )


SQL_SAMPLES = """
smp AS (
  SELECT 'V' || vec_id AS recording_id, vec_id, pos, pos * 100 AS offset_ms,
    CAST(floor(CAST(embedding[pos + 1] AS DOUBLE) * 1000) AS BIGINT) AS x,
    CAST(floor(CAST(embedding[(pos + 1) % len(embedding) + 1] AS DOUBLE) * 1000) AS BIGINT) AS y,
    CAST(floor(CAST(embedding[(pos + 2) % len(embedding) + 1] AS DOUBLE) * 800) AS BIGINT) AS z
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))
"""


def talk(t: Tables) -> DataFrame:
    """Conversation turns on a time line: a character takes 100 ms."""
    from ..plans.chunked import scan, spread

    long = F.greatest(F.length("text"), F.lit(1)).cast("bigint") * 100
    rows = t.conversations.select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("recording_id"),
        "conv_id", F.col("turn").cast("bigint").alias("pos"), F.col("role").alias("speaker"), "text",
        long.alias("long_ms"),
    )
    out = scan(rows, ["recording_id"], ["pos"], spread("pos", 1024), total={"_upto": F.col("long_ms")})
    return out.withColumn("from_ms", F.col("_upto") - F.col("long_ms")).drop("_upto")


def turns(t: Tables) -> DataFrame:
    a, n = F.col("from_ms"), F.col("long_ms")
    return talk(t).select(
        "recording_id", "pos", (a / 1000).alias("start_s"),
        ((a + F.floor(n * 6 / 10)) / 1000).alias("end_s"), "speaker",
    )


def segments(t: Tables) -> DataFrame:
    a, n = F.col("from_ms") + 1300, F.col("long_ms")
    return talk(t).select(
        "recording_id", "pos", (a / 1000).alias("start_s"), ((a + n) / 1000).alias("end_s"), "text"
    )


def members(t: Tables) -> DataFrame:
    """Conversations as recordings of trips of five."""
    c = F.col("conv_id")
    return talk(t).groupBy("recording_id", "conv_id").agg(F.sum("long_ms").alias("_ms")).select(
        "recording_id", F.floor(c / 5).cast("bigint").alias("trip_id"), c.alias("recording_key"),
        (c * 600).alias("start_s"), (F.floor(c / 5).cast("bigint") * 3000).alias("trip_start_s"),
        F.when(c % 6 == 0, "P").otherwise("N").alias("kind"),
        F.when(c % 7 != 0, F.col("_ms") / 1000).alias("video_s"),
    )


SQL_TALK = """
talk AS (
  SELECT 'C' || conv_id AS recording_id, conv_id, CAST(turn AS BIGINT) AS pos, role AS speaker, text,
    greatest(length(text), 1) * 100 AS long_ms,
    CAST(sum(greatest(length(text), 1) * 100) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT)
      - greatest(length(text), 1) * 100 AS from_ms
  FROM conversations),
turns AS (SELECT recording_id, pos, from_ms / 1000.0::DOUBLE AS start_s,
  (from_ms + long_ms * 6 // 10) / 1000.0::DOUBLE AS end_s, speaker FROM talk),
segs AS (SELECT recording_id, pos, (from_ms + 1300) / 1000.0::DOUBLE AS start_s,
  (from_ms + 1300 + long_ms) / 1000.0::DOUBLE AS end_s, text FROM talk),
members AS (SELECT recording_id, conv_id // 5 AS trip_id, conv_id AS recording_key, conv_id * 600 AS start_s,
  conv_id // 5 * 3000 AS trip_start_s, CASE WHEN conv_id % 6 = 0 THEN 'P' ELSE 'N' END AS kind,
  CASE WHEN conv_id % 7 <> 0 THEN CAST(sum(long_ms) AS BIGINT) / 1000.0::DOUBLE END AS video_s
  FROM talk GROUP BY recording_id, conv_id)
"""

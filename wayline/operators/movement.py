"""Movement evidence at recording edges, movement bridging and impossible jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..plans.chunked import attach, spread
from ..session import settle
from . import trips

# Edge window (s), moving speed (km/h), variance ratio, fastest
# plausible speed (km/h) and shortest elapsed time (s) to judge a jump by.
EDGE_S = 15
MOVING_KMH = 5.0
VARIANCE_RATIO = 3.0
MAX_PLAUSIBLE_KMH = 300.0
MIN_ELAPSED_S = 60

RECORDING = ["camera_id", "recording_id"]


def positioned() -> Column:
    """Valid fix with both coordinates."""
    return F.col("valid") & F.col("lat").isNotNull() & F.col("lon").isNotNull()


def live_fix(lat: Column, lon: Column) -> Column:
    """A live reading of exactly (0, 0) means no fix."""
    return ~((lat == 0) & (lon == 0))


def gps_edges(
    fixes: DataFrame, *, edge_s: float = EDGE_S, moving_kmh: float = MOVING_KMH, chunk_s: int = 3600
) -> DataFrame:
    """Per recording: did GPS show movement near its start / end; no row without data.

    The edges are taken in file order (``pos``), the windows in time.
    """
    usable = fixes.filter(F.col("valid") & F.col("speed_kmh").isNotNull())
    here = F.struct("pos", "ts_us")
    known = attach(
        usable, RECORDING, spread("ts_us", chunk_s * 1_000_000),
        {"_first": (F.min(here), F.min), "_last": (F.max(here), F.max)},
    )
    edge_us = int(edge_s * 1_000_000)
    speed = F.col("speed_kmh")
    at_start = F.col("ts_us") <= F.col("_first.ts_us") + edge_us
    at_end = F.col("ts_us") >= F.col("_last.ts_us") - edge_us
    return known.groupBy(*RECORDING).agg(
        (F.max(F.when(at_start, speed)) >= moving_kmh).alias("gps_start"),
        (F.max(F.when(at_end, speed)) >= moving_kmh).alias("gps_end"),
    )


def magnitude() -> Column:
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    return F.sqrt(x * x + y * y + z * z)


def window_variances(
    samples: DataFrame, *, window_s: float = EDGE_S, keys=RECORDING, chunk_s: int = 600
) -> DataFrame:
    """Variance of the vector magnitude per fixed window from the first sample on.

    Windows with fewer than two samples are left out.
    """
    known = attach(
        samples, keys, spread("offset_ms", chunk_s * 1000),
        {"_first": (F.min(F.struct("pos", "offset_ms")), F.min)},
    )
    window_ms = int(window_s * 1000)
    number = F.floor((F.col("offset_ms") - F.col("_first.offset_ms")) / window_ms).cast("bigint")
    return (
        known.groupBy(*keys, number.alias("window_no"))
        .agg(F.count(F.lit(1)).alias("samples"), F.var_pop(magnitude()).alias("variance"))
        .filter("samples >= 2")
    )


def gsensor_edges(
    samples: DataFrame, *, edge_s: float = EDGE_S, ratio: float = VARIANCE_RATIO, chunk_s: int = 600
) -> DataFrame:
    """Per recording: is the start / end clearly noisier than its quietest window.

    NULL where an edge has fewer than two samples; no row without any window.
    """
    quiet = window_variances(samples, window_s=edge_s, chunk_s=chunk_s).groupBy(*RECORDING).agg(
        F.min("variance").alias("baseline")
    )
    here = F.struct("pos", "offset_ms")
    known = attach(
        samples, RECORDING, spread("offset_ms", chunk_s * 1000),
        {"_first": (F.min(here), F.min), "_last": (F.max(here), F.max)},
    )
    edge_ms = int(edge_s * 1000)
    at_start = F.col("offset_ms") <= F.col("_first.offset_ms") + edge_ms
    at_end = F.col("offset_ms") >= F.col("_last.offset_ms") - edge_ms
    edges = known.groupBy(*RECORDING).agg(
        F.var_pop(F.when(at_start, magnitude())).alias("_var_start"),
        F.count(F.when(at_start, 1)).alias("_n_start"),
        F.var_pop(F.when(at_end, magnitude())).alias("_var_end"),
        F.count(F.when(at_end, 1)).alias("_n_end"),
    )

    def noisy(side: str) -> Column:
        var, base = F.col(f"_var_{side}"), F.col("baseline")
        return F.when(
            F.col(f"_n_{side}") >= 2, F.when(base == 0, var > 0).otherwise(var >= base * ratio)
        )

    return edges.join(quiet, RECORDING).select(
        *RECORDING, noisy("start").alias("gsensor_start"), noisy("end").alias("gsensor_end")
    )


def near_gaps(
    recordings: DataFrame,
    max_gap_s: float = trips.MAX_GAP_S,
    tolerance_s: float = trips.GAP_TOLERANCE_S,
) -> DataFrame:
    """Recordings on either side of an over-threshold gap, the only ones worth probing."""
    found = trips.detect(recordings, max_gap_s=max_gap_s, tolerance_s=tolerance_s)
    wide = found.filter(F.col("rule") == "gap")
    both = F.explode(F.array(F.col("recording_id"), F.col("prev.recording_id")))
    return wide.select("camera_id", both.alias("recording_id")).distinct()


EDGE_COLUMNS = ("gps_start", "gps_end", "gsensor_start", "gsensor_end")


def with_edges(
    recordings: DataFrame, fixes: DataFrame, samples: DataFrame, *,
    max_gap_s: float = trips.MAX_GAP_S, tolerance_s: float = trips.GAP_TOLERANCE_S,
    edge_s: float = EDGE_S, moving_kmh: float = MOVING_KMH,
) -> DataFrame:
    """Recordings with their movement flags; missing telemetry stays NULL.

    Only telemetry of recordings next to an over-threshold gap is read. The short list
    of those and the flags (one row per listed recording) are written once.
    """
    near = settle(near_gaps(recordings, max_gap_s, tolerance_s), "near-gaps")
    gps = gps_edges(fixes.join(near, RECORDING, "left_semi"), edge_s=edge_s, moving_kmh=moving_kmh)
    acc = gsensor_edges(samples.join(near, RECORDING, "left_semi"), edge_s=edge_s)
    flags = settle(
        near.join(gps, RECORDING, "left").join(acc, RECORDING, "left"), "movement-edges"
    )
    return recordings.join(flags, RECORDING, "left")


def bridge_rule(moving_kmh: float = MOVING_KMH) -> trips.Rule:
    """Evidence that the vehicle still moved at the end of one or the start of the other."""

    def said(flag: Column, text: str, side: str, recording: Column) -> Column:
        return F.when(flag, F.concat(F.lit(f"{text} near the {side} of "), recording))

    def rule(prev: Column) -> Column:
        fast = f"GPS speed at or above {moving_kmh:g} km/h"
        noisy = "g-sensor variance over its quiet baseline"
        return F.coalesce(
            said(prev["gps_end"], fast, "end", prev["recording_id"]),
            said(prev["gsensor_end"], noisy, "end", prev["recording_id"]),
            said(F.col("gps_start"), fast, "start", F.col("recording_id")),
            said(F.col("gsensor_start"), noisy, "start", F.col("recording_id")),
        )

    return rule


def gps_span(fixes: DataFrame, static_tags: DataFrame | None = None) -> DataFrame:
    """First and last positioned fix per recording, else its static tag for both.

    ``static_tags`` has camera_id, recording_id, tag_ts_us, tag_lat, tag_lon.
    """
    fix = F.struct(F.col("ts_us"), F.col("lat"), F.col("lon"))
    spans = fixes.filter(positioned()).groupBy(*RECORDING).agg(
        F.min_by(fix, "pos").alias("start_fix"), F.max_by(fix, "pos").alias("end_fix")
    )
    if static_tags is None:
        return spans
    tag = F.when(
        F.col("tag_lat").isNotNull() & F.col("tag_lon").isNotNull(),
        F.struct(
            F.col("tag_ts_us").alias("ts_us"), F.col("tag_lat").alias("lat"),
            F.col("tag_lon").alias("lon"),
        ),
    )
    both = spans.join(static_tags, RECORDING, "full")
    return both.select(
        *RECORDING,
        F.coalesce("start_fix", tag).alias("start_fix"),
        F.coalesce("end_fix", tag).alias("end_fix"),
    ).filter("start_fix IS NOT NULL")


def jump_rule(max_kmh: float = MAX_PLAUSIBLE_KMH, min_elapsed_s: float = MIN_ELAPSED_S) -> trips.Rule:
    """Two positions too far apart for the time between them."""

    def rule(prev: Column) -> Column:
        a, b = prev["end_fix"], F.col("start_fix")
        elapsed_s = (b["ts_us"] - a["ts_us"]) / 1_000_000
        km = haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / 1000
        kmh = F.try_divide(km, elapsed_s / 3600)
        return F.when(
            (elapsed_s >= min_elapsed_s) & (kmh > max_kmh),
            F.concat(
                F.lit("implied speed of "), F.bround(kmh, 0).cast("bigint").cast("string"),
                F.lit(" km/h between "), prev["recording_id"], F.lit(" and "), F.col("recording_id"),
                F.lit(f" is over {max_kmh:g} km/h"),
            ),
        )

    return rule

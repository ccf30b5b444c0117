"""G-sensor baselines, smoothing, interpolation, head trim and overlap detection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.asof import bracket
from ..plans.chunked import scan, smooth, spread

# Padding of the strip chart and of the gauge, smallest scale, smoothing window.
STRIP_PADDING = 1.2
GAUGE_PADDING = 1.0
MIN_SCALE = 1.0
SMOOTHING = 5


def baselines(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact per-axis median, strip scale per axis and gauge scale, in one aggregation.

    Axes are 16-bit readings, so the median's value counts stay bounded per key, and
    the largest deviation follows from minimum and maximum.
    """
    aggs = []
    for axis in "xyz":
        value = F.col(axis).cast("double")
        aggs += [
            F.median(value).alias(f"base_{axis}"),
            F.min(value).alias(f"_lo_{axis}"), F.max(value).alias(f"_hi_{axis}"),
        ]
    out = samples.groupBy(*keys).agg(*aggs)

    def peak(axis: str):
        base = F.col(f"base_{axis}")
        return F.greatest(F.col(f"_hi_{axis}") - base, base - F.col(f"_lo_{axis}"))

    scales = [F.greatest(peak(a) * STRIP_PADDING, F.lit(MIN_SCALE)).alias(f"scale_{a}") for a in "xyz"]
    gauge = F.greatest(F.greatest(peak("y"), peak("z")) * GAUGE_PADDING, F.lit(MIN_SCALE))
    return out.select(*keys, *[f"base_{a}" for a in "xyz"], *scales, gauge.alias("gauge_scale"))


def smoothed(samples: DataFrame, keys: Sequence[str], window: int = SMOOTHING) -> DataFrame:
    """Centred moving average per axis over the sample position."""
    return smooth(samples, keys, "pos", ["x", "y", "z"], window)


def interpolate_samples(
    times: DataFrame, samples: DataFrame, keys: Sequence[str], chunk_ms: int = 60_000
) -> DataFrame:
    """Axis values at each ``at_ms``, clamped to the end samples outside the range."""
    near = bracket(
        times, samples.withColumn("at_ms", F.col("offset_ms")), keys, "at_ms",
        ["offset_ms", "x", "y", "z"], spread("_at", chunk_ms), tie="pos", before="_a", after="_b",
    )
    a, b = F.col("_a"), F.col("_b")
    span = b["offset_ms"] - a["offset_ms"]
    t = (F.col("at_ms") - a["offset_ms"]) / span
    inside = a.isNotNull() & b.isNotNull() & (span > 0)
    return near.select(
        *times.columns,
        *[
            F.when(inside, a[c] + (b[c] - a[c]) * t)
            .otherwise(F.coalesce(a, b)[c].cast("double"))
            .alias(c)
            for c in "xyz"
        ],
    )


def trim_head(samples: DataFrame, drop_ms) -> DataFrame:
    """Drop the first part of a track and count offsets from the cut on; the cut is kept."""
    cut = drop_ms if not isinstance(drop_ms, (int, float)) else F.lit(int(drop_ms))
    return samples.filter(F.col("offset_ms") >= cut).withColumn("offset_ms", F.col("offset_ms") - cut)


def pages(samples: DataFrame, keys: Sequence[str], window_ms: int) -> DataFrame:
    """Page table of each track: fixed windows, the last one shorter."""
    ends = samples.groupBy(*keys).agg(F.max("offset_ms").alias("_end")).filter("_end > 0")
    starts = ends.withColumn(
        "start_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_end") - 1, F.lit(window_ms).cast("bigint")))
    )
    return starts.select(
        *keys, F.floor(F.col("start_ms") / window_ms).cast("bigint").alias("page"), "start_ms",
        F.least(F.col("start_ms") + window_ms, F.col("_end")).alias("end_ms"),
    )


def on_pages(samples: DataFrame, page_table: DataFrame, keys: Sequence[str], window_ms: int) -> DataFrame:
    """Samples with their page; one lying on a page edge belongs to both pages."""
    own = F.floor(F.col("offset_ms") / window_ms).cast("bigint")
    edge = F.col("offset_ms") % window_ms == 0
    both = samples.withColumn("page", F.explode(F.when(edge, F.array(own - 1, own)).otherwise(F.array(own))))
    return both.join(page_table, [*keys, "page"])


# Fixed values of the overlap search: compared window, furthest candidate, grid (s)
# and the score a match has to beat.
WINDOW_S, MAX_S, GRID_S, MIN_SCORE = 3.0, 12.0, 0.02, 0.75


def best_overlap(before, after, before_end, after_end) -> float | None:
    """Overlap in seconds between the tail of one track and the head of the next.

    Both are arrays of the columns t, x, y, z. The tails lie on one grid, step by step, so a track is sampled on it once
    and the tails are windows over the samples; each window is scaled to unit variance per axis.
    """
    reach = min(MAX_S, before_end)
    if len(before) < 2 or len(after) < 2 or after_end < WINDOW_S or reach <= WINDOW_S:
        return None
    points = int(WINDOW_S / GRID_S) + 1
    steps = int((reach - WINDOW_S) / GRID_S) + 1
    # time of sample i: the furthest tail starts at the first, the nearest ends at the last
    at = before_end - WINDOW_S + np.arange(1 - steps, points) * GRID_S
    grid = np.arange(points) * GRID_S
    scores = np.zeros(steps)
    for axis in (1, 2, 3):
        h = np.interp(grid, after[:, 0], after[:, axis])
        h = h - h.mean()
        sd = h.std()
        if sd < 1e-9:
            continue
        v = sliding_window_view(np.interp(at, before[:, 0], before[:, axis]), points)[::-1]
        v = v - v.mean(axis=1, keepdims=True)
        spread_ = np.sqrt(np.einsum("ij,ij->i", v, v) / points)
        flat = spread_ < 1e-9
        scores += np.where(flat, 0.0, v @ (h / sd) / np.where(flat, 1.0, spread_))
    scores /= 3 * points
    best = int(scores.argmax())
    return float(WINDOW_S + best * GRID_S) if scores[best] > MIN_SCORE else None


def _starts(rows: pd.DataFrame, pair: Sequence[str]) -> np.ndarray:
    """First row of each pair in rows sorted by pair; an unknown id equals another."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for name in pair:
        ids = pd.factorize(rows[name])[0]
        new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)


def _compared(rows: pd.DataFrame, cuts, pair: Sequence[str]) -> pd.DataFrame:
    """``overlap_s`` of the pairs between the cuts."""
    side, end = rows["side"].to_numpy(), rows["_end_ms"].to_numpy() / 1000.0
    tracks = np.column_stack([rows["offset_ms"].to_numpy() / 1000.0, *(rows[c].to_numpy(float) for c in "xyz")])
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        m = a + int(np.searchsorted(side[a:b], 1))
        hit = best_overlap(tracks[a:m], tracks[m:b], end[a], end[m]) if a < m < b else None
        found.append(np.nan if hit is None else hit)
    first = rows.iloc[list(cuts[:-1])]
    return pd.DataFrame({**{c: first[c].to_numpy() for c in pair}, "overlap_s": np.array(found, dtype="float64")})


def overlaps(pairs: DataFrame, samples: DataFrame, chunk_ms: int = 60_000) -> DataFrame:
    """``overlap_s`` per pair of consecutive recordings, NULL without a sure match.

    ``pairs`` has before_id and after_id. Only the compared head and tail (plus one
    sample beyond, for interpolation) is shuffled, so a group is bounded by the sample
    rate times 15 seconds however long the tracks are.
    """
    track = ["recording_id"]
    at = spread("offset_ms", chunk_ms)
    known = scan(
        samples, track, ["offset_ms", "pos"], at,
        prev={"_prev_ms": F.col("offset_ms")}, nxt={"_next_ms": F.col("offset_ms")},
        whole={"_end_ms": (F.max("offset_ms"), F.max)},
    )
    cut = F.col("_end_ms") - int(MAX_S * 1000)
    known = known.select(
        "recording_id", "offset_ms", "pos", "x", "y", "z", "_end_ms",
        (F.coalesce("_next_ms", "_end_ms") >= cut).alias("_tail"),
        (F.coalesce("_prev_ms", F.lit(0)) <= int(WINDOW_S * 1000)).alias("_head"),
    )
    pair = ["before_id", "after_id"]
    roles = F.explode(
        F.array(
            F.struct(F.col("before_id").alias("recording_id"), F.lit(0).alias("side")),
            F.struct(F.col("after_id").alias("recording_id"), F.lit(1).alias("side")),
        )
    )
    asked = pairs.select(*pair, roles.alias("_r")).select(*pair, "_r.*")
    wanted = F.when(F.col("side") == 0, F.col("_tail")).otherwise(F.col("_head"))
    parts = known.filter("_tail OR _head").join(asked, "recording_id").filter(wanted)

    names = [*pair, "side", "offset_ms", "x", "y", "z", "_end_ms"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in the order of their pairs; what an Arrow batch cuts off waits for the next one."""
        left = None
        for batch in batches:
            batch = pd.concat([left, batch], ignore_index=True) if left is not None else batch
            cuts = _starts(batch, pair)
            left = batch.iloc[cuts[-1] :] if len(cuts) else None
            if len(cuts) > 1:
                yield _compared(batch, cuts, pair)
        if left is not None and len(left):
            left = left.reset_index(drop=True)
            yield _compared(left, [0, len(left)], pair)

    # little data but much arithmetic per pair: a fixed partition count is not coalesced
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        parts.repartition(tasks, *pair).sortWithinPartitions(*pair, "side", "offset_ms", "pos").select(*names)
        .mapInPandas(compare, "before_id STRING, after_id STRING, overlap_s DOUBLE")
    )
    return found.withColumn("overlap_s", F.nanvl("overlap_s", F.lit(None).cast("double")))

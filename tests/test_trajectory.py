import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import gsensor, trajectory

FIX = (
    "t BIGINT, pos BIGINT, ts_us BIGINT, valid BOOLEAN, lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE, course DOUBLE, altitude_m DOUBLE"
)


def fixes(spark, rows):
    return spark.createDataFrame([(1, i, s * 1_000_000, *rest) for i, (s, *rest) in enumerate(rows)], FIX)


def stats(spark, rows):
    got = trajectory.trip_stats(fixes(spark, rows), ["t"], chunk_us=20_000_000).collect()
    return got[0] if got else None


def test_fewer_than_two_fixes(spark):
    assert stats(spark, [(0, True, 1.0, 1.0, 5.0, None, None), (1, False, 1.0, 1.0, 5.0, None, None)]) is None


def test_distance_and_missing_speed(spark):
    s = stats(spark, [(0, True, 0.0, 0.0, None, None, None), (60, True, 1.0, 0.0, None, None, None)])
    assert s.distance_km == pytest.approx(6371 * math.pi / 180)
    assert (s.average_speed_kmh, s.moving_seconds, s.idle_seconds, s.elevation_gain_m) == (None,) * 4


def test_idle_moving_carry_forward_and_climb(spark):
    s = stats(spark, [
        (0, True, 0.0, 0.0, None, None, 10.0), (10, True, 0.0, 0.0, 20.0, None, 15.0), (30, True, 0.0, 0.0, None, None, None),
        (60, True, 0.0, 0.0, 0.0, None, 5.0), (100, True, 0.0, 0.0, 0.0, None, 9.0),
    ])
    # 0-10 from the 20 alone, 10-30 carried, 30-60 mean of 20 and 0, then standing
    assert (s.moving_seconds, s.idle_seconds) == (60.0, 40.0)
    assert (s.min_altitude_m, s.max_altitude_m, s.elevation_gain_m) == (5.0, 15.0, 9.0)


def test_interpolation_rules(spark):
    f = fixes(spark, [
        (0, True, 0.0, 0.0, 0.0, 350.0, None), (10, True, 1.0, 2.0, None, 10.0, None), (20, True, 2.0, 2.0, 8.0, None, None),
    ])
    asked = spark.createDataFrame([(1, s * 1_000_000) for s in (-5, 0, 5, 15, 20, 99)], "t BIGINT, at_us BIGINT")
    got = {r.at_us // 1_000_000: r for r in trajectory.interpolate_positions(asked, f, ["t"], 7_000_000).collect()}
    assert (got[-5].lat, got[-5].speed_kmh) == (0.0, 0.0)
    assert (got[5].lat, got[5].lon) == (0.5, 1.0)
    assert got[5].speed_kmh is None  # a zero before a missing reading
    assert min(got[5].course, 360 - got[5].course) == pytest.approx(0, abs=1e-9)
    assert (got[15].speed_kmh, got[15].course) == (8.0, 10.0)
    assert (got[99].lat, got[99].speed_kmh) == (2.0, 8.0)


def test_opposite_courses_keep_the_first(spark):
    row = spark.range(1).select(geo.course_between(F.lit(0.0), F.lit(180.0), F.lit(0.5)).alias("c")).first()
    assert row.c == pytest.approx(0.0) or row.c == pytest.approx(90.0)


def test_live_flag(spark):
    f = fixes(spark, [(0, True, 0.0, 0.0, None, None, None), (2, True, 0.0, 0.0, None, None, None), (10, True, 0.0, 0.0, None, None, None)])
    asked = spark.createDataFrame([(1, s * 1_000_000) for s in (-1, 0, 1, 2, 5, 10, 11)], "t BIGINT, at_us BIGINT")
    got = {r.at_us // 1_000_000: r.live for r in trajectory.live_positions(asked, f, ["t"], chunk_us=3_000_000).collect()}
    assert got == {-1: False, 0: True, 1: True, 2: True, 5: False, 10: True, 11: False}


def plain_overlap(a, b, window=3.0, reach=12.0, grid=0.02, limit=0.75):
    """Overlap search with loops, on lists of (t, x, y, z)."""
    def interp(t, xs, ys):
        return float(np.interp(t, xs, ys))

    def vector(rows, start):
        out = []
        for axis in (1, 2, 3):
            v = [interp(start + k * grid, [r[0] for r in rows], [r[axis] for r in rows]) for k in range(int(window / grid) + 1)]
            m = sum(v) / len(v)
            sd = (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5
            out += [0.0] * len(v) if sd < 1e-9 else [(x - m) / sd for x in v]
        return out

    end, head = a[-1][0], vector(b, 0.0)
    best, found = limit, None
    for k in range(int((min(reach, end) - window) / grid) + 1):
        c = window + k * grid
        score = sum(p * q for p, q in zip(vector(a, end - c), head)) / len(head)
        if score > best:
            best, found = score, c
    return found


def test_overlap_found_and_refused(spark):
    rng = random.Random(2)
    def track(n):
        return [(rng.randrange(-300, 300), rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(n)]

    first, other, flat = track(600), track(300), [(5, 5, 5)] * 300
    tail = first[-51:] + track(200)
    rows = []
    for name, data in {"a": first, "b": tail, "c": other, "flat": flat, "short": track(10)}.items():
        rows += [(name, i, i * 100, *v) for i, v in enumerate(data)]
    samples = spark.createDataFrame(rows, "recording_id STRING, pos BIGINT, offset_ms BIGINT, x INT, y INT, z INT")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "flat"), ("a", "short"), ("short", "b")], "before_id STRING, after_id STRING")
    got = {(r.before_id, r.after_id): r.overlap_s for r in gsensor.overlaps(pairs, samples, chunk_ms=4000).collect()}
    assert got[("a", "b")] == pytest.approx(5.0, abs=0.03)
    assert [got[k] for k in (("a", "c"), ("a", "flat"), ("a", "short"), ("short", "b"))] == [None] * 4
    plain = plain_overlap([(i / 10, *v) for i, v in enumerate(first)], [(i / 10, *v) for i, v in enumerate(tail)])
    assert got[("a", "b")] == pytest.approx(plain)


def test_overlap_samples_each_track_once(monkeypatch):
    import numpy as np

    asked, interp = [], np.interp
    monkeypatch.setattr(gsensor.np, "interp", lambda at, *rest: asked.append(np.size(at)) or interp(at, *rest))
    t = np.arange(0, 20, 0.1)
    track = np.column_stack([t, np.sin(t * t / 9), np.cos(t * 1.7), np.sin(t + t * t / 30)])
    cut = track[100:] - [10.0, 0, 0, 0]
    assert abs(gsensor.best_overlap(track, cut, t[-1], cut[-1, 0]) - (t[-1] - 10)) < 0.011
    assert sum(asked) < 5000


def test_brackets_are_cut_finer_than_the_session(spark):
    from wayline.plans import asof

    fixes = spark.range(50).selectExpr("id % 3 AS camera_id", "id AS pos", "id * 1000 AS at_us")
    near = asof.bracket(fixes, fixes, ["camera_id"], "at_us", ["pos"], F.floor(F.col("_at") / 9000), tie="pos", before="a", after="b")
    tasks = asof.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {tasks}" in near._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.pos, r.a.pos) for r in near.collect()} == {(i, i) for i in range(50)}

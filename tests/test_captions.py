"""Caption windows against the plain loop, in bursts of any length."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import captions

ROWS = "recording_id STRING, t_s DOUBLE, rank BIGINT, text STRING, video_s DOUBLE"


def loop(rows, video_s):
    """Windows of one recording's cues, one after the other."""
    moments: dict = {}
    for t, rank, text in sorted(rows):
        at = max(min(t, video_s), 0.0)
        if at < video_s:
            moments.setdefault(at, []).append(text)
    ordered, out, before = sorted(moments), [], 0.0
    for i, s in enumerate(ordered):
        text = " ".join(moments[s])
        e = ordered[i + 1] if i + 1 < len(ordered) else video_s
        start = max(max(0.0, s - 2), before)
        end = max(min(max(s + 2, start + max(2.0, len(text) / 12 + 1)), e), start)
        out.append((start, end, text))
        before = end
    return out


@pytest.mark.parametrize("block", [64, 3])
def test_windows_equal_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(captions, "BLOCK", block)
    rng = random.Random(block)
    data, want = [], {}
    for k in range(12):
        at, rows, video = 0.0, [], rng.choice([60.0, 400.0])
        for i in range(rng.choice([1, 5, 200])):
            at += rng.choice([0.0, 0.5, 1.5, 2.5, 9.0])
            rows.append((at - 3, i, "x" * rng.choice([1, 10, 40, 90])))
        data += [(f"r{k}", t, rank, text, video) for t, rank, text in rows]
        want[f"r{k}"] = loop(rows, video)
    got: dict = {}
    for r in captions.merge_captions(spark.createDataFrame(data, ROWS).repartition(3), ["recording_id"], chunk_s=50).collect():
        got.setdefault(r.recording_id, []).append((r.start_s, r.end_s, r.text))
    assert got.keys() == {k for k, v in want.items() if v}
    for k, rows in got.items():
        assert len(rows) == len(want[k])
        for a, b in zip(sorted(rows), sorted(want[k])):
            assert a[2] == b[2] and a[:2] == pytest.approx(b[:2], abs=1e-6)


def test_one_burst_of_two_hundred_thousand_cues(spark):
    n = 200_000
    cues = spark.range(n).select(
        F.lit("r").alias("recording_id"), (F.col("id") * 2.6).alias("t_s"), F.col("id").alias("rank"),
        F.repeat(F.lit("x"), (12 + F.col("id") * 7 % 13).cast("int")).alias("text"), F.lit(n * 3.0).alias("video_s"),
    )
    got = sorted((r.start_s, r.end_s) for r in captions.merge_captions(cues, ["recording_id"]).select("start_s", "end_s").collect())
    want = sorted(x[:2] for x in loop([(i * 2.6, i, "x" * (12 + i * 7 % 13)) for i in range(n)], n * 3.0))
    assert len(got) == n
    assert max(max(abs(a - c), abs(b - d)) for (a, b), (c, d) in zip(got, want)) < 1e-5

"""Chunked scans against plain pandas, one key holding most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.plans.asof import bracket
from wayline.plans.chunked import attach, scan, smooth, spread
from wayline.plans.overlap import _nodes, overlap_join


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        key = 1 if rng.random() < 0.6 else rng.randrange(2, 6)
        rows.append((key, rng.randrange(0, 500), i, rng.choice([None, rng.randrange(-9, 9)])))
    pdf = pd.DataFrame(rows, columns=["k", "at", "id", "v"])
    pdf["v"] = pdf["v"].astype("Int64")
    df = spark.createDataFrame(rows, "k BIGINT, at BIGINT, id BIGINT, v BIGINT")
    return df, pdf.sort_values(["k", "at", "id"], ignore_index=True)


@pytest.mark.parametrize("width", [1, 7, 100, 10000])
def test_scan_equals_pandas(series, width):
    df, pdf = series
    out = scan(
        df, ["k"], ["at", "id"], spread("at", width), prev={"p": F.col("id")}, nxt={"n": F.col("id")},
        total={"s": F.col("v")}, peak={"m": F.col("v")}, fill={"f": F.col("v")}, fill_back={"b": F.col("v")},
        number="rn", whole={"c": (F.count(F.lit(1)), F.sum)},
    ).toPandas().sort_values(["k", "at", "id"], ignore_index=True)
    g = pdf.groupby("k")
    want = {
        "p": g["id"].shift(1), "n": g["id"].shift(-1), "f": g["v"].ffill(), "b": g["v"].bfill(),
        "rn": g.cumcount() + 1, "c": g["id"].transform("size"),
        "s": pdf["v"].fillna(0).groupby(pdf["k"]).cumsum(),
    }
    for name, col in want.items():
        assert out[name].astype("Int64").tolist() == col.astype("Int64").tolist(), name
    peak = pdf["v"].astype(float).groupby(pdf["k"]).cummax().groupby(pdf["k"]).ffill()
    assert out["m"].astype(float).fillna(-99).tolist() == peak.fillna(-99).tolist()


@pytest.mark.parametrize("width", [3, 50, 10000])
def test_derived_totals(series, width):
    df, pdf = series
    out = scan(
        df, ["k"], ["at", "id"], spread("at", width), prev={"was": F.col("at")},
        derive=lambda d: d.withColumn("new", F.coalesce(F.col("at") - F.col("was") > 1, F.lit(True))),
        derive_from=["at"], total={"no": F.col("new").cast("bigint")}, fill={"since": F.when(F.col("new"), F.col("id"))},
    ).toPandas().sort_values(["k", "at", "id"], ignore_index=True)
    step = pdf.groupby("k")["at"].diff()
    new = step.isna() | (step > 1)
    assert out["no"].tolist() == new.astype(int).groupby(pdf["k"]).cumsum().tolist()
    since = pdf["id"].where(new).groupby(pdf["k"]).ffill()
    assert out["since"].tolist() == since.astype(int).tolist()


def test_attach_and_smooth(spark, series):
    df, pdf = series
    out = attach(df, ["k"], spread("at", 10), {"hi": (F.max("at"), F.max)}).toPandas()
    best = pdf.groupby("k")["at"].max()
    assert (out["hi"] == out["k"].map(best)).all()
    dense = spark.range(0, 103).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * F.col("id")).alias("x"))
    got = smooth(dense, ["k"], "pos", ["x"], 5, chunk_rows=10).orderBy("pos").toPandas()
    plain = pd.Series([i * i for i in range(103)]).rolling(5, center=True, min_periods=1).mean()
    assert got["x_smooth"].tolist() == pytest.approx(plain.tolist())


def test_bracket_ties_and_ends(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 3)], "k BIGINT, at BIGINT")
    right = spark.createDataFrame([(1, 10, 0, "a"), (1, 10, 1, "b"), (1, 20, 2, "c")], "k BIGINT, at BIGINT, n BIGINT, v STRING")
    out = bracket(left, right, ["k"], "at", ["v"], spread("_at", 4), tie="n", before="x", after="y")
    got = {(r.k, r.at): (r.x and r.x.v, r.y and r.y.v) for r in out.collect()}
    assert got == {(1, 5): (None, "a"), (1, 10): ("b", "c"), (1, 11): ("b", "c"), (2, 3): (None, None)}


def test_overlap_join_is_whole_and_single(spark):
    rng = random.Random(3)
    spans = lambda n: [(i, a := rng.uniform(0, 100), a + rng.choice([0, 0.5, 5, 60])) for i in range(n)]
    left, right = spans(80), spans(80)
    l = spark.createDataFrame([(1, *x) for x in left], "k INT, i INT, a DOUBLE, b DOUBLE")
    r = spark.createDataFrame([(1, *x) for x in right], "k INT, j INT, c DOUBLE, d DOUBLE")
    got = [(x.i, x.j) for x in overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), 7.0).collect()]
    want = [(i, j) for i, a, b in left for j, c, d in right if a <= d and c <= b]
    assert sorted(got) == sorted(want)


def test_a_span_of_ten_years_has_few_copies(spark):
    decade = 10 * 365.25 * 86400
    spans = spark.createDataFrame([(1, 0, -decade / 2, decade / 2), (1, 1, 5.0, 5.0), (1, 2, 50.0, 10.0), (1, 3, -1e9, 1e12)], "k INT, i INT, a DOUBLE, b DOUBLE")
    points = [(1, j, random.Random(j).uniform(-decade, decade)) for j in range(200)] + [(1, 500, 5.0), (1, 501, decade / 2), (2, 502, 5.0)]
    right = spark.createDataFrame([(k, j, c, c) for k, j, c in points], "k INT, j INT, c DOUBLE, d DOUBLE")
    got = sorted((x.i, x.j) for x in overlap_join(spans, right, ["k"], ("a", "b"), ("c", "d"), 600.0).collect())
    want = [(i, j) for i, a, b in ((0, -decade / 2, decade / 2), (1, 5.0, 5.0), (3, -1e9, 1e12)) for k, j, c in points if k == 1 and a <= c <= b]
    assert got == sorted(want)
    lo, hi = (F.floor(F.col(c) / 600).cast("bigint").alias(n) for c, n in (("a", "lo"), ("b", "hi")))
    sizes = spans.filter("a <= b").select(lo, hi).select(F.size(_nodes("lo", "hi")).alias("n"), "lo", "hi").collect()
    assert all(r.n <= 2 * max(1, (r.hi - r.lo + 1).bit_length()) for r in sizes)


def test_dyadic_nodes_cover_each_bucket_once(spark):
    rng = random.Random(2)
    spans = [(lo, lo + rng.choice([0, 1, 2, 3, 7, 8, 30, 100])) for lo in (rng.randrange(-200, 200) for _ in range(300))]
    for r in spark.createDataFrame(spans, "lo BIGINT, hi BIGINT").select("lo", "hi", _nodes("lo", "hi").alias("n")).collect():
        held = [b for x in r.n for b in range(x.node << x.level, (x.node + 1) << x.level)]
        assert sorted(held) == list(range(r.lo, r.hi + 1)), (r.lo, r.hi, r.n)

"""Trip rules on hand-made archives and against a plain sequential walk."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.functions import ids
from wayline.operators import movement, trips

SCHEMA = (
    "camera_id BIGINT, recording_key BIGINT, recording_id STRING, start_s BIGINT, kind STRING, duration_s BIGINT, "
    "size_bytes BIGINT, timestamp_reliable BOOLEAN"
)


def archive(spark, rows):
    full = []
    for i, row in enumerate(rows):
        start, dur, kind, ok = (*row, None, "N", True)[:4] if len(row) == 1 else (*row, "N", True)[:4] if len(row) == 2 else (*row, True)[:4]
        full.append((1, i, f"r{i}", start, kind, dur, 10, ok))
    return spark.createDataFrame(full, SCHEMA)


def numbers(found):
    return [r.trip_no for r in found.orderBy("recording_key").collect()]


def test_single_and_two_close(spark):
    assert numbers(trips.detect(archive(spark, [(0,)]))) == [1]
    assert numbers(trips.detect(archive(spark, [(0,), (60,)]))) == [1, 1]


def test_boundary_is_inclusive(spark):
    assert numbers(trips.detect(archive(spark, [(0,), (310,)]))) == [1, 1]
    assert numbers(trips.detect(archive(spark, [(0,), (311,)]))) == [1, 2]


def test_duration_extends_previous_end(spark):
    assert numbers(trips.detect(archive(spark, [(0, 180), (480, 60), (1000, None)]))) == [1, 1, 2]


def test_negative_gap_stays_together(spark):
    found = trips.explain(trips.detect(archive(spark, [(0, 900), (100, 60)])))
    rows = found.orderBy("recording_key").collect()
    assert [r.trip_no for r in rows] == [1, 1]
    assert "800.0s before the previous recording ended" in rows[1].reason


def test_unreliable_on_either_side(spark):
    rows = [(0, 60, "N", True), (60, 60, "N", False), (120, 60, "N", True), (180, 60, "N", True)]
    assert numbers(trips.detect(archive(spark, rows))) == [1, 2, 3, 3]


def test_cap_splits_before_the_crossing_recording(spark):
    rows = [(i * 1800, 1800, "P") for i in range(4)]
    assert numbers(trips.detect(archive(spark, rows), parking_cap_s=3600)) == [1, 1, 2, 2]


def test_cap_resets_on_driving(spark):
    rows = [(0, 1800, "P"), (1800, 1800, "P"), (3600, 60, "N"), (3660, 1800, "P"), (5460, 1800, "P")]
    assert numbers(trips.detect(archive(spark, rows), parking_cap_s=3600)) == [1] * 5


def test_opening_parking_over_cap_splits_next_driving(spark):
    rows = [(0, 7200, "P"), (7200, 60, "N"), (7260, 60, "N")]
    assert numbers(trips.detect(archive(spark, rows), parking_cap_s=3600)) == [1, 2, 2]


def test_force_split_inside_threshold(spark):
    found = trips.detect(
        archive(spark, [(0, 60), (60, 60), (120, 60)]),
        force_split=lambda prev: F.when(F.col("recording_key") == 2, "jump"),
    )
    rows = found.orderBy("recording_key").collect()
    assert [r.rule for r in rows] == ["first", "within", "force"]


def test_bridge_only_over_threshold(spark):
    found = trips.detect(
        archive(spark, [(0, 60), (60, 60), (5000, 60)]), bridge=lambda prev: F.lit("moving")
    )
    rows = found.orderBy("recording_key").collect()
    assert [r.rule for r in rows] == ["first", "within", "bridged"]
    assert rows[1].bridge_reason is None


def walk(rows, gap, cap):
    """The rules as a plain loop over one camera."""
    out, held, no = [], 0, 0
    for i, (start, dur, kind, ok) in enumerate(rows):
        step = (dur or 0) if kind == "P" else 0
        if i == 0:
            no, held = 1, step
        else:
            s, d, _, prev_ok = rows[i - 1]
            over = held + step > cap
            if over or not (ok and prev_ok) or start - s - (d or 0) > gap + 10:
                no, held = no + 1, step
            else:
                held = held + step if kind == "P" else 0
        out.append(no)
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_random_archives_equal_the_walk(spark, kind):
    """Chunk edges everywhere; keys of any type."""
    rng = random.Random(11)
    all_rows, want = [], {}
    for camera in range(6):
        at, rows = 0, []
        for _ in range(150):
            dur = rng.choice([None, 20, 50, 90, 400])
            rows.append((at, dur, rng.choice("PPPN"), rng.random() > 0.03))
            at += (dur or 0) + rng.choice([0, 5, 60, 500])
        for i, row in enumerate(rows):
            all_rows.append((camera, camera * 1000 + i, f"r{i}", row[0], row[2], row[1], 1, row[3]))
        for i, no in enumerate(walk(rows, 300, 300)):
            want[camera * 1000 + i] = no
    df = spark.createDataFrame(all_rows, SCHEMA).withColumn("camera_id", F.col("camera_id").cast(kind))
    if kind == "string":  # of equal length, so that they sort like the numbers
        df = df.withColumn("recording_key", F.lpad(F.col("recording_key").cast("string"), 8, "0"))
    found = trips.detect(df, parking_cap_s=300, chunk_s=700)
    assert {int(r.recording_key): r.trip_no for r in found.collect()} == want


def test_interval_build_equals_full_build(spark):
    base = 1704067200
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(400):
        at += rng.choice([30, 60, 20000])
        rows.append((i % 3, i, None, base + at, "N", 30, 1, True))
    df = spark.createDataFrame(rows, SCHEMA)
    stamp = F.date_format(F.timestamp_seconds("start_s"), "yyyyMMdd_HHmmss")
    df = df.withColumn("recording_id", F.concat(stamp, F.lit("_N"))).withColumn("date", F.substring("recording_id", 1, 8))
    for span in (ids.interval(since="20240107", until="20240108"), ids.interval(since="20240120", until="202401")):
        full = trips.touching(trips.detect(df), span)
        part = trips.detect_interval(df, span)
        key = ["camera_id", "recording_key"]
        a = sorted(tuple(r) for r in full.select(key).collect())
        b = sorted(tuple(r) for r in part.select(key).collect())
        assert a and a == b


FIX = "camera_id BIGINT, recording_id STRING, pos BIGINT, ts_us BIGINT, valid BOOLEAN, lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE"


def test_gps_edges(spark):
    rows = [
        (1, "fast_end", 0, 0, True, 1.0, 1.0, 0.0), (1, "fast_end", 1, 60_000_000, True, 1.0, 1.0, 40.0),
        (1, "slow", 0, 0, True, 1.0, 1.0, 0.5), (1, "invalid", 0, 0, False, 1.0, 1.0, 90.0),
        (1, "disorder", 0, 50_000_000, True, 1.0, 1.0, 0.0), (1, "disorder", 1, 10_000_000, True, 1.0, 1.0, 0.0),
        (1, "disorder", 2, 20_000_000, True, 1.0, 1.0, 30.0),
    ]
    got = {r.recording_id: (r.gps_start, r.gps_end) for r in movement.gps_edges(spark.createDataFrame(rows, FIX)).collect()}
    assert got == {"fast_end": (False, True), "slow": (False, False), "disorder": (True, True)}


def test_gsensor_edges(spark):
    rows = []
    for i in range(600):
        noisy = (i % 2) * 50 if i >= 500 else i % 2
        rows.append((1, "late", i, i * 100, 100 + noisy, 0, 0))
        rows.append((1, "flat", i, i * 100, 100, 0, 0))
    rows.append((1, "lone", 0, 0, 1, 1, 1))
    df = spark.createDataFrame(rows, "camera_id BIGINT, recording_id STRING, pos BIGINT, offset_ms BIGINT, x INT, y INT, z INT")
    got = {r.recording_id: (r.gsensor_start, r.gsensor_end) for r in movement.gsensor_edges(df).collect()}
    assert got == {"late": (False, True), "flat": (False, False)}


@pytest.mark.parametrize(
    "lat, elapsed_s, forced", [(10.0, 600, True), (0.01, 600, False), (10.0, 30, False), (None, 600, False)]
)
def test_impossible_jump(spark, lat, elapsed_s, forced):
    fixes = [(1, "r0", 0, 0, True, 0.0, 0.0, None)]
    if lat is not None:
        fixes.append((1, "r1", 0, elapsed_s * 1_000_000, True, lat, 0.0, None))
    spans = movement.gps_span(spark.createDataFrame(fixes, FIX))
    base = archive(spark, [(0, 60), (100, 60)]).join(spans, movement.RECORDING, "left")
    found = trips.detect(base, force_split=movement.jump_rule(), extra=("start_fix", "end_fix"))
    assert [r.rule for r in found.orderBy("recording_key").collect()] == ["first", "force" if forced else "within"]


@pytest.mark.parametrize("short", [256, 4])
def test_cap_cuts_of_random_runs_equal_the_walk(spark, monkeypatch, short):
    """Folded and by pointers: also steps of nothing, and steps over the cap by themselves."""
    monkeypatch.setattr(trips, "SHORT_RUN", short)
    rng = random.Random(short)
    rows, want = [], {}
    for camera in range(8):
        durs = [rng.choice([None, 0, 0, 30, 100, 299, 300, 301, 900]) for _ in range(rng.choice([1, 3, 40, 250]))]
        kind = [(camera * 1000 + i * 50, d, "P", True) for i, d in enumerate(durs)]
        rows += [(camera, camera * 1000 + i, f"r{i}", s, k, d, 1, ok) for i, (s, d, k, ok) in enumerate(kind)]
        want |= {camera * 1000 + i: no for i, no in enumerate(walk(kind, 10**6, 300))}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = trips.detect(df, max_gap_s=10**6, parking_cap_s=300, chunk_s=700).collect()
    assert {r.recording_key: r.trip_no for r in found} == want
    held: dict = {}
    for r in sorted(found, key=lambda r: (r.camera_id, r.start_s, r.recording_key)):
        step = r.duration_s or 0
        asked = held.get(r.camera_id, 0) + step
        cut = r.camera_id in held and asked > 300
        assert r.parking_total_s == (asked if cut else None)
        held[r.camera_id] = step if cut else asked


def test_one_parking_run_of_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit(1).cast("bigint").alias("camera_id"), F.col("id").alias("recording_key"), F.lit("r").alias("recording_id"),
        (F.col("id") * 60).alias("start_s"), F.lit("P").alias("kind"), (20 + F.col("id") * 7 % 41).alias("duration_s"),
        F.lit(1).cast("bigint").alias("size_bytes"), F.lit(True).alias("timestamp_reliable"),
    )
    got = [r[0] for r in trips.detect(rows, parking_cap_s=40_000).filter("rule = 'cap'").select("recording_key").collect()]
    held, want = 0, []
    for i in range(n):
        step = 20 + i * 7 % 41
        if i and held + step > 40_000:
            want.append(i)
            held = step
        else:
            held += step
    assert sorted(got) == want and len(want) > 900


def test_zoned_interval_build_equals_full_build_and_reads_less(spark, tmp_path):
    base, rng, rows = 1704067200, random.Random(9), []
    for camera in range(5):
        at = 0
        for i in range(300):
            at += rng.choice([30, 60, 200, 9000, 90_000 if camera % 2 else 250])
            rows.append((camera, i, None, base + at, "N", rng.choice([None, 30, 200]), 1, rng.random() > 0.02))
    df = spark.createDataFrame(rows, SCHEMA)
    stamp = F.date_format(F.timestamp_seconds("start_s"), "yyyyMMdd_HHmmss")
    df = df.withColumn("recording_id", F.concat(stamp, F.lit("_N"))).withColumn("date", F.substring("recording_id", 1, 8))
    place = str(tmp_path / "dated")
    df.repartition("date").write.partitionBy("date").parquet(place)
    table = spark.read.schema(df.schema).parquet(place)
    zones = trips.day_zones(table)
    key = ["camera_id", "recording_key"]
    days = table.select("date").distinct().count()
    for a, b in (("20240107", "20240108"), ("20240103", "20240103"), ("20230101", "20230102"), ("20240120", "202402")):
        span = ids.interval(since=a, until=b)
        full = sorted(tuple(r) for r in trips.touching(trips.detect(df), span).select(key).collect())
        part = sorted(tuple(r) for r in trips.detect_zoned(table, zones, span).select(key).collect())
        assert full == part
    wanted = [r[0] for r in trips.days_of_interval(zones, ids.interval(since="20240107", until="20240108")).select("date").distinct().collect()]
    read = table.filter(F.col("date").between(min(wanted), max(wanted))).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < len(wanted) < days / 2 and read < len(table.inputFiles()) / 2
    assert trips.detect_zoned(table.limit(0), trips.day_zones(table.limit(0)), span).count() == 0

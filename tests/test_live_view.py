"""Trail, strip, freshness, marks and state bounds over several micro-batches."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayline.streaming import live, run, view

SCHEMA = "camera_id BIGINT, reading_id BIGINT, ts_us BIGINT, lat DOUBLE, lon DOUBLE, front_rear DOUBLE, left_right DOUBLE, upper_lower DOUBLE"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Four files; every twentieth reading comes one file late."""
    rng = random.Random(2)
    rows = [
        (1 + (rng.random() < 0.3), i, 1_300_000_000_000_000 + i * 3_000_000 + rng.randrange(2) * 1_000_000, 59 + rng.randrange(3) / 100, 18 + rng.randrange(3) / 100,
         rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9))
        for i in range(400)
    ]
    files = [[], [], [], []]
    for i, row in enumerate(rows):
        files[min(3, i // 100 + (i % 20 == 19))].append(row)
    place = str(tmp_path_factory.mktemp("arriving") / "raw")
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(place), files


def test_trail_and_strip_at_every_trigger(spark, arriving):
    stream, files = arriving
    trails = run.drain(view.trails(stream, trail_s=120, history_s=300), "t-trail", "update").collect()
    strips = run.drain(view.strips(stream, strip_s=60), "t-strip", "update").collect()
    assert {r.batch_id for r in trails} == {0, 1, 2, 3}
    seen: list = []
    for n, part in enumerate(files):
        # what a span forgot never comes back: late rows count only where the span still holds them
        seen += part
        for camera in {r[0] for r in part}:
            mine = sorted((r for r in seen if r[0] == camera), key=lambda r: (r[2], r[1]))
            newest = max(r[2] for r in mine)
            for rows, span, at in ((trails, 120, (3, 4)), (strips, 60, (5, 6, 7))):
                names = ("lat", "lon") if rows is trails else ("front_rear", "left_right", "upper_lower")
                got = sorted((r for r in rows if r.camera_id == camera and r.batch_id == n), key=lambda r: r.seq)
                want = [r for r in mine if r[2] >= newest - span * 1_000_000]
                assert [r.seq for r in got] == list(range(len(want))) and {r.as_of_us for r in got} == {newest}
                assert [(r.reading_id, r.ts_us, *(r[c] for c in names)) for r in got] == [(r[1], r[2], *(r[i] for i in at)) for r in want]
            assert {r.readings for r in trails if r.camera_id == camera and r.batch_id == n} == {sum(r[2] >= newest - 300_000_000 for r in mine)}


def test_history_is_answered_in_the_batch_of_the_reading(spark, arriving):
    stream, files = arriving
    rows = run.drain(view.history_on_arrival(stream, seconds=90), "t-arrival").collect()
    batch = {r[1]: n for n, part in enumerate(files) for r in part}
    assert {r.reading_id: r.batch_id for r in rows} == batch
    data = {r[1]: r for part in files for r in part}
    for r in rows:
        known = [x[2] for x in data.values() if x[0] == r.camera_id and batch[x[1]] <= r.batch_id and r.ts_us - 90_000_000 <= x[2] <= r.ts_us]
        if r.reading_id % 20 != 19:
            assert (r.readings, r.oldest_us) == (len(known), min(known))


def test_a_silent_camera_turns_stale_and_comes_back(spark, tmp_path):
    place, seen = str(tmp_path / "raw"), []

    def send(camera, i):
        spark.createDataFrame([(camera, i, i * 1_000_000)], "camera_id BIGINT, reading_id BIGINT, ts_us BIGINT").coalesce(1).write.mode("append").parquet(place)

    def wait(what, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if what():
                return True
            time.sleep(0.2)
        return False

    send(1, 1)
    send(2, 1)
    stream = spark.readStream.schema("camera_id BIGINT, reading_id BIGINT, ts_us BIGINT").parquet(place)
    settings = run.SETTINGS | {"spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    query = (
        view.freshness_signals(stream, limit_s=4, ttl_s=3600).writeStream.outputMode("update").trigger(processingTime="500 milliseconds")
        .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).start()
    )
    try:
        assert wait(lambda: {(s[0], s[1]) for s in seen} >= {(1, True), (2, True)})
        # nothing arrives, and both are told to be stale
        assert wait(lambda: {(s[0], s[1]) for s in seen} >= {(1, False), (2, False)})
        send(1, 9)
        assert wait(lambda: [s[1] for s in seen if s[0] == 1] == [True, False, True])
        assert wait(lambda: [s[1] for s in seen if s[0] == 1] == [True, False, True, False])
    finally:
        query.stop()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [s[1] for s in seen if s[0] == 2] == [True, False]
    on, off = (next(s for s in seen if s[0] == 2 and s[1] is f) for f in (True, False))
    assert off[2] - on[2] == 4000 and [s[3] for s in seen if s[0] == 1][-1] == 9_000_000


def test_marks_skip_what_was_handled_and_one_failure_stays_alone(spark, tmp_path):
    schema = "camera_id BIGINT, asset_set STRING, recording_id STRING"
    src, cp, out = (str(tmp_path / n) for n in ("src", "cp", "out"))
    worked: list = []

    def note(rows):
        def run_rows(batches):
            for b in batches:
                if (b["recording_id"] == "r03").any():
                    raise ValueError("r03 cannot be read")
                yield b.assign(error=None, size=7)
        return rows.mapInPandas(run_rows, schema + ", error STRING, size BIGINT")

    def go():
        stream = spark.readStream.schema(schema).parquet(src)
        done, cursors = run.process_new(spark, stream, note, "t-marks", checkpoint=cp, out=out)
        worked[:] = sorted((r.camera_id, r.recording_id, r.size, r.error is not None) for r in done.collect())
        return {(r.camera_id, r.asset_set): (r.last_seen, r.handled, r.failed) for r in cursors.collect()}

    def send(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    send((1, "GPS", "r01"), (1, "GPS", "r03"), (1, "GPS", "r02"), (1, "GPS", "r02"), (2, "GPS", "r01"))
    assert go() == {(1, "GPS"): ("r03", 3, 1), (2, "GPS"): ("r01", 1, 0)}
    assert worked == [(1, "r01", 7, False), (1, "r02", 7, False), (1, "r03", None, True), (2, "r01", 7, False)]
    # delivered again, and one below the mark: not handled; another set has a mark of its own
    send((1, "GPS", "r02"), (1, "GPS", "r03"), (1, "GPS", "r00"), (1, "GPS", "r04"), (1, "FRONT", "r01"))
    assert go() == {(1, "GPS"): ("r04", 4, 1), (2, "GPS"): ("r01", 1, 0), (1, "FRONT"): ("r01", 1, 0)}
    assert [w[:2] for w in worked].count((1, "r02")) == 1 and len(worked) == 6
    # the cursors of a batch come from the version before it, not from what was put out
    spark.createDataFrame([(1, "GPS", "r99", 40, 2)], run._CURSORS).write.mode("overwrite").parquet(f"{out}-cursors/version=1")
    send((1, "GPS", "r98"), (2, "GPS", "r02"))
    assert go() == {(1, "GPS"): ("r99", 40, 2), (2, "GPS"): ("r02", 1, 0)}


def test_open_ends_are_bounded():
    start = '{"GPS": {"LATITUDE": 1'
    assert live.open_tail("x" + start) == start[1:]
    assert live.open_tail(start + " " * live.LONGEST_OBJECT) == " " * live.LONGEST_START
    tail = ""
    for _ in range(300):  # an object opened and never closed
        tail = live.open_tail(tail + (start if not tail else "9" * 1000))
        assert len(tail) <= live.LONGEST_OBJECT


def test_state_expires(spark, tmp_path):
    """A region is forgotten when its time to live is over, so the same place signals again."""
    place, rows = str(tmp_path / "raw"), "camera_id BIGINT, reading_id BIGINT, ts_us BIGINT, lat DOUBLE, lon DOUBLE, fetch_ok BOOLEAN"

    def go(name, ttl_s, pause):
        out = []
        for i in range(2):
            spark.createDataFrame([(1, i, i * 60_000_000, 59.0, 18.0, True)], rows).coalesce(1).write.mode("append").parquet(f"{place}-{name}")
            stream = spark.readStream.schema(rows).parquet(f"{place}-{name}")
            done = run.drain(live.region_exits(stream, 100.0, ttl_s), name, checkpoint=str(tmp_path / f"cp-{name}"), out=str(tmp_path / f"out-{name}"))
            out.append(done.count())
            time.sleep(pause)
        return out

    assert go("kept", 3600, 0) == [1, 1]
    assert go("forgotten", 1, 2.5) == [1, 2]


def test_late_frames_keep_their_types():
    held = pd.DataFrame({"reading_id": [1], "ts_us": [5], "lat": [1.0], "lon": [2.0]})
    part = view._slice(held, 10)
    assert part["seq"].tolist() == [0] and part["as_of_us"].tolist() == [5]


def test_cameras_share_states_and_one_may_be_unknown(spark, tmp_path):
    cameras = spark.range(5000).select(F.col("id").alias("camera_id"))
    assert live.by_group(cameras).count().count() <= live.GROUPS
    place = str(tmp_path / "raw")
    rows = spark.range(60).selectExpr("IF(id % 20 = 0, NULL, id % 20) AS camera_id", "id AS reading_id", "id * 1000000 AS ts_us", "1D AS front_rear", "2D AS left_right", "3D AS upper_lower", "id * 1D AS lat", "2D AS lon")
    rows.coalesce(1).write.parquet(place)
    stream = spark.readStream.schema(rows.schema).parquet(place)
    strips = run.drain(view.strips(stream, strip_s=25), "g-strip", "update").collect()
    last = {None if c == 0 else c: [(n, c + 20 * (n + 1)) for n in range(2)] for c in range(20)}
    assert {c: sorted((r.seq, r.reading_id) for r in strips if r.camera_id == c) for c in last} == last
    known = run.drain(view.history_on_arrival(stream, seconds=25), "g-arrival").collect()
    assert sorted((r.reading_id, r.readings) for r in known) == [(i, 1 if i < 20 else 2) for i in range(60)]


def test_turns_arrive_as_so_many_files(spark, tmp_path):
    from wayline.catalog.live import _arrive

    for rows, name in ((spark.range(3), "few"), (spark.range(0), "none"), (spark.range(5000), "many")):
        _arrive(rows, str(tmp_path / name), 5)
        read = spark.read.schema(rows.schema).parquet(str(tmp_path / name))
        assert len(read.inputFiles()) == 5 and read.count() == rows.count()

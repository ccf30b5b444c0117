import json
import struct

import pytest
from pyspark.sql import functions as F

from wayline.sinks import tables, tracks
from wayline.operators import trips
from wayline.sources import catalogue, logs, registry, telemetry_files, texts


def one(spark, text, reader, **extra):
    return reader(spark.createDataFrame([(1, text)], "id INT, text STRING"), **extra).collect()


def test_gps_sentences(spark):
    text = (
        "[1700000001000]$GPGGA,120001.00,4807.038,N,01131.000,E,1,08,1.0,545.4,M,,M,,*5B\r\n"
        "[1700000001000]$GPRMC,120001.00,A,4807.038,N,01131.000,E,10.00,45.00,010124,,,A*6D\r\n"
        "[1700000002000]$GPRMC,120002.00,A,4807.038,S,01131.000,W,,,010124,,,N*6D\r\n"
        "[1700000003000]$GPRMC,120003.00,A,48,N,01131.000,E,1,1,010124,,,A*6D\r\n"
    )
    rows = one(spark, text, telemetry_files.gps_fixes)
    assert len(rows) == 2
    a, b = rows
    assert (a.lat, a.lon) == (pytest.approx(48 + 7.038 / 60), pytest.approx(11 + 31 / 60))
    assert (a.speed_kmh, a.course, a.altitude_m, a.valid) == (pytest.approx(18.52), 45.0, 545.4, True)
    assert (b.valid, b.speed_kmh, b.course, b.altitude_m) == (False, None, None, None)
    assert b.lat < 0 and b.lon < 0


def test_gsensor_bytes(spark):
    good = b"".join(struct.pack(">Ihhh", ms, x, -5, 7) for ms, x in ((0, 1), (70000, -32768), (4_000_000_000, 32767)))
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-1])), ("c", bytearray(b""))], "id STRING, content BINARY")
    rows = telemetry_files.gsensor_samples(df).collect()
    assert [(r.id, r.offset_ms, r.x, r.z) for r in rows] == [("a", 0, 1, 7), ("a", 70000, -32768, 7), ("a", 4_000_000_000, 32767, 7)]


def test_srt_variants(spark):
    text = "1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n\r\nnote\n\n7\nextra\n01:00:00,000 --> 01:00:01,250\n\n"
    rows = one(spark, text, texts.srt_cues)
    assert [(r.start_s, r.end_s, r.text) for r in rows] == [(1.5, 2.0, "Hello\nthere"), (3600.0, 3601.25, "")]


def test_scene_bullets(spark):
    text = "Intro - [t=1.5s] red  bus\n on the left - [ T = 0 .9 S ]two-[t=x]lost - [t=4]  \n- [t=5s] end"
    rows = one(spark, text, texts.scene_events)
    assert [(r.t_s, r.text) for r in rows] == [(1.5, "red bus on the left"), (0.9, "two"), (5.0, "end")]


def test_sign_reads(spark):
    text = (
        "# Zoomed Sign reads\n\nstray\n- [t=40.6s] road sign: 227\n259 TOWN\n\n500\n- [t=41s] plate: NOT LEGIBLE\n"
        "- no stamp\n# other\n- [t=50s] outside"
    )
    rows = one(spark, text, texts.sign_reads)
    assert [(r.t_s, r.text) for r in rows] == [(40.6, "road sign: 227 259 TOWN 500"), (0.0, "no stamp")]
    assert one(spark, "nothing here\n- [t=1s] x", texts.sign_reads) == []


def test_sign_reads_looks_at_a_text_once(spark):
    files = spark.createDataFrame([(1, "x")], "n long, text string").repartition(1)
    plan = texts.sign_reads(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:#|---)") == 1  # a generator evaluates a step as often as it is named
    odd = "- a\r\n## ZOOMED sign reads of the day\u2028- [t=2.5s]\x85 STOP \r\n  x\n## zoomed sign reads\n- [t=1.s] y\n-  \n- (NOT legible)\n - z\n --- \n- w"
    assert [(r.pos, r.t_s, r.text) for r in one(spark, odd, texts.sign_reads)] == [(0, 2.5, "STOP x"), (1, 0.0, "[t=1.s] y -"), (2, 0.0, "z")]


def test_lines_like_splitlines(spark):
    for text in ("a\nb\n", "a\r\n\r\nb", "", "\n", "a\x0bb c\x85", "a\r\n"):
        assert [r.line for r in one(spark, text, texts.text_lines)] == text.splitlines()


def test_history_lines(spark):
    base = {"command": "ls", "command_line": "ls x", "source": "cli", "username": None, "started_at": "2026-08-01T12:00:00+00:00", "duration_seconds": 1.5, "status": "failed"}
    lines = [
        json.dumps(base), json.dumps({**base, "params": {"a": "b", "c": True}}), json.dumps({**base, "more": 1}),
        json.dumps({k: v for k, v in base.items() if k != "status"}), '{"command": "cut', "", "[1]",
    ]
    rows = logs.history(spark.createDataFrame([(x,) for x in lines], "value STRING")).collect()
    assert [r.params for r in rows] == [None, {"a": "b", "c": "true"}]


def test_job_log_continues_across_files(spark):
    files = [
        ("s", "2026-01", "lost\n2026-01-31 23:59:59,001 [ls] one\n  more\n"),
        ("s", "2026-02", "still one\n2026-02-30 00:00:00,000 [ls] no such day\ntail\n2026-02-01 00:00:00,000 [gen] two\n"),
    ]
    lines = logs.job_log_lines(spark.createDataFrame(files, "stream STRING, file_order STRING, text STRING"))
    rows = logs.job_log_records(lines).orderBy("record_no").collect()
    assert [(r.source, r.message) for r in rows] == [("ls", "one\n  more\nstill one\ntail"), ("gen", "two")]


def test_catalogue_prefers_longer_suffix(spark):
    names = ["20260715_133255_NF.mp4", "20260715_133255_N.gps", "20260715_133255_N.diarized.transcript.txt", "readme.txt", "20260715_133255_N.xyz"]
    files = spark.createDataFrame([(1, f"/a/{n}", 10) for n in names], "camera_id INT, path STRING, length BIGINT")
    row = catalogue.catalogue(files).collect()
    assert len(row) == 1 and row[0].size_bytes == 30
    assert set(row[0].assets) == {"FRONT", "GPS", "TRANSCRIPT_DIARIZED"}


def test_gpx_text_and_files(spark, tmp_path):
    fixes = spark.createDataFrame(
        [(1, "r", i, 1_700_000_000_000_000 + i * 1_000_000, True, 59.5, 18.25, 36.0 if i else None, None) for i in range(3)]
        + [(2, "r", 0, 0, False, 1.0, 1.0, None, None)],
        "trip_id INT, recording_id STRING, pos BIGINT, ts_us BIGINT, valid BOOLEAN, lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE, course DOUBLE",
    ).withColumn("ts", F.expr("TIMESTAMP_NTZ'2023-11-14 22:13:20'"))
    trips = spark.createDataFrame([(1, "A & B"), (2, None)], "trip_id INT, name STRING")
    pieces = tracks.gpx_pieces(fixes, trips, ["trip_id"])
    tracks.write_pieces(pieces, str(tmp_path / "gpx"), "trip_id")
    import xml.etree.ElementTree as ET

    def document(trip):
        parts = sorted((tmp_path / "gpx" / f"trip_id={trip}").glob("part-*"))
        return "".join(p.read_text() for p in parts)

    ns = {"g": tracks.GPX_NS}
    root = ET.fromstring(document(1).split("?>", 1)[1])
    assert root.find("g:trk/g:name", ns).text == "A & B"
    points = root.findall(".//g:trkpt", ns)
    assert [p.attrib["lat"] for p in points] == ["59.5"] * 3
    assert points[1].find("g:extensions/g:speed", ns).text == "10.0" and points[0].find("g:extensions", ns) is None
    assert ET.fromstring(document(2).split("?>", 1)[1]).findall(".//g:trkpt", ns) == []
    kml = tracks.kml_pieces(fixes, trips, ["trip_id"])
    assert [r.trip_id for r in kml.select("trip_id").distinct().collect()] == [1]


def test_trip_info_leaves_unknown_out(spark):
    row = spark.range(1).select(
        F.lit("2026-01-01 00:00:00").alias("start_text"), F.lit(None).cast("string").alias("end_text"), F.lit(90061).alias("duration_s"),
        F.lit(12.345).alias("distance_km"), *[F.lit(None).cast("double").alias(c) for c in ("average_speed_kmh", "max_speed_kmh", "idle_seconds", "min_altitude_m", "max_altitude_m", "elevation_gain_m")],
        F.lit(61.5).alias("moving_seconds"), F.lit("").alias("start_address"), F.lit("Home").alias("end_address"),
        F.lit(False).alias("has_parking"), F.lit(1536).alias("size_bytes"),
    )
    text = tables.trip_info(row).first().text
    assert text == (
        "Started: 2026-01-01 00:00:00\nDuration: 1 day, 1:01:01\nDistance: 12.35 km\nMoving time: 0:01:02\n"
        "End location: Home\nTotal size: 1.50 KB\n"
    ) or "Distance: 12.34 km" in text


def test_adapter_reads_a_folder_tree(spark, tmp_path):
    cam = tmp_path / "cam1"
    cam.mkdir()
    (cam / "20260715_133255_NF.mp4").write_bytes(b"12345")
    (cam / "20260715_133255_N.gps").write_text("[1000]$GPRMC,120001.00,A,4807.038,N,01131.000,E,1.0,,010124,,,A*6D\n")
    (cam / "20260715_133255_N.3gf").write_bytes(struct.pack(">Ihhh", 0, 1, 2, 3))
    (cam / "20260715_133255_N.record_time.txt").write_text("60\n")
    got = registry.adapter("dashcam")(spark, str(tmp_path))
    assert got.recordings.first().assets.keys() == {"FRONT", "GPS", "GSENSOR"}
    assert got.fixes.count() == 1 and got.samples.first().z == 3 and got.snapshots.first().record_time_s == 60
    assert trips.roll_up(trips.detect(got.recordings)).count() == 1
    with pytest.raises(ValueError):
        registry.adapter("nothing")
    assert {"dashcam", "folder"} <= set(registry.names())


def test_adapter_without_telemetry_feeds_trips(spark, tmp_path):
    cam = tmp_path / "cam1"
    cam.mkdir()
    for name in ("20260715_133255_NF.mp4", "20260715_133355_NF.mp4", "20260715_180000_NF.mp4"):
        (cam / name).write_bytes(b"1")
    (cam / "20260715_133255_N.duration.txt").write_text("59.6\n")
    got = registry.adapter("dashcam")(spark, str(tmp_path))
    assert got.fixes.count() == 0 and got.samples.count() == 0
    found = trips.detect(got.recordings)
    assert [r.trip_no for r in found.orderBy("start_s").collect()] == [1, 1, 2]
    assert [r.duration_s for r in found.orderBy("start_s").collect()] == [60, None, None]
    assert trips.roll_up(found).count() == 2
    assert trips.detect(registry.adapter("folder")(spark, str(tmp_path)).recordings).count() == 3


def test_long_gps_log_numbers_what_it_keeps(spark):
    lines = []
    for i in range(4000):
        lines.append(f"[{i}]$GPGGA,120000.00,,,,,1,08,1.0,{i % 90},M,,M,,*5B")
        course = "x" if i % 10 == 3 else "45.0"
        lines.append(f"[{i}]$GPRMC,120001.00,A,4807.038,N,01131.000,E,10.00,{course},010124,,,A*6D")
    rows = spark.createDataFrame([("a", "\r\n".join(lines)), ("b", "\n".join(lines[:4]))], "recording_id string, text string")
    got = telemetry_files.gps_fixes(rows).orderBy("recording_id", "pos").collect()
    kept = [i for i in range(4000) if i % 10 != 3]
    assert [(r.pos, r.altitude_m, r.ts_us) for r in got if r.recording_id == "a"] == [(n, float(i % 90), i * 1000) for n, i in enumerate(kept)]
    assert [r.pos for r in got if r.recording_id == "b"] == [0, 1]


def test_feed_objects_over_many_chunks(spark):
    chunks = ['{"GPS": {"LATI', 'TUDE": 1.5,', " " * 9000, ' "LONGITUDE": 2.5}', '}--{"3G', '": {"FrontRear": 1,"LeftRight":2,"UpperLower":', "3", "}} {\"GPS\": {"]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "camera_id long, seq long, chunk string")
    whole = telemetry_files.stitched(rows, ["camera_id"], ["seq"], F.floor(F.col("seq") / 3))
    got = [(r.seq, r.sensor, r.lat, r.upper_lower) for r in telemetry_files.live_readings(whole).orderBy("seq").collect()]
    assert got == [(3, "gps", 1.5, None), (7, "3g", None, 3.0)]


def test_feed_texts_meet_without_a_join(spark):
    """Joined, the texts of a feed went through the driver, as the planner took them for as small as their file."""
    rows = spark.range(8).selectExpr("id % 2 AS camera_id", "id AS seq", "repeat(cast(id AS STRING), 9) || '}' AS chunk")
    whole = telemetry_files.stitched(rows, ["camera_id"], ["seq"], F.floor(F.col("seq") / 3))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # that of the scan
    assert "Broadcast" not in whole._jdf.queryExecution().sparkPlan().toString()
    assert {(r.camera_id, r.seq): r.chunk for r in whole.collect()} == {(i % 2, i): str(i) * 9 + "}" for i in range(8)}


def test_camera_files_source_opens_only_what_is_asked_for(spark, tmp_path):
    from wayline.sources import camera_files

    rows = [(f"cam{c}", f"rec{i}", f"{c}-{i}".encode()) for c in range(3) for i in range(4)] + [("cam1", "empty", b"")]
    root = str(tmp_path / "cams")
    camera_files.write_files(spark.createDataFrame(rows, "camera_id STRING, recording_id STRING, content BINARY"), root, ".gps")
    (tmp_path / "cams" / "cam1" / "rec1.3gf").write_bytes(b"other")
    (tmp_path / "cams" / "note.gps").write_text("no camera")
    every = registry.camera_logs(spark, root, ".gps")
    assert sorted((r.camera_id, r.recording_id, bytes(r.content)) for r in every.collect()) == sorted(rows)
    assert every.filter("size = 0").count() == 1
    asked = every.filter("camera_id = 'cam1' AND recording_id >= 'rec2'")
    assert sorted(r.recording_id for r in asked.collect()) == ["rec2", "rec3"]
    reader = camera_files.CameraFilesReader({"path": root, "ending": ".gps", "partitionBytes": "1"})
    left = list(reader.pushFilters([camera_files.EqualTo(("camera_id",), "cam1"), camera_files.In(("recording_id",), ("rec2", "rec3", "x")), camera_files.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)]
    assert [row[1:3] for part in reader.partitions() for row in part.rows] == [("cam1", "rec2"), ("cam1", "rec3")]
    assert registry.gps_logs(spark, root).filter("camera_id = 'cam2'").count() == 0

"""Explicit schemas of the core tables."""

RECORDINGS = """camera_id BIGINT, recording_id STRING, start_s BIGINT, kind STRING,
 duration_s BIGINT, size_bytes BIGINT, assets MAP<STRING,STRING>, timestamp_reliable BOOLEAN"""

GPS_FIX = """camera_id BIGINT, recording_id STRING, pos INT, ts TIMESTAMP_NTZ, valid BOOLEAN,
 lat DOUBLE, lon DOUBLE, speed_kmh DOUBLE, course DOUBLE, altitude_m DOUBLE"""

GSENSOR = "camera_id BIGINT, recording_id STRING, pos INT, offset_ms BIGINT, x INT, y INT, z INT"

SEGMENTS = "recording_id STRING, pos INT, start_s DOUBLE, end_s DOUBLE, text STRING"

TURNS = "recording_id STRING, pos INT, start_s DOUBLE, end_s DOUBLE, speaker STRING"

HISTORY = """command STRING, command_line STRING, source STRING, username STRING,
 started_at STRING, duration_seconds DOUBLE, status STRING, params MAP<STRING,STRING>"""

OVERPASS = """elements ARRAY<STRUCT<type: STRING, id: BIGINT,
 geometry: ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>, tags: MAP<STRING,STRING>>>"""

# Asset names in display order.
ASSETS = (
    "FRONT", "REAR", "INTERIOR", "GPS", "GSENSOR", "FRONT_THUMBNAIL", "REAR_THUMBNAIL",
    "INTERIOR_THUMBNAIL", "AUDIO", "DURATION", "THUMBNAIL", "TRANSCRIPT", "TRANSCRIPT_DIARIZED",
    "TRANSLATION", "TRANSLATION_DIARIZED", "SUBTITLES", "SCENE_DESCRIPTION",
    "SCENE_DESCRIPTION_REAR",
)

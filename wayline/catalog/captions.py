"""Subtitle, transcript and caption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions
from ..plans.chunked import spread
from ..sources import texts
from .bindings import SQL_TALK, members, segments, talk, turns
from .registry import query
from .trajectory import r

REC = ["recording_id"]
TRIP = ["trip_id"]

# expected values come from the plain lines, the reader sees the built text
SQL_LINES = r"""
raw AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM raw),
sq AS (SELECT doc_id, i, trim(regexp_replace(line, '[\s\p{Z}\x{85}\x1C-\x1F]+', ' ', 'g')) AS line FROM lines)
"""


def _squeezed_lines(t):
    clean = F.transform(texts.lines_of(F.col("text")), lambda x: texts.squeeze(x))
    return t.documents.select("doc_id", F.filter(clean, lambda x: x != "").alias("l"))


SQL_FULL = f"""
{SQL_LINES},
full_ AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM sq WHERE line <> '')
"""


@query("text_lines_numbered", f"""
WITH {SQL_LINES}
SELECT doc_id, i + 1 AS line_no, line FROM lines
WHERE NOT (line = '' AND i = (SELECT max(i) FROM lines m WHERE m.doc_id = lines.doc_id))
""")
def text_lines(t):
    return texts.text_lines(t.documents.select("doc_id", "text"))


@query("subtitles_parsed", f"""
WITH {SQL_FULL}
SELECT doc_id, pos, round(pos * 1.7::DOUBLE, 3) AS start_s, round(pos * 1.7::DOUBLE + 1.25, 3) AS end_s,
  line AS text FROM full_
""")
def subtitles_parsed(t):
    """Every document line becomes a cue of a subtitle file, then the file is read."""
    from ..functions.text import srt_time

    rows = _squeezed_lines(t)
    cue = F.transform(
        "l",
        lambda x, i: F.concat(
            (i + 1).cast("string"), F.lit("\n"), srt_time(i * 1.7), F.lit(" --> "),
            srt_time(i * 1.7 + 1.25), F.lit("\r\n"), x, F.lit("\n"),
        ),
    )
    files = rows.select("doc_id", F.array_join(cue, "\r\n").alias("text"))
    return r(texts.srt_cues(files), 3, "start_s", "end_s")


@query("scene_events_parsed", f"""
WITH {SQL_FULL}
SELECT doc_id, pos, round(pos * 1.3::DOUBLE, 1) AS t_s, line AS text FROM full_
""")
def scene_events_parsed(t):
    """Bullets on one line or many, with blanks in the stamp and bad stamps mixed in."""
    rows = _squeezed_lines(t)

    def bullet(x, i):
        stamp = F.format_string("%.1f", F.round(i * 1.3, 1))
        odd = F.concat(F.lit("- [ T = "), F.regexp_replace(stamp, r"\.", " ."), F.lit(" S ] "), x, F.lit(" "))
        plain = F.concat(F.lit("- [t="), stamp, F.lit("s] "), x, F.lit("\n"))
        bad = F.concat(F.lit("- [t=soon] lost words "), odd)
        return F.when(i % 3 == 1, odd).when(i % 3 == 2, bad).otherwise(plain)

    files = rows.select("doc_id", F.array_join(F.transform("l", bullet), "").alias("text"))
    return texts.scene_events(files)


@query("sign_reads_parsed", f"""
WITH {SQL_FULL},
part AS (SELECT *, pos // 2 AS b FROM full_ WHERE pos < (SELECT max(m.pos) + 1 FROM full_ m WHERE m.doc_id = full_.doc_id)),
bul AS (SELECT doc_id, b, string_agg('sign ' || line, ' ' ORDER BY pos) AS text FROM part GROUP BY doc_id, b),
ok AS (SELECT *, b % 5 <> 4 AND NOT contains(lower(text), 'not legible') AS legible FROM bul)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS pos,
  CASE WHEN b % 4 = 3 THEN 0.0 ELSE round(b * 2.5::DOUBLE, 1) END AS t_s, text
FROM ok WHERE legible
""")
def sign_reads_parsed(t):
    """Two lines per bullet, some illegible, some without stamp, other sections around."""
    rows = _squeezed_lines(t)

    def line(x, i):
        b = F.floor(i / 2)
        stamp = F.when(b % 4 == 3, F.lit("")).otherwise(
            F.concat(F.lit("[t="), F.format_string("%.1f", F.round(b * 2.5, 1)), F.lit("s] "))
        )
        head = F.concat(F.lit("- "), stamp, F.lit("sign "), x)
        lost = F.when(b % 5 == 4, F.lit(" (Not Legible)")).otherwise(F.lit(""))
        return F.concat(F.when(i % 2 == 0, head).otherwise(F.concat(F.lit("   sign "), x)), lost)

    body = F.array_join(F.transform("l", line), "\n")
    files = rows.select(
        "doc_id",
        F.concat(
            F.lit("# Scene\n- [t=1.0s] not a sign\n\n## Zoomed Sign Reads\n\n"), body,
            F.lit("\n\n---\n- [t=9.0s] footer\n"),
        ).alias("text"),
    )
    return texts.sign_reads(files)


SQL_SPEAKERS = f"""
{SQL_TALK},
cand AS (
  SELECT s.*, u.pos AS turn, u.speaker,
    (s.start_s + s.end_s) / 2 BETWEEN u.start_s AND u.end_s AS holds,
    least(s.end_s, u.end_s) - greatest(s.start_s, u.start_s) AS shared
  FROM segs s JOIN turns u ON u.recording_id = s.recording_id),
named AS (
  SELECT s.recording_id, s.pos, s.start_s, s.end_s, s.text, coalesce(
    (SELECT arg_min(c.speaker, c.turn) FROM cand c WHERE c.recording_id = s.recording_id AND c.pos = s.pos AND c.holds),
    (SELECT arg_max(c.speaker, (c.shared, -c.turn)) FROM cand c
      WHERE c.recording_id = s.recording_id AND c.pos = s.pos AND c.shared > 0)) AS speaker
  FROM segs s)
"""


def _named(t):
    return captions.attribute_speakers(segments(t), turns(t), REC)


@query("segments_speaker", f"WITH {SQL_SPEAKERS} SELECT recording_id, pos, speaker FROM named")
def segments_speaker(t):
    return _named(t).select("recording_id", "pos", "speaker")


SQL_RUNS = f"""
{SQL_SPEAKERS},
n AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(speaker) OVER w IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS o
  FROM named WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) AS run_no FROM n)
"""


@query("transcript_paragraphs", f"""
WITH {SQL_RUNS}
SELECT recording_id, run_no, '[' || coalesce(any_value(speaker), 'UNKNOWN') || '] ' || string_agg(text, ' ' ORDER BY pos) AS paragraph
FROM g GROUP BY recording_id, run_no
""")
def transcript_paragraphs(t):
    return captions.paragraphs(_named(t), REC)


@query("transcript_pieces", f"""
WITH {SQL_RUNS}
SELECT recording_id, pos, run_no,
  CASE WHEN o = 1 THEN '[' || coalesce(speaker, 'UNKNOWN') || '] ' ELSE ' ' END || text AS piece FROM g
""")
def transcript_pieces(t):
    return captions.paragraph_pieces(_named(t), REC).select("recording_id", "pos", "run_no", "piece")


@query("cues_nearest", f"""
WITH {SQL_TALK},
ask AS (SELECT recording_id, pos AS frame, from_ms / 700.0::DOUBLE AS at_s FROM talk)
SELECT recording_id, frame, any_value(at_s) AS at_s,
  arg_min(text, (abs(start_s - at_s), cue)) AS cue, round(min(abs(start_s - at_s)), 6) AS cue_gap_s
FROM (SELECT ask.*, s.start_s, s.text, s.pos AS cue FROM ask JOIN segs s USING (recording_id))
GROUP BY recording_id, frame
""")
def cues_nearest(t):
    asked = talk(t).select("recording_id", F.col("pos").alias("frame"), (F.col("from_ms") / 700).alias("at_s"))
    return r(captions.nearest_cues(asked, segments(t), REC), 6, "cue_gap_s")


SQL_OFFSETS = f"""
{SQL_TALK},
used AS (SELECT * FROM members WHERE kind <> 'P' AND video_s IS NOT NULL),
offs AS (SELECT *, sum(video_s) OVER (PARTITION BY trip_id ORDER BY recording_key) - video_s AS video_offset_s,
  sum(video_s) OVER (PARTITION BY trip_id) AS video_total_s FROM used),
mem AS (SELECT m.*, o.video_offset_s, coalesce(o.video_offset_s, CAST(m.start_s - m.trip_start_s AS DOUBLE)) AS shift
  FROM members m LEFT JOIN offs o USING (recording_id))
"""

def _member_chunk():
    return spread("recording_key", 1000)


def _offsets(t):
    return captions.video_offsets(members(t), TRIP, ["recording_key"], chunk=_member_chunk())


def _placed(t):
    offsets = _offsets(t).select("recording_id", "video_offset_s", "video_total_s")
    return members(t).join(offsets, REC, "left")


@query("trip_video_offsets", f"""
WITH {SQL_OFFSETS}
SELECT recording_id, trip_id, round(video_offset_s, 3) AS video_offset_s, round(video_total_s, 3) AS video_total_s FROM offs
""")
def video_offsets(t):
    out = _offsets(t).select("recording_id", "trip_id", "video_offset_s", "video_total_s")
    return r(out, 3, "video_offset_s", "video_total_s")


@query("trip_merged_samples", f"""
WITH {SQL_OFFSETS}
SELECT t.recording_id, pos, trip_id, from_ms + CAST(round(shift * 1000) AS BIGINT) AS trip_offset_ms
FROM talk t JOIN mem USING (recording_id)
""")
def merged_samples(t):
    samples = talk(t).select("recording_id", "pos", F.col("from_ms").alias("offset_ms"))
    placed = _placed(t).withColumn("video_offset_s", F.round("video_offset_s", 3))
    out = captions.merge_samples(samples, placed, REC)
    return out.select("recording_id", "pos", "trip_id", "trip_offset_ms")


@query("trip_merged_fixes", f"""
WITH {SQL_OFFSETS}
SELECT t.recording_id, pos, trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY (from_ms % 60000) * 1000, t.recording_id, pos) AS trip_pos
FROM talk t JOIN mem USING (recording_id)
""")
def merged_fixes(t):
    fixes = talk(t).select("recording_id", "pos", ((F.col("from_ms") % 60000) * 1000).alias("ts_us"))
    out = captions.merge_fixes(fixes, members(t), REC, spread("ts_us", 10_000_000))
    return out.select("recording_id", "pos", "trip_id", "trip_pos")


SQL_MERGED = f"""
{SQL_OFFSETS},
moved AS (SELECT trip_id, s.recording_id, pos, round(s.start_s + shift, 3) AS start_s, round(s.end_s + shift, 3) AS end_s, text
  FROM segs s JOIN mem USING (recording_id)),
tot AS (SELECT DISTINCT trip_id, round(video_total_s, 3) AS total FROM offs),
fin AS (SELECT trip_id, max(end_s) AS last FROM moved GROUP BY 1),
every AS (SELECT *, false AS pad FROM moved UNION ALL
  SELECT trip_id, '', 0, greatest(last, total - 1), total, '', true FROM fin JOIN tot USING (trip_id) WHERE last < total)
"""


def _srt(column: str) -> str:
    ms = f"CAST(round_even({column} * 1000, 0) AS BIGINT)"
    return (
        f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
    )


@query("trip_merged_subtitles", f"""
WITH {SQL_MERGED},
num AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY pad, start_s, recording_id, pos) AS cue_no FROM every)
SELECT trip_id, cue_no, cue_no || chr(10) || {_srt('start_s')} || ' --> ' || {_srt('end_s')} || chr(10) || text || chr(10) AS block
FROM num
""")
def merged_subtitles(t):
    placed = _placed(t)
    totals = placed.filter("video_total_s IS NOT NULL").groupBy("trip_id").agg(
        F.round(F.max("video_total_s"), 3).alias("video_total_s")
    )
    cues = captions.merge_subtitles(segments(t), placed, REC, totals)
    blocks = captions.srt_blocks(r(cues, 3, "start_s", "end_s"))
    return blocks.select("trip_id", "cue_no", "block")


@query("trip_wallclock", f"""
WITH {SQL_OFFSETS},
pts AS (SELECT trip_id, round(video_offset_s, 3) AS position_s, start_s + CASE WHEN recording_key % 4 = 1 THEN 2.5 ELSE 0 END::DOUBLE AS wall FROM offs),
ask AS (SELECT trip_id, recording_id, pos, from_ms / 500.0::DOUBLE AS at_s, trip_start_s FROM talk JOIN members USING (recording_id)),
hit AS (SELECT ask.*, p.position_s, p.wall FROM ask ASOF LEFT JOIN pts p ON p.trip_id = ask.trip_id AND ask.at_s >= p.position_s),
f AS (SELECT trip_id, min(position_s) AS fp, arg_min(wall, position_s) AS fw FROM pts GROUP BY 1)
SELECT recording_id, pos, round(coalesce(wall + at_s - position_s, fw + at_s - fp, trip_start_s + at_s), 3) AS wallclock_s
FROM hit LEFT JOIN f USING (trip_id)
""")
def trip_wallclock(t):
    late = F.when(F.col("recording_key") % 4 == 1, F.lit(2.5))
    points = captions.breakpoints(_offsets(t).withColumn("overlap_s", late))
    asked = talk(t).join(members(t), REC).select(
        "trip_id", "recording_id", "pos", (F.col("from_ms") / 500).alias("at_s"),
        F.col("trip_start_s").cast("double").alias("fallback_start_s"),
    )
    out = captions.wallclock(asked, r(points, 3, "position_s"))
    return r(out.select("recording_id", "pos", "wallclock_s"), 3, "wallclock_s")


@query("trip_video_breakpoints", f"""
WITH {SQL_OFFSETS}
SELECT trip_id, round(video_offset_s, 3) AS position_s,
  start_s + CASE WHEN recording_key % 4 = 1 THEN 2.5 ELSE 0 END::DOUBLE AS wallclock_s FROM offs
""")
def video_breakpoints(t):
    late = F.when(F.col("recording_key") % 4 == 1, F.lit(2.5))
    return r(captions.breakpoints(_offsets(t).withColumn("overlap_s", late)), 3, "position_s")


def _reads(t):
    return talk(t).select("recording_id", "pos", (F.col("from_ms") % 7000 / 1000).alias("t_s"), "text")


@query("sign_cues", f"""
WITH RECURSIVE {SQL_TALK},
reads AS (SELECT recording_id, pos, from_ms % 7000 / 1000.0::DOUBLE AS t_s FROM talk),
cue AS (SELECT recording_id, pos, greatest(t_s, 0) AS start_s FROM reads WHERE pos = 0
  UNION ALL SELECT r.recording_id, r.pos, greatest(r.t_s, c.start_s + 3)
  FROM cue c JOIN reads r ON r.recording_id = c.recording_id AND r.pos = c.pos + 1)
SELECT recording_id, pos, round(start_s, 3) AS start_s, round(start_s + 3, 3) AS end_s FROM cue
""")
def sign_cues(t):
    out = captions.sign_cues(_reads(t), REC)
    return r(out.select("recording_id", "pos", "start_s", "end_s"), 3, "start_s", "end_s")


SQL_EVENTS = f"""
{SQL_TALK},
d AS (SELECT recording_id, pos, pos * 1.3::DOUBLE - 0.3::DOUBLE AS t_s, text, CAST(8 + conv_id % 40 AS DOUBLE) AS video_s FROM talk),
resc AS (SELECT *, count(*) OVER w AS events, max(t_s) OVER w AS latest FROM d WINDOW w AS (PARTITION BY recording_id)),
res2 AS (SELECT *, CASE WHEN latest > 0 THEN t_s * (video_s * events / (events + 1) / latest) ELSE t_s END AS r_s FROM resc),
lagged AS (SELECT *, least(r_s + video_s / 16 * 1.5::DOUBLE, video_s * events / (events + 1)) AS l_s FROM res2)
"""


def _events(t):
    return talk(t).select(
        "recording_id", "pos", (F.col("pos") * 1.3 - 0.3).alias("t_s"), "text",
        (8 + F.col("conv_id") % 40).cast("double").alias("video_s"),
    )


@query("events_rescaled", f"WITH {SQL_EVENTS} SELECT recording_id, pos, round(r_s, 6) AS t_s FROM res2")
def events_rescaled(t):
    out = captions.rescale_events(_events(t), REC)
    return r(out.select("recording_id", "pos", "t_s"), 6, "t_s")


@query("events_lag_shifted", f"WITH {SQL_EVENTS} SELECT recording_id, pos, round(l_s, 6) AS t_s FROM lagged")
def events_lag_shifted(t):
    out = captions.lag_events(captions.rescale_events(_events(t), REC))
    return r(out.select("recording_id", "pos", "t_s"), 6, "t_s")


@query("frames_nominal", f"""
WITH {SQL_TALK}
SELECT recording_id, frame, round(video_s * frame / 16, 6) AS at_s
FROM (SELECT *, unnest(range(16)) AS frame FROM members WHERE video_s > 0)
""")
def frames_nominal(t):
    return r(captions.nominal_times(members(t)).select("recording_id", "frame", "at_s"), 6, "at_s")


@query("captions_merged", f"""
WITH RECURSIVE {SQL_EVENTS},
every AS (SELECT recording_id, round(l_s, 3) AS t_s, pos AS rank, text, video_s FROM lagged
  UNION ALL SELECT recording_id, round(from_ms / 4000.0::DOUBLE, 3), 1000000 + pos, speaker, CAST(8 + conv_id % 40 AS DOUBLE) FROM talk),
ord AS (SELECT *, row_number() OVER w AS rn, least(coalesce(lead(t_s) OVER w, video_s), video_s) AS nxt
  FROM every WINDOW w AS (PARTITION BY recording_id ORDER BY t_s, rank)),
walk AS (
  SELECT recording_id, 0::BIGINT AS rn, 0.0::DOUBLE AS cur, 0.0::DOUBLE AS dcur, NULL::VARCHAR AS pend,
    NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::VARCHAR AS said FROM ord WHERE rn = 1
  UNION ALL
  SELECT recording_id, rn, CASE WHEN en > st THEN en ELSE cur END, CASE WHEN en > st THEN
      greatest(least(greatest(st + 2, ds + sp), en), ds) ELSE dcur END,
    CASE WHEN en > st THEN NULL ELSE txt END, CASE WHEN en > st THEN ds END,
    CASE WHEN en > st THEN greatest(least(greatest(st + 2, ds + sp), en), ds) END, CASE WHEN en > st THEN txt END
  FROM (SELECT *, greatest(greatest(0, st - 2), dcur) AS ds, greatest(2, length(txt) / 12.0::DOUBLE + 1) AS sp FROM (
    SELECT *, greatest(nxt, st) AS en FROM (
      SELECT o.recording_id, o.rn, w.cur, w.dcur, o.nxt, greatest(least(o.t_s, o.video_s), w.cur) AS st,
        CASE WHEN w.pend IS NULL THEN o.text ELSE w.pend || ' ' || o.text END AS txt
      FROM walk w JOIN ord o ON o.recording_id = w.recording_id AND o.rn = w.rn + 1))))
SELECT recording_id, round(a, 3) AS start_s, round(b, 3) AS end_s, said AS text FROM walk WHERE said IS NOT NULL
""")
def captions_merged(t):
    told = captions.lag_events(captions.rescale_events(_events(t), REC)).select(
        "recording_id", F.round("t_s", 3).alias("t_s"), F.col("pos").alias("rank"), "text", "video_s"
    )
    signs = talk(t).select(
        "recording_id", F.round(F.col("from_ms") / 4000, 3).alias("t_s"),
        (1000000 + F.col("pos")).alias("rank"), F.col("speaker").alias("text"),
        (8 + F.col("conv_id") % 40).cast("double").alias("video_s"),
    )
    return r(captions.merge_captions(told.unionByName(signs), REC), 3, "start_s", "end_s")

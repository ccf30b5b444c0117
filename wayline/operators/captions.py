"""Speaker attribution, subtitle alignment and caption timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import srt_time
from ..plans.asof import bracket
from ..plans.chunked import attach, scan, spread
from ..plans.overlap import overlap_join
from ..session import settle

# Fixed values of caption timing (seconds, characters per second).
SIGN_CUE_S = 3.0
FRAMES = 16
LAG_FACTOR = 1.5
LEAD_S, TRAIL_S, MIN_READ_S, READ_PAD_S, CHARS_PER_S = 2.0, 2.0, 2.0, 1.0, 12.0

CHUNK_S = 600
CHUNK_ROWS = 4096


def attribute_speakers(
    segments: DataFrame, turns: DataFrame, keys: Sequence[str], width_s: float = 30.0
) -> DataFrame:
    """Add ``speaker``: first turn holding the segment's middle, else largest overlap."""
    s = segments.select(*keys, F.col("pos").alias("_seg"), F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    u = turns.select(
        *keys, F.col("pos").alias("_turn"), F.col("start_s").alias("_c"), F.col("end_s").alias("_d"), "speaker"
    )
    met = overlap_join(s, u, keys, ("_a", "_b"), ("_c", "_d"), width_s)
    middle = (F.col("_a") + F.col("_b")) / 2
    holds = (F.col("_c") <= middle) & (middle <= F.col("_d"))
    shared = F.least("_b", "_d") - F.greatest("_a", "_c")
    best = met.groupBy(*keys, "_seg").agg(
        F.min_by("speaker", F.when(holds, F.col("_turn"))).alias("_held"),
        F.max_by("speaker", F.when(shared > 0, F.struct(shared, -F.col("_turn")))).alias("_most"),
    )
    named = best.select(*keys, F.col("_seg").alias("pos"), F.coalesce("_held", "_most").alias("speaker"))
    return segments.join(named, [*keys, "pos"], "left")


def speaker_runs(segments: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``run_no`` over consecutive segments of one speaker, and ``opens``."""
    who = F.struct("speaker")

    def mark(df: DataFrame) -> DataFrame:
        return df.withColumn("opens", ~F.coalesce(F.col("_was").eqNullSafe(F.struct("speaker")), F.lit(False)))

    return scan(
        segments, keys, ["pos"], spread("pos", chunk_rows), prev={"_was": who}, derive=mark,
        derive_from=["speaker"], total={"run_no": F.col("opens").cast("bigint")},
    ).drop("_was")


def paragraph_pieces(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transcript in order, one piece per segment; pieces of a run make one paragraph.

    The label stands on the first piece. Nothing is gathered, so a speech of any
    length stays spread over its segments.
    """
    label = F.concat(F.lit("["), F.coalesce("speaker", F.lit("UNKNOWN")), F.lit("] "))
    runs = speaker_runs(segments, keys)
    return runs.withColumn(
        "piece", F.when(F.col("opens"), F.concat(label, "text")).otherwise(F.concat(F.lit(" "), "text"))
    ).drop("opens")


def paragraphs(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per paragraph, for paragraphs known to fit one value."""
    pieces = paragraph_pieces(segments, keys)
    return pieces.groupBy(*keys, "run_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), ""
        ).alias("paragraph")
    )


def nearest_cues(times: DataFrame, cues: DataFrame, keys: Sequence[str], chunk_s: float = CHUNK_S) -> DataFrame:
    """Add ``cue`` and ``cue_gap_s``: the cue starting closest to ``at_s`` either way.

    Of equally close cues the first in file order counts.
    """
    firsts = cues.groupBy(*keys, F.col("start_s").alias("at_s")).agg(
        F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text")
    ).withColumn("start_s", F.col("at_s"))
    near = bracket(
        times, firsts, keys, "at_s", ["start_s", "pos", "text"], spread("_at", chunk_s),
        before="_a", after="_b",
    )

    def ranked(c: str) -> Column:
        x = F.col(c)
        return F.when(
            x.isNotNull(),
            F.struct(F.abs(x["start_s"] - F.col("at_s")).alias("gap"), x["pos"].alias("pos"), x["text"].alias("text")),
        )

    best = F.least(ranked("_a"), ranked("_b"))
    return near.withColumn("_best", best).select(
        *times.columns, F.coalesce("_best.text", F.lit("")).alias("cue"), F.col("_best.gap").alias("cue_gap_s")
    )


def video_offsets(
    recordings: DataFrame, keys: Sequence[str], order: Sequence[str], *, include_parking: bool = False,
    chunk: Column,
) -> DataFrame:
    """Recordings in the joined video with ``video_offset_s`` and ``video_total_s``.

    Parking rows (unless wanted) and rows without a probed ``video_s`` take no part.
    """
    used = recordings.filter("video_s IS NOT NULL")
    if not include_parking:
        used = used.filter("kind <> 'P'")
    out = scan(
        used, keys, order, chunk, total={"_upto": F.col("video_s")},
        whole={"video_total_s": (F.sum("video_s"), F.sum)},
    )
    return out.withColumn("video_offset_s", F.col("_upto") - F.col("video_s")).drop("_upto")


def rebase(members: DataFrame) -> Column:
    """Shift of a recording inside its trip: video offset, else the start gap."""
    return F.coalesce(
        F.col("video_offset_s"), (F.col("start_s") - F.col("trip_start_s")).cast("double")
    )


def merge_samples(samples: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """G-sensor samples on the time line of their trip (``trip_offset_ms``)."""
    shift = members.select(*on, "trip_id", F.round(rebase(members) * 1000, 0).cast("bigint").alias("_shift"))
    return samples.join(shift, on).withColumn(
        "trip_offset_ms", F.col("_shift") + F.col("offset_ms")
    ).drop("_shift")


def merge_fixes(fixes: DataFrame, members: DataFrame, on: Sequence[str], chunk: Column) -> DataFrame:
    """Fixes with their trip and their 1-based place in its merged track."""
    joined = fixes.join(members.select(*on, "trip_id"), on)
    return scan(joined, ["trip_id"], ["ts_us", *[c for c in on if c != "trip_id"], "pos"], chunk, number="trip_pos")


def merge_subtitles(
    cues: DataFrame, members: DataFrame, on: Sequence[str], totals: DataFrame, chunk_s: float = CHUNK_S
) -> DataFrame:
    """Cues of a trip on one time line, numbered, with an empty cue up to the video end.

    ``totals`` has trip_id and video_total_s.
    """
    shift = members.select(*on, "trip_id", rebase(members).alias("_shift"))
    moved = cues.join(shift, on).select(
        "trip_id", (F.col("start_s") + F.col("_shift")).alias("start_s"),
        (F.col("end_s") + F.col("_shift")).alias("end_s"), "text",
        F.struct(*[F.col(c).cast("string") for c in on]).alias("_src"), F.col("pos").alias("_pos"),
    )
    last = moved.groupBy("trip_id").agg(F.max("end_s").alias("_last")).join(totals, "trip_id")
    pad = last.filter("_last < video_total_s").select(
        "trip_id", F.greatest(F.col("_last"), F.col("video_total_s") - 1.0).alias("start_s"),
        F.col("video_total_s").alias("end_s"), F.lit("").alias("text"),
        F.lit(None).cast(moved.schema["_src"].dataType).alias("_src"), F.lit(2**62).alias("_pos"),
    )
    both = moved.unionByName(pad).withColumn("_pad", F.col("_src").isNull())
    return scan(
        both, ["trip_id"], ["_pad", "start_s", "_src", "_pos"],
        F.struct("_pad", spread("start_s", chunk_s).alias("c")), number="cue_no",
    ).drop("_src", "_pos", "_pad")


def breakpoints(members: DataFrame) -> DataFrame:
    """Video position to wall clock pairs, shifted by a detected overlap."""
    late = F.coalesce(F.col("overlap_s"), F.lit(0.0))
    return members.filter("video_offset_s IS NOT NULL").select(
        "trip_id", F.col("video_offset_s").alias("position_s"),
        (F.col("start_s") + late).alias("wallclock_s"),
    )


def wallclock(positions: DataFrame, points: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Add ``wallclock_s`` of each video ``at_s``; without any point the fallback start counts."""
    near = bracket(
        positions, points.withColumn("at_s", F.col("position_s")), ["trip_id"], "at_s",
        ["position_s", "wallclock_s"], spread("_at", chunk_s), before="_a", after="_b",
    )
    p = F.coalesce("_a", "_b")
    return near.select(
        *positions.columns,
        F.coalesce(
            p["wallclock_s"] + F.col("at_s") - p["position_s"], F.col("fallback_start_s") + F.col("at_s")
        ).alias("wallclock_s"),
    )


def sign_cues(reads: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Three-second cues that never overlap, in file order.

    start(i) = max(t(i), start(i-1) + 3) equals 3i + running max of (t(j) - 3j).
    """
    spare = F.greatest(F.col("t_s") - SIGN_CUE_S * F.col("pos"), F.lit(0.0) - SIGN_CUE_S * F.col("pos"))
    out = scan(reads, keys, ["pos"], spread("pos", chunk_rows), peak={"_peak": spare})
    start = F.col("_peak") + SIGN_CUE_S * F.col("pos")
    return out.withColumn("start_s", start).withColumn("end_s", start + SIGN_CUE_S).drop("_peak")


def rescale_events(events: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Stretch event times so that the latest lands at n / (n + 1) of the duration."""
    known = attach(
        events, keys, spread("pos", chunk_rows),
        {"_latest": (F.max("t_s"), F.max), "events": (F.count(F.lit(1)), F.sum)},
    )
    target = F.col("video_s") * F.col("events") / (F.col("events") + 1)
    return known.withColumn(
        "t_s", F.when(F.col("_latest") > 0, F.col("t_s") * (target / F.col("_latest"))).otherwise(F.col("t_s"))
    ).drop("_latest")


def curve(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup, flat beyond the end knots."""
    out = F.when(fraction <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(fraction <= x1, y0 + (fraction - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


FLAT_CURVE = ((0.0, 0.0), (1.0, 0.0))


def lag_events(events: DataFrame, knots: Sequence[tuple[float, float]] = FLAT_CURVE) -> DataFrame:
    """Shift rescaled events by the sampling lag, capped at n / (n + 1) of the duration.

    Needs ``events`` (their number) and a dense ``pos`` as made by ``rescale_events``.
    """
    n = F.col("events")
    fraction = F.when(n > 1, F.col("pos") / (n - 1)).otherwise(F.lit(0.0))
    late = F.col("t_s") + F.col("video_s") / FRAMES * LAG_FACTOR + curve(fraction, knots)
    shifted = F.least(late, F.col("video_s") * n / (n + 1))
    return events.withColumn("t_s", F.when(F.col("video_s") > 0, shifted).otherwise(F.col("t_s")))


def nominal_times(recordings: DataFrame, count: int = FRAMES) -> DataFrame:
    """``count`` evenly spaced times over each recording."""
    frames = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    return recordings.filter("video_s > 0").withColumn("frame", frames).withColumn(
        "at_s", F.col("video_s") * F.col("frame") / count
    )


def merge_captions(events: DataFrame, keys: Sequence[str], chunk_s: float = CHUNK_S) -> DataFrame:
    """Display windows of events and sign reads merged on one time line.

    ``events`` has t_s, text, ``rank`` (unique order for equal times) and video_s, times
    already corrected. Rows of one clamped time share a cue; what lands on the video end
    has no room and is dropped. A cue shows from 2 s before to 2 s after its moment,
    longer for long text, never into the next moment and never over the cue before.

    A cue's end is a clamped shift of the end before it, and such steps compose: recordings are walked in blocks whose
    summaries are composed in turn, so a burst of any length is spread over tasks.
    """
    at = F.greatest(F.least(F.col("t_s"), F.col("video_s")), F.lit(0.0))
    cues = (
        events.filter("video_s > 0").withColumn("s", at).filter("s < video_s")
        .groupBy(*keys, "video_s", "s")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("t_s", "rank", "text"))), lambda e: e["text"]
                ), " ",
            ).alias("text")
        )
        .withColumn(
            "c",
            F.greatest(F.lit(MIN_READ_S), F.length("text") / F.lit(CHARS_PER_S) + F.lit(READ_PAD_S)),
        )
    )

    def loose(df: DataFrame) -> DataFrame:
        p = F.col("_p")
        gap = F.col("s") - p["s"]
        early = F.greatest(F.col("s") - LEAD_S, F.lit(0.0))
        settled = (p["s"] + TRAIL_S >= F.col("s")) | (
            p["s"] + F.greatest(F.lit(TRAIL_S), p["c"]) <= early
        )
        free = p.isNull() | settled
        # start of a free cue: touching the one before, or the full lead
        start = F.when(p.isNotNull() & (p["s"] + TRAIL_S >= F.col("s")), F.col("s")).otherwise(early)
        return df.withColumn("_free", free).withColumn("_start", F.when(free, start)).withColumn("_gap", gap)

    marked = scan(
        cues, keys, ["s"], spread("s", chunk_s), prev={"_p": F.struct("s", "c")},
        nxt={"_next_s": F.col("s")}, derive=loose, derive_from=["s", "c"],
        number="_n",
    ).withColumn("e", F.coalesce("_next_s", "video_s"))
    return _show(marked, keys)


#: Rows of a block, and blocks under one summary.
BLOCK = 64

# What a run of cues makes of the end before it: x -> least(greatest(x + by, low), high). Such steps compose.
_STEP = "STRUCT<by: DOUBLE, low: DOUBLE, high: DOUBLE>"


def _clamp(x: Column, step: Column) -> Column:
    return F.least(F.greatest(x + step["by"], step["low"]), step["high"])


def _compose(first: Column, then: Column) -> Column:
    """One step for two in a row."""
    return F.struct(
        (first["by"] + then["by"]).alias("by"), _clamp(first["low"], then).alias("low"), _clamp(first["high"], then).alias("high")
    )


def _cue_step(x: Column) -> Column:
    """A free cue ends where it ends; another one starts behind the cue before it and reads on from there."""
    lead = F.greatest(x["s"] - LEAD_S, F.lit(0.0))
    fixed = F.greatest(F.least(F.greatest(x["s"] + TRAIL_S, x["_start"] + x["c"]), x["e"]), x["_start"])
    low = F.least(F.greatest(x["s"] + TRAIL_S, lead + x["c"]), x["e"])
    free = x["_start"].isNotNull()
    return F.struct(
        x["c"].alias("by"), F.when(free, fixed).otherwise(low).alias("low"), F.when(free, fixed).otherwise(x["e"]).alias("high")
    )


def _fold_steps(steps: Column) -> Column:
    rest = F.slice(steps, 2, F.size(steps))
    return F.aggregate(rest, F.element_at(steps, 1).cast(_STEP), lambda acc, x: _compose(acc, x).cast(_STEP))


def _show(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start and end of every cue, by a scan of composed steps over blocks, and over blocks of blocks.

    The end before a block comes down from the summary above it, so a recording of any number of cues in one burst
    is spread over tasks, and no task holds more than a block."""
    row = F.struct("s", "e", "c", "text", "_start")
    blocks = marked.groupBy(*keys, F.floor((F.col("_n") - 1) / BLOCK).cast("bigint").alias("_at")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")  # at most a block
    )
    blocks = settle(blocks, "caption-blocks")
    most = blocks.agg(F.max("_at").alias("n")).first()["n"] or 0  # one number
    level = blocks.filter(F.lit(most > 0)).select(*keys, "_at", _fold_steps(F.transform("rows", _cue_step)).alias("step"))
    levels = []
    while most > 0:
        level = level.groupBy(*keys, F.floor(F.col("_at") / BLOCK).cast("bigint").alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("_at", "step"))).alias("parts")
        ).withColumnRenamed("_up", "_at")
        levels.append(settle(level, "caption-levels"))
        most //= BLOCK
        level = levels[-1].select(*keys, "_at", _fold_steps(F.col("parts.step")).alias("step"))
    if levels:
        ends = levels[-1].select(*keys, "_at", F.lit(0.0).alias("_end"))
        for parts in reversed(levels):
            # ends before each part, one after the other
            prefix = F.aggregate(
                "parts", F.array(F.col("_end")).cast("array<double>"),
                lambda done, x: F.concat(done, F.array(_clamp(F.element_at(done, -1), x["step"]))),
            )
            ends = parts.join(ends, [*keys, "_at"]).select(*keys, F.explode(F.arrays_zip(F.col("parts._at").alias("at"), prefix.alias("end"))).alias("_e"))
            ends = ends.filter("_e.at IS NOT NULL").select(*keys, F.col("_e.at").alias("_at"), F.col("_e.end").alias("_end"))
        blocks = blocks.join(ends, [*keys, "_at"])
    else:
        blocks = blocks.withColumn("_end", F.lit(0.0))
    cue = "STRUCT<start_s: DOUBLE, end_s: DOUBLE, text: STRING>"

    def show(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)["end_s"]
        start = F.coalesce(x["_start"], F.greatest(F.greatest(x["s"] - LEAD_S, F.lit(0.0)), before))
        return F.concat(done, F.array(F.struct(start.alias("start_s"), _clamp(before, _cue_step(x)).alias("end_s"), x["text"].alias("text"))))

    seed = F.array(F.struct(F.lit(None).alias("start_s"), F.col("_end").alias("end_s"), F.lit(None).alias("text")))
    folded = F.aggregate("rows", seed.cast(f"ARRAY<{cue}>"), show)
    return blocks.select(*keys, F.explode(F.slice(folded, 2, BLOCK)).alias("_c")).select(*keys, "_c.*")


def srt_blocks(cues: DataFrame, number: str = "cue_no", speaker: str | None = None) -> DataFrame:
    """Add ``block``: the subtitle text of each numbered cue; blocks in order make the file."""
    text = F.col("text")
    if speaker:
        text = F.concat(F.lit("["), F.coalesce(F.col(speaker), F.lit("UNKNOWN")), F.lit("] "), text)
    return cues.withColumn(
        "block",
        F.concat(
            F.col(number).cast("string"), F.lit("\n"), srt_time("start_s"), F.lit(" --> "),
            srt_time("end_s"), F.lit("\n"), text, F.lit("\n"),
        ),
    )

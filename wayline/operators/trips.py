"""Trip detection: gap, bridge, force-split, unreliable-time and parking-cap rules."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.ids import Interval
from ..plans.asof import bracket
from ..plans.chunked import scan, spread
from ..session import settle

# Default gap, tolerance on top of it, and parking cap (seconds).
MAX_GAP_S = 300
GAP_TOLERANCE_S = 10
PARKING_CAP_S = 3600

Rule = Callable[[Column], Column]
"""Given the previous row as a STRUCT column, a text reason or NULL.

The current row is reached with plain ``F.col(name)``."""

KEY = ["camera_id"]
ORDER = ["start_s", "recording_key"]
DAY_S = 86400

NEEDED = ["start_s", "recording_key", "recording_id", "kind", "duration_s", "timestamp_reliable"]


def _gap(prev: Column) -> Column:
    return F.col("start_s") - (prev["start_s"] + F.coalesce(prev["duration_s"], F.lit(0)))


def detect(
    recordings: DataFrame,
    *,
    max_gap_s: float = MAX_GAP_S,
    tolerance_s: float = GAP_TOLERANCE_S,
    bridge: Rule | None = None,
    force_split: Rule | None = None,
    parking_cap_s: float | None = None,
    extra: tuple[str, ...] = (),
    chunk_s: int = DAY_S,
) -> DataFrame:
    """Recordings with the split decision and trip identity of each.

    Adds ``prev`` (STRUCT), ``gap_s``, ``rule`` (first, cap, unreliable, force, gap,
    bridged, within), ``force_reason``, ``bridge_reason``, ``parking_total_s``,
    ``split``, ``trip_no`` and ``trip_start_key``. ``extra`` names columns the rules
    read. Rules are checked in the order cap, unreliable, force, gap / bridge.
    """
    needed = [*NEEDED, *extra]
    threshold = max_gap_s + tolerance_s
    row = F.struct(*[F.col(c) for c in needed])
    prev = F.col("prev")
    first = prev.isNull()
    unreliable = ~F.col("timestamp_reliable") | ~prev["timestamp_reliable"]

    def decide(df: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        df = df.withColumn("gap_s", _gap(prev)).withColumns(
            {
                "force_reason": F.when(~unreliable, force_split(prev)) if force_split else none,
                "bridge_reason": F.when(F.col("gap_s") > threshold, bridge(prev)) if bridge else none,
            }
        )
        rule = (
            F.when(first, "first")
            .when(unreliable, "unreliable")
            .when(F.col("force_reason").isNotNull(), "force")
            .when((F.col("gap_s") > threshold) & F.col("bridge_reason").isNull(), "gap")
            .when(F.col("gap_s") > threshold, "bridged")
            .otherwise("within")
        )
        df = df.withColumn("rule", rule)
        return df.withColumn("split", F.col("rule").isin("first", "unreliable", "force", "gap"))

    def numbered(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("_at", F.struct("start_s", "recording_key"))
            .withColumn("trip_start_s", F.col("_start")["start_s"])
            .withColumn("trip_start_key", F.col("_start")["recording_key"])
            .drop("_at", "_start")
        )

    marks = {"trip_no": F.col("split").cast("bigint")}
    begin = {"_start": F.when(F.col("split"), F.struct("start_s", "recording_key"))}

    if parking_cap_s is None:
        done = scan(
            recordings, KEY, ORDER, spread("start_s", chunk_s),
            prev={"prev": row}, derive=decide, derive_from=needed, total=marks, fill=begin,
        ).withColumn("parking_total_s", F.lit(0).cast("bigint"))
        return numbered(done)

    capped = _apply_cap(recordings, row, needed, decide, parking_cap_s, chunk_s)
    return numbered(
        scan(capped, KEY, ORDER, spread("start_s", chunk_s), total=marks, fill=begin)
    )


def _apply_cap(recordings, row, needed, decide, cap_s, chunk_s) -> DataFrame:
    """Parking cap. Only runs whose parking time passes the cap are looked into.

    A run is a stretch of parking rows without any other split; the running total
    never crosses a run edge.
    """
    parking = F.col("kind") == "P"
    added = F.when(parking, F.coalesce(F.col("duration_s"), F.lit(0))).otherwise(F.lit(0))
    prev_parking = F.coalesce(F.col("prev")["kind"] == "P", F.lit(False))

    def runs(df: DataFrame) -> DataFrame:
        df = decide(df).withColumn("_added", added.cast("bigint"))
        return df.withColumn("_opens", parking & (F.col("split") | ~prev_parking))

    marked = settle(
        scan(
            recordings, KEY, ORDER, spread("start_s", chunk_s),
            prev={"prev": row}, derive=runs, derive_from=needed,
            total={"_run": F.col("_opens").cast("bigint")},
        ),
        "parking-runs",
    )
    in_run = marked.filter(parking)
    totals = in_run.groupBy("camera_id", "_run").agg(
        F.sum("_added").alias("_run_total"), F.count(F.lit(1)).alias("_run_rows")
    )
    over = totals.filter(F.col("_run_total") > cap_s).select("camera_id", "_run")
    in_over = in_run.join(over, ["camera_id", "_run"], "left_semi").select(
        "camera_id", "_run", "start_s", "recording_key", "_added"
    )
    cuts, last = _cap_cuts(in_over, totals, int(cap_s))
    # total still running when a run ends: that of the last cut on, else the plain sum
    ends = totals.join(last, ["camera_id", "_run"], "left").select(
        "camera_id",
        F.col("_run").alias("_ref"),
        F.coalesce("_last_held", "_run_total").alias("_carried"),
    )
    # rows without a run before them get a key of their own that matches nothing; NULL
    # keys would all meet in one task
    ref = F.when(
        prev_parking & (F.col("_opens") | ~parking),
        F.col("_run") - F.col("_opens").cast("bigint"),
    ).otherwise(-1 - F.abs(F.xxhash64("recording_key") % 1000000))
    verdicts = cuts.withColumn("_cut", F.lit(True))
    out = (
        marked.withColumn("_ref", ref)
        .join(ends, ["camera_id", "_ref"], "left")
        .join(verdicts, ["camera_id", "recording_key"], "left")
    )
    outside = F.coalesce(F.col("_carried"), F.lit(0)) + F.col("_added")
    edge = F.col("_opens") | ~parking
    asked = F.when(edge, outside).otherwise(F.col("_asked"))
    cut = F.col("prev").isNotNull() & (
        F.when(edge, outside > cap_s).otherwise(F.coalesce(F.col("_cut"), F.lit(False)))
    )
    return (
        out.withColumn("_by_cap", cut)
        .withColumn("parking_total_s", F.when(F.col("_by_cap"), asked))
        .withColumn("rule", F.when(F.col("_by_cap"), "cap").otherwise(F.col("rule")))
        .withColumn("split", F.col("split") | F.col("_by_cap"))
        .withColumns(
            {
                c: F.when(~F.col("_by_cap"), F.col(c))
                for c in ("force_reason", "bridge_reason")
            }
        )
        .drop("_ref", "_carried", "_cut", "_asked", "_by_cap", "_opens", "_run", "_added")
    )


#: Rows of a parking run that are folded as one array; longer runs are cut by pointers.
SHORT_RUN = 256


def _cap_cuts(rows: DataFrame, totals: DataFrame, cap_s: int) -> tuple[DataFrame, DataFrame]:
    """(camera_id, recording_key, _asked) of the cuts inside runs, and (camera_id, _run, _last_held) of the runs.

    Short runs fold in the JVM as arrays of at most ``SHORT_RUN`` rows. In longer ones every row points to the row
    where a trip begun at it would be cut; the cuts are the rows reached from the start of the run, found by doubling the
    pointers. No task holds a long run.
    """
    sized = rows.join(totals.select("camera_id", "_run", "_run_rows"), ["camera_id", "_run"])
    short = _fold_short(sized.filter(F.col("_run_rows") <= SHORT_RUN), cap_s)
    cuts = short.select("camera_id", F.explode("_walk.cuts").alias("_c")).select("camera_id", "_c.recording_key", "_c._asked")
    last = short.select("camera_id", "_run", F.col("_walk.held").alias("_last_held"))
    long = sized.filter(F.col("_run_rows") > SHORT_RUN).drop("_run_rows")
    if totals.filter((F.col("_run_total") > cap_s) & (F.col("_run_rows") > SHORT_RUN)).isEmpty():
        return cuts, last
    more_cuts, more_last = _jump_long(long, cap_s)
    return cuts.unionByName(more_cuts), last.unionByName(more_last)


def _fold_short(rows: DataFrame, cap_s: int) -> DataFrame:
    """Runs of bounded length with ``_walk``: the total held at the end and the cuts on the way."""
    ordered = rows.groupBy("camera_id", "_run").agg(
        F.array_sort(F.collect_list(F.struct("start_s", "recording_key", "_added"))).alias("_rows")
    )
    first = F.element_at("_rows", 1)
    none = F.slice(F.transform("_rows", lambda x: F.struct(x["recording_key"].alias("recording_key"), x["_added"].alias("_asked"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        want = acc["held"] + x["_added"]
        cut = F.struct(x["recording_key"].alias("recording_key"), want.alias("_asked"))
        return F.struct(
            F.when(want > cap_s, x["_added"]).otherwise(want).alias("held"),
            F.when(want > cap_s, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"),
        )

    begin = F.struct(first["_added"].alias("held"), none.alias("cuts"))
    return ordered.select("camera_id", "_run", F.aggregate(F.slice("_rows", 2, SHORT_RUN), begin, step).alias("_walk"))


def _jump_long(rows: DataFrame, cap_s: int) -> tuple[DataFrame, DataFrame]:
    """Cuts and last totals of long runs, by pointers that are doubled until none is left."""
    run = ["camera_id", "_run"]
    order = ["start_s", "recording_key"]
    chunk = spread("start_s", DAY_S)
    was = F.struct("_added")
    placed = scan(rows, run, order, chunk, prev={"_was": was}, total={"_sum": F.col("_added")}, number="_no")
    # a trip can only begin at the first row, where time is added, or behind a row that exceeds the cap by itself
    behind = F.coalesce(F.col("_was._added") > cap_s, F.lit(False))
    placed = settle(placed.filter((F.col("_no") == 1) | (F.col("_added") > 0) | behind).drop("_was"), "parking-long")
    # the next cut: the first row whose sum exceeds the cap and what lay before this one
    before = F.col("_sum") - F.col("_added")
    asking = placed.select(*run, "_no", before.alias("_before"), (before + cap_s).alias("_limit"), (F.col("_added") > cap_s).alias("_alone"))
    sums = placed.filter("_added > 0").select(*run, F.col("_sum").alias("_limit"), F.col("_no").alias("_to"), "_sum")
    met = bracket(
        asking.filter("NOT _alone"), sums, run, "_limit", ["_to", "_sum"], spread("_at", max(1, cap_s)), tie="_to", after="_hit",
    ).select(*run, "_no", "_before", F.col("_hit._to").alias("_to"))
    alone = asking.filter("_alone").select(*run, "_no", "_before", (F.col("_no") + 1).alias("_to"))
    final = placed.groupBy(*run).agg(F.max("_no").alias("_top"), F.max("_sum").alias("_total"))
    ends = final.select(*run, "_top")
    # a row that exceeds the cap by itself has no row behind it at the end of the run
    steps = met.unionByName(alone).join(ends, run).select(*run, "_no", "_before", F.when(F.col("_to") <= F.col("_top"), F.col("_to")).alias("_to"))
    steps = settle(steps, "parking-steps")
    jump = steps.filter("_to IS NOT NULL").select(*run, "_no", "_to")
    starts = ends.select(*run, F.lit(1).cast("bigint").alias("_no"))
    while not jump.isEmpty():
        reached = starts.join(jump, [*run, "_no"]).select(*run, F.col("_to").alias("_no"))
        starts = settle(starts.unionByName(reached), "parking-starts")
        onward = jump.select(*run, F.col("_no").alias("_to"), F.col("_to").alias("_then"))
        jump = settle(jump.join(onward, [*run, "_to"]).select(*run, "_no", F.col("_then").alias("_to")), "parking-jumps")
    begun = starts.join(steps, [*run, "_no"])
    at = placed.select(*run, F.col("_no").alias("_to"), "recording_key", "_sum")
    cuts = begun.join(at, [*run, "_to"]).select("camera_id", "recording_key", (F.col("_sum") - F.col("_before")).alias("_asked"))
    last = begun.filter("_to IS NULL").join(final, run).select(*run, (F.col("_total") - F.col("_before")).alias("_last_held"))
    return cuts, last


def _gap_text() -> Column:
    gap = F.col("gap_s").cast("double")
    return F.when(
        gap < 0,
        F.format_string("%.1fs before the previous recording ended (overlap or disorder)", -gap),
    ).otherwise(F.format_string("%.1fs", gap))


def explain(
    detected: DataFrame,
    *,
    max_gap_s: float = MAX_GAP_S,
    tolerance_s: float = GAP_TOLERANCE_S,
    parking_cap_s: float | None = None,
) -> DataFrame:
    """Add ``reason``: why each recording starts or continues its trip."""
    limit = f"{max_gap_s + tolerance_s:.1f}s"
    since = F.concat(F.lit("gap since "), F.col("prev")["recording_id"], F.lit(" was "), _gap_text())
    culprit = F.when(
        ~F.col("prev")["timestamp_reliable"], F.concat(F.col("prev")["recording_id"], F.lit("'s"))
    ).otherwise(F.lit("its own"))
    cap = "" if parking_cap_s is None else f"{parking_cap_s / 60:.1f}m"
    text = (
        F.when(F.col("rule") == "first", F.lit("first recording in the archive"))
        .when(
            F.col("rule") == "cap",
            F.concat(
                F.lit("starts a new trip - parking footage would reach "),
                F.format_string("%.1fm", F.bround(F.col("parking_total_s") / 60, 1)),
                F.lit(f", over the {cap} limit"),
            ),
        )
        .when(
            F.col("rule") == "unreliable",
            F.concat(F.lit("starts a new trip - "), culprit, F.lit(" timestamp is not reliable")),
        )
        .when(
            F.col("rule") == "force",
            F.concat(
                F.lit("starts a new trip - "), since,
                F.lit(f", limit {limit}, but a split was forced: "), F.col("force_reason"),
            ),
        )
        .when(
            F.col("rule") == "gap",
            F.concat(
                F.lit("starts a new trip - "), since,
                F.lit(f", over the {limit} limit, and no movement bridged it"),
            ),
        )
        .when(
            F.col("rule") == "bridged",
            F.concat(
                F.lit("continues the trip - "), since,
                F.lit(f", over the {limit} limit, but bridged by: "), F.col("bridge_reason"),
            ),
        )
        .otherwise(
            F.concat(F.lit("continues the trip - "), since, F.lit(f", within the {limit} limit"))
        )
    )
    return detected.withColumn("reason", text)


TRIP = ["camera_id", "trip_start_s", "trip_start_key"]


def _stamp_s(seconds: Column) -> Column:
    return clock.stamp(clock.from_epoch_us(seconds * 1000000))


def roll_up(detected: DataFrame) -> DataFrame:
    """One row per trip: bounds, duration, count, size, parking flag, label."""
    end = F.col("start_s") + F.coalesce(F.col("duration_s"), F.lit(0))
    when = F.struct("start_s", "recording_key")
    trips = detected.groupBy(*TRIP).agg(
        F.min("start_s").alias("start_s"),
        F.max_by(end, when).alias("end_s"),
        F.count(F.lit(1)).alias("recordings"),
        F.sum("size_bytes").alias("size_bytes"),
        F.bool_or(F.col("kind") == "P").alias("has_parking"),
    )
    return trips.withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn(
        "label",
        F.concat(F.lit("trip_"), _stamp_s(F.col("start_s")), F.lit("_"), _stamp_s(F.col("end_s"))),
    )


def content_bounds(
    detected: DataFrame, *, include_parking: bool = False, prefix: str | None = None
) -> DataFrame:
    """Bounds of the exported content and the folder name.

    Parking recordings at the ends do not count unless the trip has nothing else.
    """
    end = F.col("start_s") + F.coalesce(F.col("duration_s"), F.lit(0))
    when = F.struct("start_s", "recording_key")
    counts = F.lit(True) if include_parking else (F.col("kind") != "P")
    out = detected.groupBy(*TRIP).agg(
        F.min(F.when(counts, F.col("start_s"))).alias("_a"),
        F.max_by(end, F.when(counts, when)).alias("_b"),
        F.min("start_s").alias("_c"),
        F.max_by(end, when).alias("_d"),
    )
    name = F.concat(
        F.lit("" if not prefix else f"{prefix}_"), F.lit("trip_"),
        _stamp_s(F.col("content_start_s")), F.lit("_"), _stamp_s(F.col("content_end_s")),
    )
    return (
        out.withColumn("content_start_s", F.coalesce("_a", "_c"))
        .withColumn("content_end_s", F.coalesce("_b", "_d"))
        .withColumn("folder", name)
        .select(*TRIP, "content_start_s", "content_end_s", "folder")
    )


def touching(detected: DataFrame, interval: Interval) -> DataFrame:
    """All recordings of the trips with at least one recording in ``interval``."""
    hit = detected.filter(interval.contains("recording_id")).select(*TRIP).distinct()
    return detected.join(hit, TRIP, "left_semi")


def detect_interval(
    recordings: DataFrame,
    interval: Interval,
    *,
    margin_days: int = 1,
    date_column: str = "date",
    **rules,
) -> DataFrame:
    """``touching(detect(...))`` that reads only the dates around the interval.

    ``date_column`` (YYYYMMDD text) is the partition column. The date range is
    widened for the cameras whose kept trips begin or end at the edge of what was read,
    until none is left; then the result equals that of a full build.
    """
    bounds = recordings.agg(F.min(date_column).alias("a"), F.max(date_column).alias("b")).first()
    if bounds.a is None:
        return touching(detect(recordings, **rules), interval)
    lo_all, hi_all = bounds.a, bounds.b

    def shift(day: str, by: int) -> str:
        return (datetime.strptime(day, "%Y%m%d") + timedelta(days=by)).strftime("%Y%m%d")

    first = _real_day(min(max(interval.dates[0], lo_all), hi_all))
    last = _real_day(max(min(interval.dates[1], hi_all), lo_all))
    margin, open_cameras, done = margin_days, None, []
    while True:
        lo, hi = max(shift(first, -margin), lo_all), min(shift(last, margin), hi_all)
        window = recordings.filter(F.col(date_column).between(lo, hi))
        if open_cameras is not None:
            window = window.join(open_cameras, "camera_id", "left_semi")
        kept = settle(touching(detect(window, **rules, extra=(date_column,)), interval), "interval-trips")
        if lo == lo_all and hi == hi_all:
            break
        # a camera is proven when recordings outside its kept trips were seen on both
        # sides, or the edge of what was read is the edge of what exists
        at = F.struct("start_s", "recording_key")
        edge = window.groupBy("camera_id").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        open_lo = (at == F.col("_lo")) & F.lit(lo != lo_all)
        open_hi = (at == F.col("_hi")) & F.lit(hi != hi_all)
        unproven = kept.join(edge, "camera_id").filter(open_lo | open_hi)
        open_cameras = settle(unproven.select("camera_id").distinct(), "open-cameras")
        if open_cameras.isEmpty():
            break
        done.append(kept.join(open_cameras, "camera_id", "left_anti"))
        margin *= 4
    for part in done:
        kept = kept.unionByName(part)
    return kept


def day_zones(recordings: DataFrame, date_column: str = "date") -> DataFrame:
    """One row per camera and day, kept beside a table partitioned by date: what trips need to know of a day unread.

    ``first_s`` and ``end_s`` bound the day, ``opens`` and ``closes`` say whether its first and last time can be trusted,
    ``widest_s`` is the longest pause inside, ``doubtful`` whether a time inside breaks a trip. Thresholds come later.
    """
    day = Window.partitionBy("camera_id", date_column).orderBy(*ORDER)
    end = F.col("start_s") + F.coalesce("duration_s", F.lit(0))
    at = F.struct(*ORDER)
    inner = recordings.select(
        "camera_id", date_column, *ORDER, "timestamp_reliable", end.alias("_end"),
        (F.col("start_s") - F.lag(end).over(day)).alias("_gap"),
        (F.lag("timestamp_reliable").over(day).isNotNull() & ~(F.col("timestamp_reliable") & F.lag("timestamp_reliable").over(day))).alias("_doubt"),
    )
    return inner.groupBy("camera_id", date_column).agg(
        F.min("start_s").alias("first_s"), F.max_by("_end", at).alias("end_s"), F.min_by("timestamp_reliable", at).alias("opens"),
        F.max_by("timestamp_reliable", at).alias("closes"), F.max("_gap").alias("widest_s"),
        F.coalesce(F.bool_or("_doubt"), F.lit(False)).alias("doubtful"),
    )


def days_of_interval(
    zones: DataFrame, interval: Interval, *, max_gap_s: float = MAX_GAP_S, tolerance_s: float = GAP_TOLERANCE_S, date_column: str = "date",
) -> DataFrame:
    """(camera_id, date) that hold the trips of the days of ``interval``, from their first recording to their last.

    Trips are counted over the days of a camera, at most two to a day: the one that comes in and the one that goes out.
    A day is wanted if it has a part in a trip of the interval's days."""
    threshold = max_gap_s + tolerance_s
    by_day = Window.partitionBy("camera_id").orderBy(date_column)  # one row a day
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = F.col("opens") & F.lag("closes").over(by_day) & (F.col("first_s") - F.lag("end_s").over(by_day) <= threshold)
    parts = F.when(F.col("doubtful") | (F.col("widest_s") > threshold), 1).otherwise(0)
    days = zones.withColumns({"_new": F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1), "_parts": parts})
    days = days.withColumn("_out", F.sum(F.col("_new") + F.col("_parts")).over(so_far)).withColumn("_in", F.col("_out") - F.col("_parts"))
    whole = Window.partitionBy("camera_id")
    asked = F.col(date_column).between(*(_real_day(d) for d in interval.dates))
    days = days.withColumns({"_lo": F.min(F.when(asked, F.col("_in"))).over(whole), "_hi": F.max(F.when(asked, F.col("_out"))).over(whole)})
    return days.filter((F.col("_out") >= F.col("_lo")) & (F.col("_in") <= F.col("_hi"))).select("camera_id", date_column)


def detect_zoned(
    recordings: DataFrame, zones: DataFrame, interval: Interval, *, date_column: str = "date", max_gap_s: float = MAX_GAP_S,
    tolerance_s: float = GAP_TOLERANCE_S,
) -> DataFrame:
    """``touching(detect(...))`` that reads just the days the trips of the interval lie on, by the ``zones`` of the table.

    For the gap and unreliable-time rules; rules of the caller's own need ``detect_interval``.
    """
    days = settle(
        days_of_interval(zones, interval, max_gap_s=max_gap_s, tolerance_s=tolerance_s, date_column=date_column), "interval-days"
    )
    span = days.agg(F.min(date_column).alias("a"), F.max(date_column).alias("b")).first()  # two dates
    kept = recordings.filter(F.col(date_column).between(span.a, span.b)) if span.a is not None else recordings.filter(F.lit(False))
    kept = kept.join(days, ["camera_id", date_column], "left_semi")
    return touching(detect(kept, max_gap_s=max_gap_s, tolerance_s=tolerance_s), interval)


def _real_day(text: str) -> str:
    """Nearest calendar day of a padded bound such as 20240100 or 20240199."""
    year, month = int(text[:4]), min(max(int(text[4:6]), 1), 12)
    day = min(max(int(text[6:8]), 1), monthrange(year, month)[1])
    return f"{year:04d}{month:02d}{day:02d}"


def before_events(recordings: DataFrame, chunk_s: int = DAY_S) -> DataFrame:
    """Add ``with_video``: events, manual recordings and the one just before each."""
    wanted = F.col("kind").isin("E", "M")
    out = scan(
        recordings, KEY, ORDER, spread("start_s", chunk_s), nxt={"_next_wanted": wanted}
    )
    return out.withColumn(
        "with_video", wanted | F.coalesce(F.col("_next_wanted"), F.lit(False))
    ).drop("_next_wanted")


def display_groups(recordings: DataFrame, same: tuple[str, ...], chunk_s: int = DAY_S) -> DataFrame:
    """Consecutive recordings equal in every ``same`` column, as one row each."""
    here = F.struct(*[F.col(c) for c in same])

    def mark(df: DataFrame) -> DataFrame:
        return df.withColumn("_new", ~F.coalesce(F.col("_was").eqNullSafe(here), F.lit(False)))

    out = scan(
        recordings, KEY, ORDER, spread("start_s", chunk_s),
        prev={"_was": here}, derive=mark, derive_from=[*same, *ORDER],
        total={"group_no": F.col("_new").cast("bigint")},
    )
    at = F.struct(*ORDER)
    groups = out.groupBy("camera_id", "group_no", *same).agg(
        F.count(F.lit(1)).alias("recordings"),
        F.sum("size_bytes").alias("size_bytes"),
        F.min_by("recording_id", at).alias("first_id"),
        F.max_by("recording_id", at).alias("last_id"),
    )
    return groups.withColumn(
        "label",
        F.when(F.col("recordings") == 1, F.col("first_id")).otherwise(
            F.concat("first_id", F.lit(".."), "last_id")
        ),
    )


def real_elapsed_s(kind, playback_s, frame_rate, cached_s, is_photo, photo_s: int = 5) -> Column:
    """Real seconds a recording covers.

    Photos have a constant length, a cached value comes next; parking footage runs
    one frame per second, everything else plays in real time. Half-even rounding.
    """
    played = F.when(kind == "P", playback_s * frame_rate).otherwise(playback_s)
    return (
        F.when(is_photo, F.lit(photo_s).cast("bigint"))
        .when(cached_s.isNotNull(), cached_s.cast("bigint"))
        .otherwise(F.bround(played, 0).cast("bigint"))
    )

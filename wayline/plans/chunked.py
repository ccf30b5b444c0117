"""Ordered scans over a key without putting a whole key into one task.

A plain ``Window.partitionBy(camera_id)`` sorts everything one camera ever
produced in a single task. Here every key is cut into chunks (a monotone
expression of the order column, usually a time bucket). The window only spans
``keys + chunk``; what crosses a chunk edge is one summary row per chunk, scanned
per key and joined back on the same hash partitioning.

The per-key scan sees one row per chunk, so its size is bounded by
``key time span / chunk width`` and not by the number of input rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"

Exprs = Mapping[str, "Column | str"]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    prev: Exprs | None = None,
    nxt: Exprs | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    derive_from: Sequence[str] = (),
    total: Exprs | None = None,
    peak: Exprs | None = None,
    fill: Exprs | None = None,
    fill_back: Exprs | None = None,
    number: str | None = None,
    whole: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
    finer: int = 1,
) -> DataFrame:
    """Add order-dependent columns to ``df``.

    keys        series keys, must be non-NULL
    order       columns giving a total order inside a key
    chunk       orderable expression, non-decreasing along ``order``
    prev / nxt  value on the neighbouring row, NULL at the ends
    derive      row-wise step applied once ``prev`` is known; the columns it
                reads from the current row are listed in ``derive_from``
    total       running sum up to and including the row
    peak        running maximum up to and including the row
    fill        last non-NULL value at or before the row
    fill_back   first non-NULL value at or after the row
    number      1-based row number
    whole       whole-key aggregates: (aggregate of one chunk, function combining chunks)
    finer       so many times the session's shuffle partitions, for wide rows that are sorted several times

    ``total``, ``peak`` and ``fill`` may use columns made by ``derive``.
    """
    prev, nxt = dict(prev or {}), dict(nxt or {})
    total, peak = dict(total or {}), dict(peak or {})
    fill, fill_back = dict(fill or {}), dict(fill_back or {})
    whole = dict(whole or {})
    if number:
        total[number] = F.lit(1).cast("bigint")

    keys = list(keys)
    part = [*keys, CHUNK]
    base = df.withColumn(CHUNK, chunk)
    if finer > 1:
        tasks = finer * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        base = base.repartition(tasks, *part)
    in_chunk = Window.partitionBy(*part).orderBy(*order)
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # looking ahead runs over the reversed order: a frame open to the end costs n * n
    backward = [F.col(c).desc_nulls_last() for c in order]
    to_come = Window.partitionBy(*part).orderBy(*backward).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    position = F.struct(*[F.col(c) for c in order])

    prev_struct = F.struct(*[_col(e).alias(n) for n, e in prev.items()]) if prev else None
    nxt_struct = F.struct(*[_col(e).alias(n) for n, e in nxt.items()]) if nxt else None

    # --- one summary row per chunk -------------------------------------
    aggs: list[Column] = []
    if prev:
        aggs.append(F.max_by(prev_struct, position).alias("_tail"))
    if nxt:
        aggs.append(F.min_by(nxt_struct, position).alias("_lead"))
    inner = base
    live = F.lit(True)
    if derive is not None:
        # rows other than the first of a chunk can be derived locally; the
        # first one is kept whole and derived once its predecessor is known
        inner = base.withColumn("_in_prev", F.lag(prev_struct).over(in_chunk))
        live = F.col("_in_prev").isNotNull()
        inner = inner.select("*", *[F.col("_in_prev")[n].alias(n) for n in prev])
        inner = derive(inner)
        head_cols = list(dict.fromkeys([*derive_from, *order]))
        aggs.append(
            F.min_by(F.struct(*[F.col(c) for c in head_cols]), position).alias("_head")
        )
    for n, e in total.items():
        aggs.append(F.sum(F.when(live, _col(e))).alias(f"_t_{n}"))
    for n, e in peak.items():
        aggs.append(F.max(F.when(live, _col(e))).alias(f"_p_{n}"))
    for n, e in fill.items():
        aggs.append(
            F.max_by(
                F.struct(_col(e).alias("v")), F.when(live & _col(e).isNotNull(), position)
            ).alias(f"_f_{n}")
        )
    for n, e in fill_back.items():
        aggs.append(
            F.min_by(
                F.struct(_col(e).alias("v")), F.when(_col(e).isNotNull(), position)
            ).alias(f"_b_{n}")
        )
    aggs += [agg.alias(f"_w_{n}") for n, (agg, _) in whole.items()]
    edges = inner.groupBy(*part).agg(*aggs)

    # --- carry over chunks, one row per chunk --------------------------
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    if prev:
        edges = edges.withColumn("_prev", F.lag("_tail").over(by_chunk))
    if derive is not None:
        edges = edges.select("*", "_head.*", *[F.col("_prev")[n].alias(n) for n in prev])
        edges = derive(edges)
        for n, e in total.items():
            edges = edges.withColumn(
                f"_t_{n}", F.coalesce(f"_t_{n}", F.lit(0)) + F.coalesce(_col(e), F.lit(0))
            )
        for n, e in peak.items():
            edges = edges.withColumn(f"_p_{n}", F.greatest(f"_p_{n}", _col(e)))
        for n, e in fill.items():
            edges = edges.withColumn(
                f"_f_{n}",
                F.coalesce(f"_f_{n}", F.when(_col(e).isNotNull(), F.struct(_col(e).alias("v")))),
            )
    carry = [F.col(k) for k in keys] + [F.col(CHUNK)]
    if prev:
        carry.append(F.col("_prev"))
    if nxt:
        carry.append(F.lead("_lead").over(by_chunk).alias("_next"))
    carry += [F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in total]
    carry += [F.max(f"_p_{n}").over(before).alias(f"_p_{n}") for n in peak]
    carry += [F.last(f"_f_{n}", ignorenulls=True).over(before).alias(f"_f_{n}") for n in fill]
    carry += [
        F.last(f"_b_{n}", ignorenulls=True).over(after).alias(f"_b_{n}") for n in fill_back
    ]
    per_key = Window.partitionBy(*keys)
    carry += [combine(F.col(f"_w_{n}")).over(per_key).alias(n) for n, (_, combine) in whole.items()]
    carried = edges.select(*carry)

    # --- back onto the rows --------------------------------------------
    # merged on the hash partitioning the windows need anyway: at planning either side may look as small as the
    # files behind it, and would be broadcast with all its rows
    out = base.join(carried.hint("merge"), part)
    if prev:
        out = out.withColumn(
            "_prev", F.coalesce(F.lag(prev_struct).over(in_chunk), F.col("_prev"))
        ).select("*", *[F.col("_prev")[n].alias(n) for n in prev])
    if nxt:
        out = out.withColumn(
            "_next", F.coalesce(F.lead(nxt_struct).over(in_chunk), F.col("_next"))
        ).select("*", *[F.col("_next")[n].alias(n) for n in nxt])
    if derive is not None:
        out = derive(out)
    added: dict[str, Column] = {}
    for n, e in total.items():
        added[n] = F.coalesce(F.sum(_col(e)).over(so_far), F.lit(0)) + F.coalesce(
            f"_t_{n}", F.lit(0)
        )
    for n, e in peak.items():
        added[n] = F.greatest(F.max(_col(e)).over(so_far), F.col(f"_p_{n}"))
    for n, e in fill.items():
        added[n] = F.coalesce(F.last(_col(e), ignorenulls=True).over(so_far), F.col(f"_f_{n}.v"))
    for n, e in fill_back.items():
        added[n] = F.coalesce(F.last(_col(e), ignorenulls=True).over(to_come), F.col(f"_b_{n}.v"))
    out = out.withColumns(added) if added else out
    scratch = [CHUNK, "_prev", "_next", "_in_prev"]
    scratch += [f"_{p}_{n}" for p, g in zip("tpfb", (total, peak, fill, fill_back)) for n in g]
    return out.drop(*scratch)


def spread(column: Column | str, width: float) -> Column:
    """Chunk number of a numeric order column."""
    return F.floor(_col(column) / F.lit(width)).cast("bigint")


def attach(
    df: DataFrame, keys: Sequence[str], chunk: Column, whole: Mapping[str, tuple[Column, Callable]]
) -> DataFrame:
    """Add whole-key aggregates to every row.

    ``whole`` maps a name to (aggregate of one chunk, function combining chunk values).
    The join back runs on ``keys + chunk``, so a huge key is spread over many tasks.
    """
    keys = list(keys)
    part = [*keys, CHUNK]
    base = df.withColumn(CHUNK, chunk)
    partial = base.groupBy(*part).agg(*[agg.alias(n) for n, (agg, _) in whole.items()])
    per_key = Window.partitionBy(*keys)
    link = partial.select(
        *part, *[combine(F.col(n)).over(per_key).alias(n) for n, (_, combine) in whole.items()]
    )
    return base.join(link, part).drop(CHUNK)


def smooth(
    df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], window: int = 5,
    chunk_rows: int = 4096,
) -> DataFrame:
    """Centred moving average over a dense row position, shrinking at the ends.

    Rows near a chunk edge are copied into the neighbour chunk as a halo.
    """
    half = window // 2
    at = F.col(pos)

    def home(p: Column) -> Column:
        return F.floor(p / chunk_rows).cast("bigint")

    copies = df.withColumn(
        CHUNK, F.explode(F.array_distinct(F.array(home(at), home(at - half), home(at + half))))
    )
    w = Window.partitionBy(*keys, CHUNK).orderBy(pos).rowsBetween(-half, half)
    means = {f"{v}_smooth": F.avg(v).over(w) for v in values}
    return copies.withColumns(means).filter(F.col(CHUNK) == home(at)).drop(CHUNK)

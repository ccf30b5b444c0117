"""Merkle manifest of a dataset: stored levels, proofs by recomputing what was not stored.

Leaves are ordered inside their group and every ``arity`` consecutive nodes of a level become one node above, until one
is left. Only every ``every``-th level is written (the checkpoints). A proof needs all levels: for each aligned subtree
of ``arity ** every`` stored nodes the levels between are hashed again from the stored nodes, the siblings of every node
are emitted, and the regenerated nodes are dropped. Proofs come from the top down: a stored node hands the steps above
it to the nodes of its own subtree, so a join key never holds more rows than a subtree has nodes, however large a
group is. Group roots form one more tree of the same kind, whose root covers the dataset.

Positions come from a range partitioned, sorted and written table: its partitions are counted, and the counts summed
per group; no task sees a whole group.

Results for odd input: a null is written ``-``, an empty text ``0:``; null ids come first in their group; equal ids are
ordered by leaf, and rows repeated whole hold one leaf each; extra columns are ignored; an empty table gives no rows
and no root. Texts are hashed in place and never shuffled, whatever their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.frames import CRC32_SQL, crc32_of, pick
from wayline.session import settle

ARITY = 8
#: Levels between two stored ones; a subtree holds ARITY ** EVERY stored nodes.
EVERY = 2
#: Tampering in the query: ids whose crc32 this divides.
TAMPERED = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field_text(value: Column) -> Column:
    """``-`` for a null, else length in UTF-8 bytes, a colon and the value; whole numbers are written in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(*map(field_text, fields))


def _join(digests: Column) -> Column:
    return F.array_join(digests, "")


def _runs(digests: Column, arity: int) -> Column:
    """One digest for every ``arity`` consecutive ones."""
    last = ((F.size(digests) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_join(F.slice(digests, i * arity + 1, arity)), 256))


@dataclass
class Manifest:
    """Stored levels, lowest first, each with columns grp, idx, n (leaves of the group) and digest; the lowest keeps the
    columns of the rows it was made from. ``above`` is the tree of the group roots, whose single group is ''."""

    levels: list[DataFrame]
    arity: int = ARITY
    every: int = EVERY
    above: "Manifest | None" = None

    def roots(self) -> DataFrame:
        """(grp, digest) of every group."""
        return self.levels[-1].select("grp", "digest")

    def root(self) -> DataFrame:
        """The one digest of the dataset; no row for an empty one."""
        return (self.above or self).roots().select("digest")


def number(rows: DataFrame, order: Sequence[str], label: str = "merkle-leaves") -> DataFrame:
    """``rows`` (grp, digest, ...) written in order, with ``idx`` inside the group (from 0) and ``n`` of the group."""
    order = ["grp", *order, "digest"]
    placed = settle(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    # one row for a group and partition
    held = placed.groupBy("grp", "_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    by_group = Window.partitionBy("grp")
    before = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        "grp", "_part", "_first", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"), F.sum("_held").over(by_group).alias("n"),
    )
    return placed.join(held, ["grp", "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_part", "_at", "_first", "_before"
    )


def _nodes(level: int, arity: int) -> Column:
    """Nodes of a group on a level, by its number of leaves; whole numbers only."""
    return F.expr(f"(n + {arity ** level - 1}) div {arity ** level}")


def _subtrees(rows: DataFrame, level: int, arity: int, every: int) -> DataFrame:
    """One row per aligned subtree: its stored nodes in order (``_m``) and the levels regenerated from them (``_l0`` ...).

    A level that has one node in the whole group is handed up as it is."""
    kept = ["idx", *(c for c in rows.columns if c not in ("grp", "n", "idx"))]
    out = rows.groupBy("grp", F.expr(f"idx div {arity ** every}").alias("_sub")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(*kept))).alias("_m")  # at most arity ** every rows
    ).withColumn("_l0", F.col("_m.digest"))
    for i in range(every):
        here = F.col(f"_l{i}")
        out = out.withColumn(f"_l{i + 1}", F.when(_nodes(level + i, arity) > 1, _runs(here, arity)).otherwise(here))
    return out


def _tree(leaves: DataFrame, arity: int, every: int, label: str) -> Manifest:
    """Write every ``every``-th level above the numbered leaves."""
    out = Manifest([leaves], arity, every)
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0  # one number
    level = 0
    while most > arity ** level:
        up = _subtrees(out.levels[-1].select("grp", "n", "idx", "digest"), level, arity, every)
        up = up.select("grp", "n", F.col("_sub").alias("idx"), F.col(f"_l{every}")[0].alias("digest"))
        level += every
        out.levels.append(settle(up, f"{label}-{level}"))
    return out


def build(rows: DataFrame, order: Sequence[str], *, arity: int = ARITY, every: int = EVERY) -> Manifest:
    """Manifest of ``rows``: ``grp`` (text, no null), ``digest`` (the leaf), ``order`` and further columns, which are kept."""
    if arity < 2 or every < 1:
        raise ValueError("a node needs two children or more, a stored level one above it")
    out = _tree(settle(number(rows, order, "merkle-rows"), "merkle-level-0"), arity, every, "merkle-level")
    roots = out.roots().select(F.lit("").alias("grp"), "digest", F.col("grp").alias("member"))
    out.above = _tree(settle(number(roots, ["member"], "merkle-roots"), "merkle-top-0"), arity, every, "merkle-top")
    return out


def _paths(tree: Manifest, top: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Lowest nodes of a tree with ``path``: the siblings before and after, lowest level first, then what ``top`` hands down.

    ``top`` has grp, path and further columns; ``wanted`` (grp, idx) restricts the subtrees that are regenerated."""
    arity, every = tree.arity, tree.every
    whole = arity ** every
    handed = [c for c in top.columns if c not in ("grp", "path")]
    if len(tree.levels) == 1:  # every group is a lone leaf
        return tree.levels[0].join(top, "grp")
    above = top.withColumn("_sub", F.lit(0).cast("long"))
    for j in reversed(range(len(tree.levels) - 1)):
        rows = tree.levels[j]
        if wanted is not None:
            keep = wanted.select("grp", F.expr(f"idx div {whole ** (j + 1)}").alias("_sub")).distinct()
            rows = rows.withColumn("_sub", F.expr(f"idx div {whole}")).join(keep, ["grp", "_sub"], "left_semi").drop("_sub")
        sub = _subtrees(rows, j * every, arity, every).join(above, ["grp", "_sub"]).withColumn("_node", F.explode("_m"))
        entries = []
        for i in range(every):
            here, at = F.col(f"_l{i}"), F.expr(f"cast(_node.idx % {whole} div {arity ** i} as int)")
            inside = at % arity
            before = _join(F.slice(here, at - inside + 1, inside))
            after = _join(F.slice(here, at + 2, F.lit(arity - 1) - inside))
            entries.append(F.when(_nodes(j * every + i, arity) > 1, F.struct(before.alias("before"), after.alias("after"))))
        path = F.concat(F.filter(F.array(*entries), lambda s: s.isNotNull()), F.col("path"))
        above = sub.select("grp", "n", "_node.*", *handed, path.alias("path"))
        if j:
            above = above.select("grp", F.col("idx").alias("_sub"), *handed, "path")
    return above


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """Leaves with ``subroot``, ``root`` and ``path``, the steps from the leaf through its group's root to the root.

    With ``wanted`` (grp, idx) only the subtrees of these leaves are regenerated, and only these leaves returned."""
    start = manifest.levels[0].sparkSession.createDataFrame([("", [])], f"grp string, path {_PATH}")
    top = _paths(manifest.above, start).select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), "path")
    top = settle(top.withColumn("root", fold(F.col("subroot"), F.col("path"))), "merkle-group-paths")
    found = _paths(manifest, top, wanted)
    return found if wanted is None else found.join(wanted.select("grp", "idx").distinct(), ["grp", "idx"], "left_semi")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return _join(F.transform(path, lambda step: F.concat(step["before"], step["after"])))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents in groups by language, each with the leaf that tampering would give (null: not tampered)."""
    d = pick(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")

    def of(text: Column) -> Column:
        return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    struck = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return d.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), "doc_id", of(F.col("text")).alias("digest"),
        F.when(struck, of(F.translate("text", _UPPER, _LOWER))).alias("tampered"),
    )


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = proofs(build(document_leaves(spark.read.parquet(f"{folder}/documents.parquet")), ["doc_id"]))
    out = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(arity: int = ARITY, levels: int = 10) -> str:
    """The same rows in SQL, level by level; ``arity ** levels`` bounds the leaves of a group."""
    text = "coalesce(strlen({0}) || ':' || {0}, '-')"
    fields = [text.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")]
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    ctes = [
        CRC32_SQL,
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({' || '.join([*fields, text.format('text')])}) AS leaf,
  CASE WHEN {crc32_of('CAST(doc_id AS VARCHAR)')} % {TAMPERED} = 0 THEN sha256({' || '.join([*fields, text.format(low)])}) END AS tampered FROM documents, crc_table)""",
        """a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix FROM d)""",
        "t0 AS (SELECT g, ix AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM a0)",
    ]

    def climb(prefix: str, group: str) -> None:
        for k in range(levels):
            ctes.append(
                f"{prefix}{k + 1} AS (SELECT {group}, i // {arity} AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, "
                f"(n + {arity - 1}) // {arity} AS n FROM {prefix}{k} GROUP BY {group}, i // {arity}, n)"
            )

    climb("t", "g")
    ctes.append(f"u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS member FROM t{levels})")
    climb("u", "g")
    # siblings of every node on its level, before and after it
    for prefix in "tu":
        for k in range(levels):
            ctes.append(
                f"s{prefix}{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS c FROM {prefix}{k} "
                f"WINDOW w AS (PARTITION BY g, i // {arity} ORDER BY i))"
            )
    last, joined, proof = "coalesce(tampered, leaf)", "a0 JOIN u0 ON u0.member = a0.g", []
    ctes.append(f"f0 AS (SELECT doc_id, leaf, a0.g, ix, u0.i AS top, u0.h AS subroot, {last} AS f, '' AS p FROM {joined})")
    step = 0
    for prefix, key, at in (("t", "f.g", "f.ix"), ("u", "''", "f.top")):
        for k in range(levels):
            ctes.append(
                f"f{step + 1} AS (SELECT doc_id, leaf, f.g, ix, top, subroot, CASE WHEN s.n > 1 THEN sha256(b || f || c) ELSE f END AS f, "
                f"CASE WHEN s.n > 1 THEN p || b || c ELSE p END AS p FROM f{step} f JOIN s{prefix}{k} s ON s.g = {key} AND s.i = {at} // {arity ** k})"
            )
            step += 1
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM f{step}, u{levels}"
    )


QUERIES = {"op13_merkle_manifest": merkle_manifest}
ORACLES = {"op13_merkle_manifest": _sql()}

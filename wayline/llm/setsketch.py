"""Near-duplicate documents by SetSketch registers.

A document is the set of its five-word shingles. Each register keeps the least of the shingles' exponential
variates on a scale of powers of ``BASE``, cut to whole steps: registers merge by taking the larger, and two
registers are equal about as often as the Jaccard similarity says. Bands of registers pick candidates, the
registers of a candidate pair are compared (larger, smaller, equal) and its similarity is estimated by
likelihood, jointly with the known set sizes; what may reach the threshold is verified on the full sets.

Documents with equal sets are one node from the start. In a bucket of a band every member meets its leader, the
smallest id, so a bucket of any size gives no more pairs than members. Members that stay unconnected are compared
by what they hold beside each leader they met (``_beside_leader``), which finds the further links of a group
without giving its pairs. With ``BANDS`` bands of ``ROWS`` registers a pair at the threshold shares no bucket with
a chance of 2.3e-6.

Results for odd input: null and empty texts have an empty set, are linked with nothing and kept; fewer than five
words form one shingle; repeated rows are copies, each gets a row, and the one with the smallest id is kept (rows that
share an id share their links); rows without an id are returned with no component and kept; extra columns are
ignored; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.frames import map_columns, pick
from wayline.llm.graph import components
from wayline.session import settle

WORDS = 5
SIMILARITY = (75, 100)
BANDS = 48
ROWS = 5
REGISTERS = BANDS * ROWS
BASE = 1.02
SCALE = 20.0
LIMIT = (1 << 16) - 2
#: Standard errors that an estimate may lie below the threshold before a pair is left out.
SLACK = 5.0
#: Members of a family that stand in one task when its pairs inside the leader's set are sought.
SLICE = 4_096

_RNG = np.random.default_rng(20_240_229)
_A = (_RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1))
_B = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8; A-Z are lower-cased."""
    words = (data or b"").lower().split()
    if not words:
        return np.array([], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    width = min(WORDS, len(words))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h += each[k : k + n] * _MIX[k]
    return np.unique(_finish(h))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set: the largest step of each register."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        h = x[at : at + 2048, None] * _A
        h += _B
        # the product's low bits are poor: fold the high ones in
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=0), out=least)
    variate = -np.log1p(-(least + 0.5) / 2.0**32) / SCALE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = _finish((h ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches with known set sizes."""
    more, less = (one > two).sum(axis=1)[:, None], (one < two).sum(axis=1)[:, None]
    equal = one.shape[1] - more - less
    u, v = (n_one / (n_one + n_two))[:, None], (n_two / (n_one + n_two))[:, None]
    grid = np.linspace(0, 1, 401)[None, :] * np.minimum(u / v, v / u) * (1 - 1e-9)
    above, below = _p(u - v * grid), _p(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        ways = [np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0) for n, p in ((more, above), (less, below), (equal, 1 - above - below))]
    return grid[np.arange(len(one)), sum(ways).argmax(axis=1)]


def _sketch(columns: list) -> tuple[list, ...]:
    sizes, keys, packed = [], [], []
    for text in columns[1]:
        items = shingles(text.as_py())
        sizes.append(len(items))
        keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
        packed.append(registers(items).tobytes() if len(items) else None)
    return columns[0], sizes, keys, packed


def _band_rows(columns: list):
    for at in range(0, len(columns[0]), 1024):
        ids = columns[0][at : at + 1024]
        sketches = np.frombuffer(b"".join(columns[1][at : at + 1024].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        yield band_keys(sketches).ravel(), np.repeat(ids.to_numpy(zero_copy_only=False), BANDS)


def _estimate(columns: list) -> tuple[list, ...]:
    a, b, n_a, n_b, one, two = columns
    stack = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS)
    n_one, n_two = (x.to_numpy(zero_copy_only=False).astype(float) for x in (n_a, n_b))
    s_one, s_two = stack(one), stack(two)
    parts = [slice(i, i + 512) for i in range(0, len(n_one), 512)]
    return a, b, np.concatenate([likely_similarity(s_one[p], s_two[p], n_one[p], n_two[p]) for p in parts])


def _press(columns: list) -> tuple[list, ...]:
    packer = zstandard.ZstdCompressor(level=3)
    return columns[0], [packer.compress(x.as_py() or b"") for x in columns[1]]


def _verify(columns: list) -> tuple[list, ...]:
    opener, known, linked = zstandard.ZstdDecompressor(), {}, []
    for a, one, two in zip(columns[0].to_pylist(), columns[2], columns[3], strict=True):
        if a not in known:  # pairs of one leader mostly follow each other
            known = {a: shingles(opener.decompress(one.as_py()))}
        other = shingles(opener.decompress(two.as_py()))
        common = len(np.intersect1d(known[a], other, assume_unique=True))
        union = len(known[a]) + len(other) - common
        linked.append(SIMILARITY[1] * common >= SIMILARITY[0] * union)
    return columns[0], columns[1], linked


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, j): the likely similarity of every pair."""
    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return map_columns(met, _estimate, "a long, b long, j double")


def _verified(estimated: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, out of those that may by their estimate."""
    goal = SIMILARITY[0] / SIMILARITY[1]
    likely = estimated.where(F.col("j") >= goal - SLACK * (goal * (1 - goal) / REGISTERS) ** 0.5).select("a", "b")
    full = _with_texts(likely, texts).select("a", "b", "one", "two")
    return map_columns(full, _verify, "a long, b long, linked boolean").where("linked").select("a", "b")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    own = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("two"))
    leader = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("one"))
    return pairs.join(own, "b").join(leader, "a")


def _differences(columns: list, whole: bool = False):
    """Per (leader, document): set size, shingles shared with the leader, how many a partner must share beside it, and
    the others or, unless ``whole``, the first of them.

    A partner must share so many of the document's shingles that it shares one of these first ones, if it shares any
    beside the leader.
    """
    opener, known = zstandard.ZstdDecompressor(), {}
    out = []
    for a, b, one, two, component in zip(*(c.to_pylist() for c in columns), strict=True):
        if a not in known:
            known = {a: shingles(opener.decompress(one))}
        own = shingles(opener.decompress(two))
        beside = np.setdiff1d(own, known[a], assume_unique=True)
        shared = len(own) - len(beside)
        needed = max(1, -(-SIMILARITY[0] * len(own) // SIMILARITY[1]) - shared)
        first = len(beside) if whole else max(0, len(beside) - needed + 1)
        out.append((a, b, component, len(own), shared, needed, beside[:first].view(np.int64)))
    return tuple(map(list, zip(*out)))


def _common(u: str, m: str) -> Column:
    """Shingles that two sets of known size must share to reach the threshold."""
    return F.ceil(SIMILARITY[0] * (F.col(f"{u}.n") + F.col(f"{m}.n")) / sum(SIMILARITY))


def _across(shingles_of: DataFrame) -> DataFrame:
    """(a, shingle, held): shingles that members of two components of a family hold, and how many members do."""
    counts = shingles_of.groupBy("a", "shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    return counts.where("low <> high").select("a", "shingle", "held")


def _inside_leader(sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of one family, in different components, that can reach the threshold inside the leader's set alone.

    Both then share three quarters of themselves with the leader, so all others are left out first. Most of a large
    family is one component, whose members never meet: every pair has a side outside it. That side stands in one row for
    every ``SLICE`` members of its family and the other one in one slice, so no task holds a family.
    """
    fit = settle(sizes.where(SIMILARITY[1] * F.col("shared") >= SIMILARITY[0] * F.col("n")), "inside")
    counts = fit.groupBy("a", "component").agg(F.count("*").alias("members"))
    counts = counts.groupBy("a").agg(
        F.max_by("component", F.struct("members", F.col("component"))).alias("largest"), F.sum("members").alias("members"), F.count("*").alias("components"),
    )
    # a family of one component gives no pairs
    counts = counts.where("components > 1").select("a", "largest", F.ceil(F.col("members") / SLICE).alias("slices"))
    placed = fit.join(counts, "a")
    few = placed.where(F.col("component") != F.col("largest")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    every = placed.withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")))
    # two sides outside the largest component meet once, from the smaller component
    once = (F.col("m.component") == F.col("m.largest")) | (F.col("u.component") < F.col("m.component"))
    met = few.alias("u").join(
        every.alias("m"), (F.col("u.a") == F.col("m.a")) & (F.col("u.slice") == F.col("m.slice")) & once
        & (_common("u", "m") <= F.least("u.shared", "m.shared")),
    )
    return met.select(F.least("u.b", "m.b").alias("a"), F.greatest("u.b", "m.b").alias("b"))


def _beside_leader(families: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of one family, in different components, that may reach the threshold.

    Inside the leader's set two documents share at most as many shingles as either shares with the leader. Where
    the threshold needs more, they also share one beside the leader, and such shingles are matched; where it does
    not, both nearly lie inside the leader's set and the pair is compared. Of the shingles beside the leader the rarest
    of the family are matched: those that one component holds come before all others and match nothing, so copies of
    one text, each with its own edits, give no pairs, and neither does a passage that is too short to link its documents.
    A pair is looked at in the family of every leader that both met; two documents that share a bucket have both met
    its leader.
    """
    schema = "a long, b long, component long, n long, shared long, needed long, beside array<long>"
    columns = ["a", "b", "one", "two", "component"]
    parts = settle(map_columns(_with_texts(families, texts).select(columns), _differences, schema), "differences")
    exploded = lambda df: df.select("a", "b", "component", "n", "shared", "needed", F.explode("beside").alias("shingle"))
    # members whose first shingles match none have no partner beside the leader: only the others are spread out whole
    rare = exploded(parts)
    live = settle(rare.join(_across(rare), ["a", "shingle"]).select("a", "b", "component").distinct(), "beside")
    whole = map_columns(_with_texts(live, texts).select(columns), partial(_differences, whole=True), schema)
    every = exploded(settle(whole, "differences"))
    member = Window.partitionBy("a", "b")
    every = every.join(_across(every), ["a", "shingle"])
    every = every.withColumn("at", F.row_number().over(member.orderBy("held", "shingle"))).withColumn("left", F.count("*").over(member) - F.col("at"))
    rare = settle(every.where("left + 1 >= needed"), "beside")
    apart = (F.col("u.a") == F.col("m.a")) & (F.col("u.component") < F.col("m.component"))
    inside = F.least("u.shared", "m.shared")
    # what follows in the order is all that the two can share beyond this shingle, if it is their first
    by_shingle = rare.alias("u").join(
        rare.alias("m"), apart & (F.col("u.shingle") == F.col("m.shingle")) & (_common("u", "m") <= F.least("u.n", "m.n"))
        & (_common("u", "m") <= inside + 1 + F.least("u.left", "m.left")),
    )
    by_size = _inside_leader(parts.select("a", "b", "component", "n", "shared"))
    pair = [F.least("u.b", "m.b").alias("a"), F.greatest("u.b", "m.b").alias("b")]
    return by_shingle.select(*pair).unionByName(by_size).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketched = settle(map_columns(rows, _sketch, "doc_id long, n_shingles long, set_key binary, registers binary"), "sketches")
    present = sketched.where("set_key is not null and doc_id is not null")
    first = settle(present.groupBy("set_key").agg(F.min("doc_id").alias("first")), "classes")
    sketches = present.select("doc_id", "n_shingles", "registers").join(
        first.select(F.col("first").alias("doc_id")).hint("merge"), "doc_id", "left_semi"  # one plan at every size
    )

    bands = map_columns(sketches.select("doc_id", "registers"), _band_rows, "band long, doc_id long")
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1").select("band", "leader")
    buckets = settle(buckets, "buckets")
    members = settle(bands.join(buckets.hint("merge"), "band").select("leader", "doc_id").distinct(), "members")
    known = members.select("doc_id").distinct().hint("merge")
    texts = map_columns(rows, _press, "doc_id long, packed binary").join(known, "doc_id", "left_semi")
    texts = settle(texts.dropDuplicates(["doc_id"]), "texts")
    involved = settle(sketches.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "involved")

    tried = members.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    tried = settle(_estimated(tried, involved), "pairs")
    links = settle(_verified(tried, texts), "links")
    found = settle(components(links), "components")
    # families: the documents that met one leader; those of a single component need nothing more
    placed = tried.select("a", "b").join(found, F.col("b") == F.col("node"), "left").select(
        "a", "b", F.coalesce("component", "b").alias("component")
    )
    placed = settle(placed, "families")
    split = placed.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("a")
    beside = _beside_leader(settle(placed.join(split, "a", "left_semi"), "open"), texts)
    fresh = settle(beside.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = settle(_verified(_estimated(fresh, involved), texts), "links")
    found = settle(components(links.unionByName(more)), "components")
    classes = first.join(found, F.col("first") == F.col("node"), "left").select("set_key", F.coalesce("component", "first").alias("component_id"))
    classes = settle(classes, "classes")
    out = sketched.join(classes.hint("merge"), "set_key", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def setsketch_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op6_setsketch_duplicates": setsketch_duplicates}

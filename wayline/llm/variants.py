"""Spelling variants of words, found in a trie of letter-group counts.

A word's vector counts its letters by group (``GROUPS``). Words stand in a trie whose n-th level branches by the count
of the n-th group. One inserted, deleted or replaced code point lowers at most one count by one and raises at most one by
one, so a depth-first search from a word may spend one deficit and one surplus. Only the word that has the deficit first (or
the longer one) searches, so each pair is met once; words of equal vectors are compared by order. Words in the leaves that
the search reaches are verified letter by letter.

The trie is dealt over tasks: a node is split while more than ``SHARD`` words stand below it, and the nodes left are the
shards. The split nodes, fewer than words / ``SHARD`` on each level, are collected and sent to the tasks, where the same
search walks them to tell the shards a word has to visit; inside a shard it goes on for all visitors together. A shard holds
at most ``SHARD`` words, unless that many share one vector; its visitors arrive in blocks of ``BLOCK``, and each block meets
the shard's words in a group of its own, so neither a task's words nor its visitors grow with the table.

Words are counted inside the tasks first. A word's form is its most frequent near word, if frequent enough; roots come from
pointer doubling, whose steps are bounded by the greatest count because each form is ``RATIO`` times as frequent.

Results for odd input: null and empty texts have no words; a null doc_id counts as an empty one where its digits enter
the hash; repeated rows count again; equal counts go to the smaller word in code-point order; extra columns are
ignored; an empty table gives no rows. A text is held in memory whole, one batch of texts per task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.frames import CRC32_SQL, crc32_of, pick
from wayline.session import settle

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Runs whose hash this divides lose a letter.
STRUCK = 31
#: Letter groups, one trie level each; the last level counts all other letters.
GROUPS = ("e", "a", "i", "n", "o", "t", "r", "s", "l", "d", "u", "hk", "mc", "gp", "bfw", "yvxjqz")
#: Words of a shard, visitors of a block, words of a leaf.
SHARD, BLOCK, LEAF = 20_000, 50_000, 24
#: Pairs verified at once.
PAIRS = 1 << 19

# a UTF-8 run of A-Z, a-z and U+00C0 to U+00FF, lower-cased; C3 leads just these two-byte letters
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_HELD_WORDS = 400_000


# --- counting ------------------------------------------------------------------


def strike(run: bytes, h: int) -> bytes:
    """The run without its code point ``h`` modulo its length."""
    if run.isascii():
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count(struck: int, least: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held]), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(b"%b:" % (b"" if key is None else str(key).encode()))
                for word, n in Counter(_RUN.findall(text.as_py().lower())).items():
                    if len(word) >= least:
                        h = zlib.crc32(word, seed)
                        if h % struck == 0:
                            word = strike(word, h)
                        # bytes of two-byte letters past the first ones do not count
                        if len(word) - word.count(b"\xc3") >= least:
                            held[word] += n
            if len(held) >= _HELD_WORDS:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    return run


def count_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", struck: int = STRUCK, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all texts, after one letter of every ``struck``-th run has gone."""
    rows = pick(docs, doc_id=key, text=text)
    counted = rows.mapInArrow(_count(struck, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the trie ------------------------------------------------------------------


def vectors(words: np.ndarray, groups: tuple[str, ...] = GROUPS) -> np.ndarray:
    """Letter-group counts of words, one row each; the last column counts all other letters."""
    of = np.full(256, len(groups), np.int64)
    for i, letters in enumerate(groups):
        of[[ord(c) for c in letters]] = i
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    level = np.where(codes < 256, of[np.minimum(codes, 255)], len(groups))
    row = np.repeat(np.arange(len(words)), length)
    width = len(groups) + 1
    return np.bincount(row * width + level, minlength=len(words) * width).reshape(len(words), width).astype(np.int32)


def _step(state: int, difference: int) -> int | None:
    """Search state after a level: nothing spent, deficit spent, both spent; None beyond the budget."""
    if difference == 0:
        return state
    if difference == -1 and state == 0:
        return 1
    if difference == 1 and state == 1:
        return 2
    return None


def shards_to_visit(vector: tuple[int, ...], inner: set[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Shards that a depth-first search from the root reaches; ``inner`` holds the split nodes."""
    out, stack = [], [((), 0)]
    while stack:
        node, state = stack.pop()
        if node not in inner:
            out.append(node)
            continue
        count = vector[len(node)]
        for difference in (0, -1, 1):
            after = _step(state, difference)
            if after is not None and count + difference >= 0:
                stack.append(((*node, count + difference), after))
    return out


def _name(node: tuple[int, ...]) -> str:
    return ".".join(map(str, node))


def _home(vector: tuple[int, ...], inner: set[tuple[int, ...]]) -> tuple[int, ...]:
    node: tuple[int, ...] = ()
    while node in inner:
        node = vector[: len(node) + 1]
    return node


def search(words: np.ndarray, own: np.ndarray, asking: np.ndarray, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (visitor, word) of a depth-first search of the trie of ``words`` for all visitors together.

    ``own`` and ``asking`` are their vectors. A node is left as soon as no visitor has budget for it; pairs are candidates, to be
    verified."""
    order = np.lexsort(own.T[::-1])
    own, levels = own[order], own.shape[1]
    stack = [(0, len(order), 0, np.arange(len(visitors)), np.zeros(len(visitors), np.int8))]
    found_v: list[np.ndarray] = []
    found_w: list[np.ndarray] = []
    held = 0
    while stack:
        lo, hi, level, who, state = stack.pop()
        if hi - lo <= LEAF or level == levels:
            for block in range(0, len(who), max(1, PAIRS // (hi - lo))):
                some = who[block : block + max(1, PAIRS // (hi - lo))]
                rest = own[lo:hi, level:][None, :, :] - asking[some][:, level:][:, None, :]
                size = np.abs(rest).sum(axis=2) + state[block : block + len(some)][:, None]
                v, w = np.nonzero(size <= 2)
                # the deficit comes first here too, or nothing is spent
                gap = own[lo + w] - asking[some[v]]
                first = gap[np.arange(len(gap)), (gap != 0).argmax(axis=1)]
                v, w = v[(first == 0) | (first == -1)], w[(first == 0) | (first == -1)]
                found_v.append(some[v])
                found_w.append(order[lo + w])
                held += len(v)
            if held >= PAIRS:
                yield np.concatenate(found_v), np.concatenate(found_w)
                found_v, found_w, held = [], [], 0
            continue
        counts = own[lo:hi, level]  # sorted inside a node
        edges = np.flatnonzero(np.diff(counts)) + 1
        starts = [0, *edges.tolist()]
        asked = asking[who, level]
        for start, end in zip(starts, [*starts[1:], hi - lo]):
            gap = counts[start] - asked
            keep = (gap == 0) | ((gap == -1) & (state == 0)) | ((gap == 1) & (state == 1))
            if keep.any():
                stack.append((lo + start, lo + end, level + 1, who[keep], state[keep] + (gap[keep] != 0)))
    if held:
        yield np.concatenate(found_v), np.concatenate(found_w)


def one_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether words differ by just one inserted, deleted or replaced code point, pair by pair."""
    n_left = np.fromiter(map(len, left), np.int64, len(left))
    n_right = np.fromiter(map(len, right), np.int64, len(right))
    out = np.zeros(len(left), bool)
    longer, shorter = np.where(n_left >= n_right, left, right), np.where(n_left >= n_right, right, left)
    n_long, n_short = np.maximum(n_left, n_right), np.minimum(n_left, n_right)
    order = np.argsort(n_long, kind="stable")
    order = order[n_long[order] - n_short[order] <= 1]
    at = 0
    while at < len(order):
        size = int(n_long[order[at]])
        end = int(np.searchsorted(n_long[order], size, side="right"))
        end = min(end, at + max(1, (1 << 24) // max(1, size)))  # cells of one block
        rows = order[at:end]
        a = np.frombuffer("".join(longer[rows]).encode("utf-32-le"), "<u4").reshape(len(rows), size)
        same = n_short[rows] == size
        if same.any():
            b = np.frombuffer("".join(shorter[rows[same]]).encode("utf-32-le"), "<u4").reshape(int(same.sum()), size)
            out[rows[same]] = (a[same] != b).sum(axis=1) == 1
        if not same.all() and size:
            b = np.frombuffer("".join(shorter[rows[~same]]).encode("utf-32-le"), "<u4").reshape(int((~same).sum()), size - 1)
            long = a[~same]
            # the part before the deleted letter agrees in place, the part behind it one place on
            agree = np.minimum.accumulate(long[:, :-1] == b, axis=1).sum(axis=1)
            behind = np.minimum.accumulate((long[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
            out[rows[~same]] = agree + behind >= size - 1
        at = end
    return out


_ROUTED = "shard string, block long, word string, n long, visits boolean"


def _route(inner: set[tuple[int, ...]], blocks: dict[str, int]):
    """Copies of a word: one for every block of its own shard's visitors, and one for every shard that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = batch.column(1).to_pylist()
            out: list[tuple] = []
            known: dict[tuple, list[str]] = {}
            for word, n, vector in zip(words, counts, map(tuple, vectors(words).tolist()), strict=True):
                home = _name(_home(vector, inner))
                out += [(home, block, word, n, False) for block in range(blocks.get(home, 1))]
                near = known.get(vector)
                if near is None:
                    near = known[vector] = [_name(s) for s in shards_to_visit(vector, inner)]
                h = zlib.crc32(word.encode())
                out += [(shard, h % blocks.get(shard, 1), word, n, True) for shard in near]
                if len(out) >= 100_000:
                    yield _routed(out)
                    out = []
            if out:
                yield _routed(out)

    return run


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["shard", "block", "word", "n", "visits"])


_EDGES = "word string, n long, near string, near_n long"


def _match(table: pa.Table) -> pa.Table:
    """Near pairs between the words of a shard and a block of its visitors."""
    word = np.array(table.column("word").to_pylist(), object)
    n = table.column("n").to_numpy()
    visits = np.array(table.column("visits").to_pylist(), bool)
    mine, theirs = np.flatnonzero(~visits), np.flatnonzero(visits)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if len(mine) and len(theirs):
        vector = vectors(word)
        for v, w in search(word[mine], vector[mine], vector[theirs], theirs):
            v, w = theirs[v], mine[w]
            # equal vectors meet from both sides: the smaller word's search counts
            equal = (vector[v] == vector[w]).all(axis=1)
            keep = ~equal | (word[v] < word[w])
            v, w = v[keep], w[keep]
            good = one_apart(word[v], word[w])
            pairs.append((v[good], w[good]))
    v = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    w = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.table(
        {
            "word": pa.array(word[v], pa.string()), "n": pa.array(n[v], pa.int64()), "near": pa.array(word[w], pa.string()),
            "near_n": pa.array(n[w], pa.int64()),
        }
    )


def near_words(words: DataFrame, *, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n), each pair of near words once; ``words`` (word, n) has distinct words and is read twice."""
    from pyspark.sql.types import StructType

    levels = len(GROUPS) + 1

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(_name(v[:d]) for v in map(tuple, vectors(batch.column(0).to_pylist()).tolist()) for d in range(levels))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], names=["node", "n"])

    # nodes over more than a shard's words: fewer than words / shard on each level
    split = words.select("word").mapInArrow(prefixes, "node string, n long").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") > shard)
    inner = {tuple(map(int, r["node"].split("."))) if r["node"] else () for r in split.collect()}
    schema = StructType.fromDDL(_ROUTED)
    # visitors of each shard that needs more than one block
    visitors = words.mapInArrow(_route(inner, {}), schema).where("visits").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = {r["shard"]: -(-r["n"] // block) for r in visitors.collect()}  # at most one row per shard
    return words.mapInArrow(_route(inner, blocks), schema).groupBy("shard", "block").applyInArrow(_match, _EDGES)


# --- forms ---------------------------------------------------------------------


def forms(words: DataFrame, *, ratio: int = RATIO, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n; a null form where no near word is ``ratio`` times as frequent."""
    pairs = settle(near_words(words, shard=shard, block=block), "near-words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    known = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    good = F.col("form_n") >= ratio * F.col("n")
    known = settle(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"),
            F.when(good, F.col("form_n")).alias("form_n"),
        ),
        "word-forms",
    )
    most = known.agg(F.max("n").alias("n")).first()["n"] or 1  # one number
    steps = math.floor(math.log(most, ratio)) + 1  # links of the longest chain at most
    # only words with a form point anywhere; pointers are doubled until they pass the longest chain
    links = known.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = settle(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "word-roots")
        reach *= 2
    return known.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variant_groups(spark: SparkSession, folder: str) -> DataFrame:
    return forms(settle(count_words(spark.read.parquet(f"{folder}/documents.parquet")), "words"))


_SQL = f"""
WITH RECURSIVE {CRC32_SQL},
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH}),
c AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS t FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc32_of('t')} AS h FROM c, crc_table),
k AS (SELECT CASE WHEN h % {STRUCK} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
g AS (SELECT word, i, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS gone
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT DISTINCT a.word, b.word AS near FROM g a JOIN g b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT g.word, w.word FROM g JOIN w ON w.word = g.gone UNION SELECT w.word, g.word FROM g JOIN w ON w.word = g.gone),
f AS (SELECT e.word, count(*) AS n_near, arg_min(near, (-b.n, near)) AS form, max(b.n) AS form_n FROM e JOIN w b ON b.word = e.near GROUP BY e.word),
v AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM w LEFT JOIN f USING (word)),
p AS (SELECT word, word AS root, form AS next FROM v UNION ALL SELECT p.word, v.word, v.form FROM p JOIN v ON v.word = p.next)
SELECT v.word, v.form, p.root, v.n, v.n_near, v.form_n FROM v JOIN p ON p.word = v.word AND p.next IS NULL
"""

QUERIES = {"op11_variant_groups": variant_groups}
ORACLES = {"op11_variant_groups": _SQL}

"""Vector best-fit packing of token pieces into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are placed
from long to short, each into the open bin whose weighted residual vector has the smallest norm afterwards, under
every constraint. Pieces of one length are alike, so bins are chosen for whole runs of them: the driver sees a
histogram with at most ``tokens`` rows and returns runs of places, whose number depends on the lengths and not on
the data. Rows get their place by their rank among the pieces of their length.

Results for odd input: a null text is an empty one, which still holds the closing id; repeated rows and equal lengths are
ordered by key and piece and each get a place; extra columns are ignored; an empty table gives no rows. A text is
held in memory whole, one at a time beside its batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.frames import pick, tokenizer_path
from wayline.session import settle

VOCABULARY = "byte_bpe_50k.json"
TOKENS = 1_024
DOCUMENTS = 1_024
COST = TOKENS * TOKENS
WEIGHTS = (1.0, 0.1, 0.1)
CLOSING = 2

_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*")
_LETTER = "a-zA-ZÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_KNOWN_WORDS = 300_000


class WordIds(dict):
    """Packed ids by word; starts anew when it has grown too large."""

    def __init__(self, path: str):
        from wayline.llm.distinct_words import load

        self.tok, self.alphabet = load(path)

    def __missing__(self, word: str) -> bytes:
        from wayline.llm.distinct_words import word_ids

        packed = np.array(word_ids(word, self.tok, self.alphabet), "<u4").tobytes()
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = packed
        return packed


@lru_cache(maxsize=1)
def _known(path: str) -> WordIds:
    return WordIds(path)


def split(text: str, tok, added: re.Pattern) -> list[str]:
    """Words of a text as the byte-level splitting gives them; those of unusual texts in its byte alphabet, behind a NUL."""
    if "<|" in text and added.search(text):
        parts = added.split(text)
        return [w for i, part in enumerate(parts) for w in (["\x01" + part] if i % 2 else split(part, tok, added))]
    if _PLAIN.fullmatch(text):
        return _WORD.findall(text)
    return ["\x00" + word for word, _ in tok.pre_tokenizer.pre_tokenize_str(text)]


def _cut(path: str, tokens: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wayline.llm.distinct_words import added_tokens

        known = _known(path)
        added = added_tokens(known.tok)
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            kept = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = b"".join(map(known.__getitem__, split(text.as_py() or "", known.tok, added))) + closing
                n = len(packed) // 4
                first = n % tokens or tokens
                for piece, end in enumerate(range(first, n + 1, tokens)):
                    start = max(0, end - tokens) if piece else 0
                    part = packed[4 * start : 4 * end]
                    for name, value in zip(out, (key, piece, start, end - start, zlib.crc32(part)), strict=True):
                        out[name].append(value)
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<i4"))
            fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
            if keep_ids:
                out["ids"], fields = kept, [*fields, ("ids", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))
            pa.default_memory_pool().release_unused()

    return run


def token_pieces(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, vocabulary: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; only texts over ``tokens`` ids are cut.

    ``keep_ids`` adds the ids of each piece.
    """
    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_cut(vocabulary or tokenizer_path(VOCABULARY), tokens, keep_ids), schema)


def best_fit(
    histogram: dict[int, int], tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights: tuple[float, float, float] = WEIGHTS,
) -> list[tuple[int, int, int, int, int]]:
    """Runs of places as (length, first rank, places, first sequence, offset): rank r goes to sequence first + r - rank."""
    capacity = np.array([tokens, documents, cost], float)
    left = np.empty((0, 3))  # residual capacities of each run of alike bins
    first: list[int] = []
    size: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    scale = np.array(weights) / capacity
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, todo = 0, histogram[length]
        while todo:
            fits = (left >= item).all(axis=1)
            if fits.any():
                norm = np.where(fits, (((left - item) * scale) ** 2).sum(axis=1), np.inf)
                at = int(norm.argmin())
                n = min(todo, size[at])
                runs.append((length, rank, n, first[at], int(tokens - left[at, 0])))
                rest = left[at] - item
                if n < size[at]:  # the run is split: its tail stays as it was
                    left = np.vstack([left, left[at]])
                    first.append(first[at] + n)
                    size.append(size[at] - n)
                left[at], size[at] = rest, n
                rank, todo = rank + n, todo - n
                continue
            # new bins take as many pieces of this length as they hold
            each = int(min(capacity // item))
            whole, some = divmod(todo, each)
            for bins, held in ((whole, each), (1, some)):
                if bins and held:
                    for i in range(held):
                        runs.append((length, rank + i * bins, bins, opened, i * length))
                    rank += bins * held
                    left = np.vstack([left, capacity - held * item])
                    first.append(opened)
                    size.append(bins)
                    opened += bins
            todo = 0
        alive = left[:, 0] >= 1
        if not alive.all():
            left, first, size = left[alive], [f for f, a in zip(first, alive) if a], [s for s, a in zip(size, alive) if a]
    return runs


def pack(
    pieces: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length", tokens: int = TOKENS, documents: int = DOCUMENTS,
    cost: int = COST, weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is read several times and should be a written table."""
    spark: SparkSession = pieces.sparkSession
    seen = pieces.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n")).collect()  # at most ``tokens`` rows
    runs = best_fit({r["length"]: r["n"] for r in seen}, tokens, documents, cost, weights)
    places = spark.createDataFrame(runs, "length long, first_rank long, n long, first_sequence long, offset long")

    # rank among equal lengths: inside a hashed bucket first, then shifted by the buckets before it
    buckets = max(256, sum(r["n"] for r in seen) // 2_000_000)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    own = pieces.withColumn("_bucket", bucket)
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = own.groupBy(length, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*keys))
    ranked = own.withColumn("_inside", inside).join(shift.drop("_n"), [length, "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_inside") - 1 + F.col("_before"))
    at = (F.col(f"i.{length}") == F.col("p.length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.alias("i").join(F.broadcast(places).alias("p"), at)  # bounded by the number of lengths
    return placed.select(
        *(F.col(f"i.{c}") for c in pieces.columns),
        (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"), F.col("p.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack(settle(token_pieces(docs, **options), "token-pieces"))


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op4_best_fit_packing": best_fit_packing}

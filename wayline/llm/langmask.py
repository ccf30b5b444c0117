"""Language identification with a Bloom filter whose slots hold one bit per language.

``fit`` counts character n-grams of a bounded sample of labelled rows and stores, for each language, its most
frequent ones; a language counts as containing an n-gram only if its share there is not far below the share it
has in the language that uses it most, so that stray foreign words set no bit. A slot is a mask with one bit per language; the AND over an n-gram's slots gives all languages
that contain it. ``identify`` adds up, per language, how many n-grams of a text carry its bit, takes off the
share expected from false positives, and decides for the largest count.

Results for odd input: null or letterless text gives ``und`` with score 0; ties go to the language with more
labelled rows, then in alphabetical order; repeated rows each get a row; extra columns are ignored; an empty table gives no rows. With
no labelled row at all there is no language to learn and every text is ``und``. Texts of any length are read
whole, in pieces of 200 000 characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.frames import map_columns, pick
from wayline.session import settle

ORDERS = (2, 4)
UNKNOWN = "und"
#: Bounds of the fit: expected labelled rows and stored n-grams for each language.
SAMPLE_ROWS = 2_000
GRAMS_PER_LANGUAGE = 60_000
#: Languages of one mask; more take further masks, one array each.
MASK = 64
#: Least share of an n-gram in a language, against its largest share in any.
CONTRAST = 0.3
#: Slots of the filter, 8 bytes each; two hash functions.
SLOTS = 1 << 20

_PIECE = 200_000
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of about as many characters; a longer text is read in overlapping pieces."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        for at in range(0, len(lowered), _PIECE):
            part = lowered[max(0, at - max(ORDERS) + 1) : at + _PIECE]
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= _PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the text, hash) of every character n-gram; anything but letters counts as one space."""
    letters = _letters()
    for owners, parts in _pieces(texts):
        points = np.frombuffer(" ".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        # a piece owns its leading space; the last space belongs to the last piece
        owner = np.repeat(np.array(owners), np.array([len(p) + 1 for p in parts]))
        owner = np.append(owner, owners[-1])
        points = np.where(letters[points], points, np.uint32(32))
        keep = np.append(True, (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1]))
        points, owner = points[keep].astype(np.uint64), owner[keep]
        for n in ORDERS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            # the space that ends a text is the one that begins the next
            same = owner[: len(h)] == owner[max(0, n - 2) : max(0, n - 2) + len(h)]
            yield owner[: len(h)][same], h[same]


def _slots(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    first = h % np.uint64(size)
    second = ((h ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(size)
    return first.astype(np.int64), second.astype(np.int64)


@dataclass
class LanguageMasks:
    """Filter with one mask per slot, its languages, and each language's false-positive rate."""

    languages: list[str]
    masks: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, kept: dict[str, np.ndarray], slots: int = SLOTS) -> LanguageMasks:
        """``kept``: hashes of the n-grams of each language; the first of its languages win ties."""
        languages = list(kept)
        masks, fill = [], []
        for first in range(0, max(1, len(languages)), MASK):
            some = languages[first : first + MASK]
            width = next(t for t in (8, 16, 32, 64) if t >= max(1, len(some)))
            mask = np.zeros(slots, f"uint{width}")
            for bit, lang in enumerate(some):
                for at in _slots(kept[lang].astype(np.uint64), slots):
                    mask[np.unique(at)] |= mask.dtype.type(1 << bit)
            masks.append(mask)
            fill += [np.count_nonzero(mask & mask.dtype.type(1 << b)) / slots for b in range(len(some))]
        return cls(languages, masks, np.array(fill) ** 2)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them carry each language's bit."""
        n = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.languages)), np.int64)
        for owner, h in grams(texts):
            n += np.bincount(owner, minlength=len(texts))
            one, two = _slots(h, len(self.masks[0]))
            for number, mask in enumerate(self.masks):
                found = mask[one] & mask[two]
                for bit in range(min(MASK, len(self.languages) - number * MASK)):
                    with_bit = (found >> found.dtype.type(bit)) & found.dtype.type(1)
                    hits[:, number * MASK + bit] += np.bincount(owner, weights=with_bit, minlength=len(texts)).astype(np.int64)
        return n, hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = _letters()
        known = np.array([bool(t) and _any_letter(t, letters) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n, hits = self.counts(texts)
        true = np.clip((hits - n[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def _any_letter(text: str, letters: np.ndarray) -> bool:
    if text[:1].isalpha():
        return True
    return any(
        letters[np.frombuffer(text[i : i + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)].any()
        for i in range(0, len(text), _PIECE)
    )


def _count_grams(columns: list) -> Iterator[tuple[list, ...]]:
    langs = columns[0].to_pylist()
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs])
    texts = columns[1].to_pylist()
    totals: dict[str, list[np.ndarray]] = {x: [] for x in names}
    for owner, h in grams(texts):
        of = code[owner]
        for i, name in enumerate(names):
            totals[name].append(h[of == i])
    for name, parts in totals.items():
        if parts:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield [name] * len(values), values.view(np.int64), n


def fit(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageMasks:
    """Learn from about ``rows`` labelled rows of each language (all, where there are fewer).

    Rows are drawn by a hash of their text, so the draw is the same on every run. What reaches the driver is
    bounded by the languages: a row and ``grams_per_language`` hashes for each.
    """
    rows_of = pick(labelled, text=text, lang=lang).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows_of.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return LanguageMasks.build({})
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, min(1.0, rows / n)))), F.col("lang"))
    counted = map_columns(rows_of.where(draw < rate).select("lang", "text"), _count_grams, "lang string, gram long, n long")
    summed = settle(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    sizes = {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return LanguageMasks.build({x: np.array([], np.int64) for x in sorted(totals, key=lambda x: (-totals[x], x))})
    share = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, n))), F.col("lang"))
    most = F.max("share").over(Window.partitionBy("gram"))
    summed = settle(summed.withColumn("share", share).withColumn("most", most).where(F.col("share") >= CONTRAST * F.col("most")), "language-grams")
    kept = {}
    for name in sorted(totals, key=lambda x: (-totals[x], x)):
        top = summed.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(grams_per_language).select("gram")
        kept[name] = top.toPandas()["gram"].to_numpy(np.int64)
    return LanguageMasks.build(kept)


def identify(docs: DataFrame, masks: LanguageMasks, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the prediction sees the text alone."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(masks)  # SLOTS * 8 bytes for each 64 languages

    def label(columns: list) -> tuple[list, ...]:
        names, score = shared.value.predict(columns[1].to_pylist())
        return columns[0], names, score

    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_columns(rows, label, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, masks: LanguageMasks, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known, with a score of at least ``least``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(masks)  # SLOTS * 8 bytes for each 64 languages
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, score = shared.value.predict(batch.column(place).to_pylist())
                fine = np.array([n != UNKNOWN for n in names]) & (score >= least)
                yield batch.filter(pa.array(fine))
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_masks(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_masks": language_masks}

"""Quality rules on compression ratios.

A text's zstandard ratio (compressed / original bytes) must lie in the band of its length: below it the text
repeats itself, above it it is noise. The same holds for fixed chunks of it, of which a given share may fail; the
last one ends where the text does and overlaps the one before, and a text shorter than a chunk is one in its own band.
Base counts of words, symbols, repeated lines and repeated word windows come with it.

Results for odd input: null and empty texts have no words, fail the base rule and have no ratio. Texts under 100
bytes are judged for repetition only. Repeated rows each get a row, extra columns are ignored, an empty table gives
no rows. Every text is read whole: one text at a time is held in memory.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.frames import map_columns, pick

#: (bytes from, least ratio, largest ratio); short texts carry more overhead, long ones repeat more words. Under 100
#: bytes the frame around the data outweighs what compression saves, so noise and text have the same ratios there.
BANDS = ((1, 0.40, float("inf")), (100, 0.40, 1.05), (500, 0.35, 0.80), (2_000, 0.30, 0.70), (10_000, 0.25, 0.65))
CHUNK = 2_048
CHUNK_BAND = (0.25, 0.80)
BAD_CHUNKS = 0.5
LEVEL = 3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside an 8-word window that occurs at least twice. Windows are told apart by a 64-bit hash."""
    if len(words) <= WINDOW:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - WINDOW + 1
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows += each[k : k + n] * _MIX[k]
    order = np.argsort(windows, kind="stable")
    equal = np.diff(windows[order].view(np.int64)) == 0
    if not equal.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = data.split()  # splits on exactly the six ASCII white-space bytes
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), int(seen[_FIRST & ~_SPACE].sum()), int(seen[_SYMBOL].sum()), len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression_verdict(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[bool, float | None, int, int]:
    """(in its bands, ratio of the whole, chunks, chunks outside the chunk band)."""
    limits = next(((low, high) for size, low, high in reversed(BANDS) if len(data) >= size), None)
    if limits is None:
        return True, None, 0, 0
    ratio = len(packer.compress(data)) / len(data)
    if len(data) < CHUNK:  # its own only chunk, in the band of its length
        return limits[0] <= ratio <= limits[1], ratio, 1, int(not limits[0] <= ratio <= limits[1])
    starts = [*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK]
    chunks = [data[i : i + CHUNK] for i in starts]
    bad = sum(not CHUNK_BAND[0] <= len(packer.compress(c)) / CHUNK <= CHUNK_BAND[1] for c in chunks)
    return limits[0] <= ratio <= limits[1] and bad <= BAD_CHUNKS * len(chunks), ratio, len(chunks), bad


def judge(data: bytes | None, packer: zstandard.ZstdCompressor) -> tuple:
    data = data or b""
    counts = base_counts(data)
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    good, ratio, chunks, bad = compression_verdict(data, packer)
    return (*counts, failed, not failed and good, ratio, chunks, bad)


def _judge_batch(columns: list) -> tuple[list, ...]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = [judge(x.as_py(), packer) for x in columns[1]]
    return columns[0], *map(list, zip(*rows))


def quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ratios and verdict of every row."""
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_columns(rows, _judge_batch, SCHEMA)


def compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op3_compression_bands": compression_bands}

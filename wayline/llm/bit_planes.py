"""Token ids in files of transposed planes, with a chunk index.

Documents are sorted by key over the whole table; every task writes its stretch of them as one file. The ids of a file
are cut into chunks of a fixed number of ids. A chunk is transposed: all lowest bytes of its ids first, then all second
bytes and so on (or, as bits, the lowest bits of all ids, ...), and every plane is compressed with zstandard by itself.
High planes of small ids hold zeros and cost next to nothing. The chunk index of a file (place, ids, plane sizes and
crc32 of every chunk) and the lengths of its documents stand behind the chunks, the place of the index in the last bytes.

A file::

    b"WPLN1" kind width | chunk 0 | chunk 1 | ... | index | place of the index, its length (two 8-byte numbers) | b"WPLN1"

Tasks write under names of their own attempt, and only names that a committed manifest row holds are read: a task that is
lost and run again leaves a file nobody reads. The manifest is a table with one row per file; running totals over it give the
number of ids before each file. A range of ids is read through it and the chunk index without touching other chunks.

Results for odd input: a null or empty text holds the closing id alone; null keys come first; equal keys are ordered by
text, and repeated rows each get a place; extra columns are ignored; an empty table gives no rows, and a dataset
without ids. A text is held in memory whole, one at a time beside its batch; a chunk is written as soon as it is full.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.distinct_words import added_tokens, load, split, word_ids
from wayline.llm.frames import pick, tokenizer_path
from wayline.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
CLOSING = 1
#: Ids of a chunk.
CHUNK = 1 << 16
#: Documents of a file, on average.
FILE_ROWS = 200_000
MAGIC = b"WPLN1"
_KNOWN_WORDS = 600_000


# --- planes --------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first; a bit plane is filled up to a whole byte."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


class PlaneWriter:
    """Writes ids to an open binary stream, one chunk at a time, and the index at the end."""

    def __init__(self, out, kind: str = "byte", chunk: int = CHUNK, level: int = 3):
        self.out, self.kind, self.chunk = out, kind, chunk
        self.press = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.chunks: list[tuple] = []
        self.lengths: list[int] = []
        self.keys: list[int | None] = []
        self.at = self._write(MAGIC + bytes([kind == "bit", 4]))
        self.n_ids = 0

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def add(self, ids: np.ndarray, key: int | None = None) -> None:
        """Append one document."""
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.chunk * self.chunk
            for start in range(0, whole, self.chunk):
                self._flush(flat[start : start + self.chunk])
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(p) for p in to_planes(ids, self.kind)]
        data = b"".join(packed)
        self.chunks.append((self.at, len(ids), zlib.crc32(data), *map(len, packed)))
        self.at += self._write(data)

    def finish(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        table = np.array(self.chunks, "<i8").reshape(len(self.chunks), -1)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        known = np.array([k is not None for k in self.keys], np.uint8)
        index = self.press.compress(
            struct.pack("<QQQ", *table.shape, len(keys)) + table.tobytes() + np.array(self.lengths, "<i8").tobytes() + keys.tobytes() + known.tobytes()
        )
        place = self.at
        self._write(index)
        self._write(struct.pack("<QQ", place, len(index)) + MAGIC)


class PlaneReader:
    """Random access to one file: chunks are fetched and decompressed only when asked for."""

    def __init__(self, source):
        """``source`` is a seekable binary stream."""
        self.source = source
        size = source.seek(0, io.SEEK_END)
        place, length, magic = struct.unpack(f"<QQ{len(MAGIC)}s", self._read(size - 16 - len(MAGIC), 16 + len(MAGIC)))
        head = self._read(0, len(MAGIC) + 2)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError("no plane file")
        self.kind = "bit" if head[len(MAGIC)] else "byte"
        data = zstandard.ZstdDecompressor().decompress(self._read(place, length))
        rows, width, docs = struct.unpack_from("<QQQ", data)
        self.chunks = np.frombuffer(data, "<i8", rows * width, 24).reshape(rows, width)
        at = 24 + 8 * rows * width
        self.lengths = np.frombuffer(data, "<i8", docs, at)
        keys, known = np.frombuffer(data, "<i8", docs, at + 8 * docs), np.frombuffer(data, np.uint8, docs, at + 16 * docs)
        self.keys = [k if some else None for k, some in zip(keys.tolist(), known.tolist(), strict=True)]
        self.chunk_starts = np.concatenate([[0], np.cumsum(self.chunks[:, 1])]) if rows else np.zeros(1, np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read_chunk(self, number: int) -> np.ndarray:
        at, n, crc, *sizes = self.chunks[number].tolist()
        data = self._read(at, sum(sizes))
        if zlib.crc32(data) != crc:
            raise ValueError(f"chunk {number} is damaged")
        loose, planes, start = zstandard.ZstdDecompressor(), [], 0
        for size in sizes:
            planes.append(loose.decompress(data[start : start + size]))
            start += size
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range of the file; only chunks that hold some are read."""
        stop = min(stop, int(self.chunk_starts[-1]))
        if start >= stop:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.chunk_starts, start, side="right")) - 1
        last = int(np.searchsorted(self.chunk_starts, stop, side="left"))
        flat = np.concatenate([self.read_chunk(i) for i in range(first, last)])
        return flat[start - int(self.chunk_starts[first]) : stop - int(self.chunk_starts[first])]

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of every document in order, holding one chunk beside the document."""
        number, rest = 0, np.zeros(0, "<u4")
        for n in self.lengths.tolist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.read_chunk(number))
                have += len(parts[-1])
                number += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield flat[:n]
            rest = flat[n:]


# --- encoding ------------------------------------------------------------------


class WordIds(dict):
    """Packed ids by word; starts anew when it has grown too large."""

    def __init__(self, path: str):
        self.tok, self.alphabet = load(path)
        self.added = added_tokens(self.tok)

    def __missing__(self, word: str) -> bytes:
        ids = word_ids(word, self.tok, self.alphabet)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split(text, self.tok, self.added)))


@lru_cache(maxsize=1)
def _known(path: str) -> WordIds:
    return WordIds(path)


# --- datasets ------------------------------------------------------------------


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


_MANIFEST = "part int, file string, n_docs long, n_ids long, n_chunks long, n_bytes long"


def _write_files(folder: str, path: str, closing: int, kind: str, chunk: int):
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        known, out, writer = _known(path), None, None
        for batch in batches:
            if writer is None and batch.num_rows:
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
                writer = PlaneWriter(out, kind, chunk)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(np.frombuffer(known.encode(text.as_py() or "") + end, "<u4"), key)
            pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.finish()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(writer.lengths)], "n_ids": [writer.n_ids],
                    "n_chunks": [len(writer.chunks)], "n_bytes": [size],
                }
            )

    return run


def write(
    docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, closing: int = CLOSING,
    planes: str = "byte", chunk: int = CHUNK, file_rows: int = FILE_ROWS,
) -> DataFrame:
    """Write the ids of all documents in ascending order of their key to ``folder``; returns the manifest.

    ``folder`` must be reachable by all executors; ``planes`` is byte or bit. The manifest is kept in ``folder``/manifest and
    has one row per file, with the ids and documents before it."""
    if planes not in ("byte", "bit") or chunk < 1:
        raise ValueError("planes are byte or bit, a chunk holds one id or more")
    spark: SparkSession = docs.sparkSession
    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // file_rows))
    ordered = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    done = ordered.mapInArrow(_write_files(folder, vocabulary or tokenizer_path(VOCABULARY), closing, planes, chunk), _MANIFEST)
    place = f"{folder.rstrip('/')}/manifest"
    done.write.parquet(place)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a dataset with the ids and documents before each; one row per file."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({c: F.coalesce(F.sum(n).over(before), F.lit(0)) for c, n in (("ids_before", "n_ids"), ("docs_before", "n_docs"))})


def read_documents(spark: SparkSession, folder: str, columns: str = "ids array<int>", wanted=None) -> DataFrame:
    """(doc_id, start, what ``wanted`` makes of a document's ids) of every document, read back from the files.

    Without ``wanted`` the ids themselves; with it, ``columns`` is the DDL of the values that ``wanted(ids)`` gives."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = "doc_id long, start long, " + columns
    schema = to_arrow_schema(StructType.fromDDL(out))
    make = wanted or (lambda ids: (ids.astype(np.int32),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{root}/{file}") as source:
                    reader, rows, held = PlaneReader(source), [], 0
                    for key, ids in zip(reader.keys, reader.documents(), strict=True):
                        rows.append((key, start, *make(ids)))
                        start, held = start + len(ids), held + len(ids)
                        if held >= 1 << 20:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, schema)

    files = manifest(spark, folder).select("file", "ids_before")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "file").mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def read_ranges(spark: SparkSession, folder: str, ranges: DataFrame) -> DataFrame:
    """(range_id, start, ids) for ``ranges`` (range_id, start, stop) of the dataset's ids, in parts that lie in one file each.

    Only the chunks that hold such ids are read."""
    files = manifest(spark, folder).where("n_ids > 0")
    wanted = pick(ranges, range_id="range_id", lo="start", hi="stop")
    meets = (F.col("lo") < F.col("ids_before") + F.col("n_ids")) & (F.col("hi") > F.col("ids_before"))
    met = wanted.join(files, meets).select("file", "ids_before", F.col("range_id").cast("long"), F.col("lo").cast("long"), F.col("hi").cast("long"))
    schema = pa.schema([("range_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(table: pa.Table) -> pa.Table:
        system, root = _open(folder)
        out = []
        with system.open_input_file(f"{root}/{table.column('file')[0].as_py()}") as source:
            reader = PlaneReader(source)
            for r in table.to_pylist():
                first = max(0, r["lo"] - r["ids_before"])
                ids = reader.ids(first, r["hi"] - r["ids_before"])
                out.append((r["range_id"], r["ids_before"] + first, ids.astype(np.int32)))
        return pa.Table.from_batches([_batch(out, schema)])

    return met.groupBy("file").applyInArrow(run, "range_id long, start long, ids array<int>")


def plane_files(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "token-planes")
    write(spark.read.parquet(f"{folder}/documents.parquet"), place)
    return read_documents(spark, place, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes())))


QUERIES = {"op12_plane_files": plane_files}

"""Token ids through a table of distinct words.

Texts are split into words exactly as the tokenizer's own splitting does. Documents are gathered in blocks; a
block keeps its word sequence as slots of its own distinct words. The distinct words of all blocks form one
table, dealt by a hash of the word into buckets (four to a partition). There each word is encoded once and
its ids go back to every block by position (block, slot). Words and ids travel packed, one row for a block and
bucket, which keeps the shuffles below the size of the texts. A block holds a word once, so no word is hot. Both shuffles
have a partition for every ``PART`` bytes of text, so a task's share does not grow with the table. A token
decodes to its piece, so a word decodes to the pieces of its ids, looked up in the id-to-piece table of the
vocabulary, whose size is fixed.

Results for odd input: null and empty texts have no ids and decode to the empty text; added tokens spelled out in a
text become their ids; repeated rows each get a row; extra columns are ignored; an empty table gives no rows. A text is
held in memory whole, one block of texts per task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm.frames import pick, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Characters of text in a block; longer blocks share more of their words, and take more memory.
BLOCK = 24_000_000
#: Bytes of text behind a partition of the shuffles.
PART = 4 * BLOCK
#: No word holds it: splitting drops white space.
SEPARATOR = "\n"

#: Texts of these characters only are split by a plain pattern; all others by the tokenizer itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*")
_LETTER = "a-zA-ZÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{_LETTER}0-9]+")


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Tokenizer, dict[int, str]]:
    """The tokenizer without truncation and padding, and the alphabet of its bytes."""
    from tokenizers import pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    alphabet = {}
    for b in range(256):
        if b < 128:
            alphabet[b] = level.pre_tokenize_str(chr(b))[0][0]
    for c in range(128, 2048):
        for byte, sign in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
            alphabet[byte] = sign
    for c in (0x800, 0xFFFF, *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x40000), 0x10FFFF):
        if not 0xD800 <= c < 0xE000:
            for byte, sign in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
                alphabet[byte] = sign
    return tok, alphabet


def split(text: str, tok: Tokenizer, added: re.Pattern) -> list[str]:
    """Words of a text. A word that the tokenizer split itself carries its byte alphabet behind a NUL."""
    if "<|" in text and added.search(text):
        parts = added.split(text)
        return [w for i, part in enumerate(parts) for w in (["\x01" + part] if i % 2 else split(part, tok, added))]
    if _PLAIN.fullmatch(text):
        return _WORD.findall(text.lower())
    normal = tok.normalizer.normalize_str(text) if tok.normalizer else text
    return ["\x00" + word for word, _ in tok.pre_tokenizer.pre_tokenize_str(normal)]


def added_tokens(tok: Tokenizer) -> re.Pattern:
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, names or ["(?!)"])) + ")")


def word_ids(word: str, tok: Tokenizer, alphabet: dict[int, str]) -> list[int]:
    if word[0] == "\x01":
        return [tok.token_to_id(word[1:])]
    signs = word[1:] if word[0] == "\x00" else "".join(alphabet[b] for b in word.encode())
    return [t.id for t in tok.model.tokenize(signs)]


class Slots(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _cut(batches: Iterator[pa.RecordBatch], tok: Tokenizer, added: re.Pattern, block: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Blocks of (document, words); a document of several blocks' length is a block of its own."""
    rows, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_py() or ""
            rows.append((key, split(value, tok, added)))
            size += len(value)
            if size >= block:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _name(number: int, words: list[str]) -> str:
    """Both readings of the documents cut the same rows alike; if they ever did not, the names would not meet."""
    return f"{TaskContext.get().partitionId()}-{number}-{len(words)}-{zlib.crc32(SEPARATOR.join(words).encode()):08x}"


def _bucket_of(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(buckets)


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _loose(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(seq: np.ndarray) -> bytes:
    """Slots as four runs of bytes, lowest first, which pack better than whole numbers."""
    return _press(np.ascontiguousarray(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_loose(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _sequences(path: str, block: int, buckets: int):
    """Per block: its documents as slots, and the bucket of every slot."""
    schema = pa.schema(
        [("block", pa.string()), ("bucket", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = load(path)
        for number, rows in enumerate(_cut(batches, tok, added_tokens(tok), block)):
            slots = Slots()
            docs = [(key, np.fromiter(map(slots.__getitem__, words), np.uint32, len(words))) for key, words in rows]
            words = list(slots)
            bucket = _press(_bucket_of(words, buckets).astype("<u4").tobytes())
            for at in range(0, len(docs), 4096):
                some = docs[at : at + 4096]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [_name(number, words)], "bucket": [bucket if at == 0 else None], "doc_ids": [[k for k, _ in some]],
                        "lengths": [[len(s) for _, s in some]], "packed": [_planes(np.concatenate([s for _, s in some]))],
                    },
                    schema=schema,
                )

    return run


def _words(path: str, block: int, buckets: int):
    """Per block and bucket: the block's distinct words, in the order of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, _ = load(path)
        for number, rows in enumerate(_cut(batches, tok, added_tokens(tok), block)):
            slots: dict[str, None] = {}
            for _, words in rows:
                slots.update(dict.fromkeys(words))
            words = list(slots)
            of = _bucket_of(words, buckets)
            order = np.argsort(of, kind="stable")
            held, start = np.unique(of[order], return_index=True)
            name, ends = _name(number, words), [*start[1:].tolist(), len(words)]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(held.astype(np.int32)), "block": [name] * len(held),
                    "words": pa.array([_press(SEPARATOR.join([words[i] for i in order[s:e]]).encode()) for s, e in zip(start.tolist(), ends)], pa.binary()),
                }
            )

    return run


def _encode_bucket(path: str):
    """A bucket of the word table: each of its distinct words is encoded once, and every block gets its ids back."""
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, alphabet = load(path)
        width = id_type(path)
        known: dict[str, bytes] = {}
        for batch in batches:
            # a block's words one at a time: of a bucket only its distinct words stay
            for bucket, block, packed in zip(batch.column("bucket"), batch.column("block"), batch.column("words"), strict=True):
                ids = []
                for word in _loose(packed.as_py()).decode().split(SEPARATOR):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(word_ids(word, tok, alphabet), width).tobytes()
                    ids.append(found)
                sizes = np.fromiter(map(len, ids), "<u4", len(ids))
                row = {"block": [block.as_py()], "bucket": [bucket.as_py()], "n": [len(ids)], "ids": [_press(sizes.tobytes() + b"".join(ids))]}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

    return run


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    """Two bytes hold the ids of a vocabulary of up to 65 536 entries, four those of a larger one."""
    return "<u2" if load(path)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def take_runs(values: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs ``values[start[i] : start[i] + length[i]]`` for i in ``order``, joined."""
    n = length[order]
    ends = np.cumsum(n)
    if not len(n) or not ends[-1]:
        return values[:0]
    at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[order], n)
    return values[at]


def _assemble(path: str, schema: pa.Schema, wanted):
    def run(sequences: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        width = np.dtype(id_type(path))
        sizes, values = [], []
        for n, packed in zip(words.column("n").to_pylist(), words.column("ids"), strict=True):
            data = _loose(packed.as_py())
            sizes.append(np.frombuffer(data, "<u4", n) // width.itemsize)
            values.append(np.frombuffer(data, width, offset=4 * n))
        bucket = next((b for b in sequences.column("bucket").to_pylist() if b is not None), None)
        if bucket is None:
            raise RuntimeError("a block was read in two ways")
        of = np.frombuffer(_loose(bucket), "<u4")
        if sum(map(len, sizes)) != len(of):
            raise RuntimeError(f"a block has {sum(map(len, sizes))} of {len(of)} words")
        # the table gives a block's words by bucket, then slot
        order = np.argsort(of, kind="stable")
        length, start = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        if len(of):
            length[order] = np.concatenate(sizes)
            ends = np.cumsum(length[order])
            start[order] = ends - length[order]
        flat = np.concatenate([np.array([], width), *values]).astype("<u4")
        pieces, done = PieceTable(path), []
        for batch in sequences.select(["doc_ids", "lengths", "packed"]).to_batches(max_chunksize=1):
            for row in batch.to_pylist():
                seq, at, out = _from_planes(row["packed"]), 0, []
                for doc, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    out.append((doc, *wanted(take_runs(flat, start, length, seq[at : at + n]), pieces)))
                    at += n
                done.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema))
        return pa.Table.from_batches(done, schema=schema)

    return run


class PieceTable:
    """Id to piece: all pieces of the vocabulary in one run of bytes. Without a decoder, pieces are joined by a space."""

    def __init__(self, path: str):
        self.flat, self.start, self.length = _pieces(path)

    def decode(self, ids: np.ndarray) -> bytes:
        return take_runs(self.flat, self.start, self.length, ids)[:-1].tobytes()


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tok, _ = load(path)
    if tok.decoder is not None:
        raise ValueError("only vocabularies without a decoder decode piece by piece")
    names = [((tok.id_to_token(i) or "") + " ").encode() for i in range(tok.get_vocab_size(with_added_tokens=True))]
    length = np.array([len(x) for x in names])
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(length) - length, length


def tokens(
    docs: DataFrame, wanted, columns: str, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, block: int = BLOCK,
    buckets: int | None = None, part: int = PART,
) -> DataFrame:
    """(doc_id, what ``wanted`` makes of a document's ids and the piece table) of every row.

    ``wanted(ids, pieces)`` gives the values of ``columns``, a DDL list.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    path = vocabulary or tokenizer_path(VOCABULARY)
    rows = pick(docs, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark: SparkSession = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part))
    buckets = buckets or 4 * parts
    sequences = rows.mapInArrow(
        _sequences(path, block, buckets), "block string, bucket binary, doc_ids array<long>, lengths array<long>, packed binary"
    )
    words = rows.mapInArrow(_words(path, block, buckets), "bucket int, block string, words binary")
    placed = words.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_encode_bucket(path), "block string, bucket int, n long, ids binary")
    out = "doc_id long, " + columns
    run = _assemble(path, to_arrow_schema(StructType.fromDDL(out)), wanted)
    by_block = lambda df: df.repartition(parts, "block").groupBy("block")
    return by_block(sequences).cogroup(by_block(placed)).applyInArrow(run, out)


def _digests(ids: np.ndarray, pieces: PieceTable) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids)).hexdigest()


def encode_decode(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids themselves and the text they decode to."""
    return tokens(docs, lambda ids, pieces: (ids.astype(np.int32), pieces.decode(ids).decode()), "ids array<int>, decoded string", **options)


def distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return tokens(docs, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op9_distinct_words": distinct_words}

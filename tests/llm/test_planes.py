"""Plane files against the tokenizers library, by exact round trips."""

import io
import zlib

import numpy as np
import pytest
from test_tokens import TEXTS, library

from wayline.llm import bit_planes as planes


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_transposed_chunks_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (planes.from_planes(planes.to_planes(ids, kind), n, kind) == ids).all()
    docs = [rng.integers(0, 70_000, n).astype("<u4") for n in (3, 0, 500, 1, 64, 64, 2000, 0)]
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, kind, chunk=64)
    for i, ids in enumerate(docs):
        writer.add(ids, None if i == 3 else i - 2)
    writer.finish()
    reader = planes.PlaneReader(io.BytesIO(out.getvalue()))
    assert reader.keys == [-2, -1, 0, None, 2, 3, 4, 5]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(docs, reader.documents(), strict=True))
    flat = np.concatenate(docs)
    for start, stop in ((0, 0), (0, 1), (63, 65), (64, 128), (100, 900), (len(flat) - 1, len(flat)), (5, 10**9)):
        assert (reader.ids(start, stop) == flat[start:stop]).all()
    assert max(reader.chunks[:, 1]) == 64


def test_a_range_reads_only_its_chunks_and_damage_is_seen():
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, chunk=100)
    writer.add(np.arange(1000, dtype="<u4"), 1)
    writer.finish()
    data = bytearray(out.getvalue())
    reader = planes.PlaneReader(io.BytesIO(bytes(data)))
    read = []
    reader.read_chunk = lambda i: read.append(i) or planes.PlaneReader.read_chunk(reader, i)
    assert reader.ids(250, 410).tolist() == list(range(250, 410)) and read == [2, 3, 4]
    data[int(reader.chunks[3][0])] ^= 255
    damaged = planes.PlaneReader(io.BytesIO(bytes(data)))
    assert damaged.ids(0, 300).tolist() == list(range(300))
    with pytest.raises(ValueError):
        damaged.ids(300, 301)
    with pytest.raises(Exception):
        planes.PlaneReader(io.BytesIO(b"something else entirely, long enough"))


@pytest.mark.parametrize("kind,chunk", [("byte", 1 << 16), ("bit", 100)])
def test_files_hold_all_documents_in_order(spark, frame, tmp_path, kind, chunk):
    tok = library("word_bpe_49k.json")
    docs = [*enumerate(TEXTS, -3), (None, "no id"), (3, "another text of this id"), (5, TEXTS[8]), (10**12, "far")]
    folder = str(tmp_path / "set")
    manifest = planes.write(frame(docs), folder, planes=kind, chunk=chunk)
    rows = planes.read_documents(spark, folder).collect()
    assert len(rows) == len(docs)
    order = sorted(rows, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in order]
    assert keys[0] is None and keys[1:] == sorted(k for k, _ in docs if k is not None)
    want = sorted((str(k), tok.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in docs)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in order) == want
    at = 0
    for r in order:
        assert r["start"] == at
        at += len(r["ids"])
    assert manifest.agg({"n_ids": "sum", "n_docs": "sum"}).first()[:] in ((at, len(docs)), (len(docs), at))
    flat = [i for r in order for i in r["ids"]]
    ranges = spark.createDataFrame([(1, 0, 5), (2, 40, at), (3, at - 1, at + 50), (4, 7, 7)], "range_id long, start long, stop long")
    got: dict = {}
    for r in planes.read_ranges(spark, folder, ranges).collect():
        got.setdefault(r["range_id"], []).append((r["start"], r["ids"]))
    joined = {k: [i for _, ids in sorted(v) for i in ids] for k, v in got.items()}
    assert joined[1] == flat[:5] and joined[2] == flat[40:] and joined[3] == flat[-1:] and not joined.get(4)


def test_query_digests_and_the_empty_table(spark, frame, tmp_path):
    tok = library("word_bpe_49k.json")
    docs = frame([(2, "b b"), (1, None), (7, "word " * 2000)])
    planes.write(docs, str(tmp_path / "a"))
    rows = planes.read_documents(spark, str(tmp_path / "a"), "n long, crc long", lambda ids: (len(ids), zlib.crc32(ids.tobytes()))).collect()
    for r, text in zip(sorted(rows, key=lambda r: r["doc_id"]), ("", "b b", "word " * 2000), strict=True):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r["n"], r["crc"]) == (len(ids), zlib.crc32(ids.tobytes()))
    planes.write(docs.where("false"), str(tmp_path / "none"))
    assert planes.read_documents(spark, str(tmp_path / "none")).count() == 0

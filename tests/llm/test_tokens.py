"""Distinct-word encoding and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

from wayline.llm import distinct_words, packing
from wayline.llm.frames import tokenizer_path

TEXTS = [
    None, "", " ", "Hello, WORLD's 123 ñé", "x<|endoftext|>y <|startoftext|>", "don't  stop\n\n\tnow   ", "ΣΟΦΟΣ İstanbul ǅ", "日本語 テキスト 漢字", "é ﬁ ½ ² ª",
    "a b c\x1cd", "🙂🙂 emoji 👍🏽", "''s 'll!! 'S 'RE", "___ --- +++ a_b", "\x00\x01\x7f", "Ωmega ÷ × Ÿ", "word " * 3000, "a" * 5000,
]


def library(name):
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_ids_and_decoding(spark, frame):
    tok = library("word_bpe_49k.json")
    docs = frame([*enumerate(TEXTS), (3, TEXTS[3]), (None, "abc")])
    rows = distinct_words.encode_decode(docs, block=2_000, buckets=7).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "abc" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids, repr(text)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    digest = distinct_words.tokens(docs, distinct_words._digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", block=500).collect()
    want = {i: hashlib.sha256(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in enumerate(TEXTS)}
    assert all(r["ids_sha256"] == want[r["doc_id"]] for r in digest if r["doc_id"] is not None)
    assert distinct_words.encode_decode(docs.where("false")).count() == 0


def test_partitions_grow_with_the_texts(spark, frame):
    docs = frame([(i, f"word{i} and others " * 40) for i in range(60)])
    small, large = (distinct_words.encode_decode(docs, block=1_000, part=p) for p in (10**9, 2_000))
    size = sum(len(f"word{i} and others " * 40) for i in range(60))
    assert small.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions")) < -(-size // 2_000)
    # both sides of the assembly keep the one dealing they are given
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"hashpartitioning(block#") == 2 and plan.count(f", {-(-size // 2_000)}), REPARTITION_BY_NUM") == 3
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def check_packing(rows, docs):
    tok = library("byte_bpe_50k.json")
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for key, text in docs.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        parts, at = sorted(by_doc[key], key=lambda r: r["piece"]), 0
        for i, r in enumerate(parts):
            assert r["piece"] == i and r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert i == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(parts) == 1)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_packing(spark, frame):
    docs = {i: t for i, t in enumerate([*TEXTS, *(("some words " * n) for n in range(1, 200))])}
    rows = packing.pack_documents(frame(list(docs.items()))).collect()
    bins = check_packing(rows, docs)
    total = sum(r["length"] for r in rows)
    assert bins <= -(-total // 1024) * 1.05 + 1
    assert packing.pack_documents(frame([(1, "a")]).where("false")).count() == 0


def test_equal_rows_get_their_own_places(spark, frame):
    rows = packing.pack_documents(frame([(7, "same text")] * 9)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 9


def test_capacities():
    runs = packing.best_fit({5: 10, 3: 7, 1: 4}, tokens=10, documents=3, cost=60)
    bins: dict = {}
    for length, rank, n, first, offset in runs:
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
    assert sum(len(b) for b in bins.values()) == 21
    for b in bins.values():
        assert sum(x for _, x in b) <= 10 and len(b) <= 3 and sum(x * x for _, x in b) <= 60
        assert sorted(o for o, _ in b) == [sum(x for o2, x in b if o2 < o) for o, _ in sorted(b)]
    for length in (5, 3, 1):
        ranks = sorted(r + k for x, r, n, _, _ in runs if x == length for k in range(n))
        assert ranks == list(range(len(ranks)))

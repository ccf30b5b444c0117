"""Language masks, nearest neighbours and quality rules."""

import re
import zlib

import numpy as np
import pytest

from wayline.llm import compression, langmask, neighbours

EN = "the house and the garden were green when they went there with the others "
DE = "das haus und der garten waren gruen als sie mit den anderen dorthin gingen "


def test_languages_are_told_apart(spark, frame):
    labelled = frame([(i, (EN if i % 2 else DE) * 5, "en" if i % 2 else "de") for i in range(40)])
    masks = langmask.fit(labelled)
    docs = frame([(1, EN), (2, DE), (3, None), (4, ""), (5, "123 !? 45"), (None, EN), (1, EN), (6, DE * 40_000)])
    got = sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6) > 0) for r in langmask.identify(docs, masks).collect())
    assert got == [
        (-1, "en", True), (1, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "de", True),
    ]
    kept = langmask.keep_known(docs, masks)
    assert kept.columns == docs.columns and kept.count() == 5


def test_no_labels_no_rows(spark, frame):
    nothing = langmask.fit(frame([(1, EN)]))
    assert [r["lang_pred"] for r in langmask.identify(frame([(1, EN)]), nothing).collect()] == ["und"]
    assert langmask.identify(frame([]).where("false"), nothing).count() == 0


def test_pieces_count_like_one_text():
    masks = langmask.LanguageMasks.build({"en": np.unique(np.concatenate([h for _, h in langmask.grams([EN])])).view(np.int64)})
    n, hits = masks.counts([EN * 30_000, EN])
    assert abs(n[0] / (30_000 * n[1]) - 1) < 0.02 and (hits <= n[:, None]).all() and hits[1, 0] == n[1]


def test_held_out_accuracy(spark):
    from wayline.llm import QUERIES

    folder = "/root/testdata/sf0.01"
    found = QUERIES["op8_language_masks"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rows = found.select("doc_id", "held_out", "lang", "lang_pred").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def brute(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            far = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in vectors.items() if i != q)
            out[q] = [i for _, i in far[:k]]
    return out


def test_nearest_recall(spark):
    from wayline.llm import QUERIES

    folder = "/root/testdata/sf0.01"
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = brute(vectors, 10)
    got: dict = {}
    for r in QUERIES["op7_nearest_vectors"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(np.sqrt(((vectors[r["vec_id"]] - vectors[r["query_id"]]) ** 2).sum())))
    hits = sum(len(set(got[q]) & set(ids)) for q, ids in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [nan, 1.0], "a"),
        (6, [1.0, None], "a"), (7, [0.0, 3.0], "a"), (8, [1.0], "a"), (None, [1.0, 1.0], "a"), (100, [0.0, 0.0], "a"),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    assert neighbours.nearest(vectors.where("false"), vectors).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def test_quality_counts(spark, frame):
    texts = [
        None, "", " \n\t", "a b c d e f g h i a b c d e f g h", "x\nx\n x\n\n\nx", "é#ü *|\x0b z\x1fq r", ("one two three four five six seven eight nine " * 5) + "end",
        "word " * 30, " ".join("abcdefghij"), EN * 3 + DE * 2,
    ]
    rows = {r["doc_id"]: r for r in compression.quality(frame(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(text), text
        assert not (r["base_failed"] and r["kept"])


def test_compression_bands(spark, frame):
    rng = np.random.default_rng(3)
    # words of many letters without repeats pass; one phrase over and over, or noise, does not
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9), p=np.array([13, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3]) / 81)) for _ in range(900))
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 6)) for _ in range(400))
    near = " ".join(f"item {i} of the list" for i in range(900))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in compression.quality(frame([(1, prose), (2, noise), (3, near)])).collect()}
    assert got[1] == (False, True) and got[2] == (False, False) and got[3] == (False, False)


def test_chunks_reach_the_end():
    import zstandard

    packer, rng = zstandard.ZstdCompressor(level=compression.LEVEL), np.random.default_rng(3)
    prose = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 2 * compression.CHUNK))
    for size, want in ((1500, (1, 0)), (2048, (1, 0)), (4096, (2, 0)), (2049, (2, 0)), (4095, (2, 0))):
        assert compression.compression_verdict(prose[:size], packer)[2:] == want
    assert compression.compression_verdict(prose[:2048] + b"again and " * 190, packer)[2:] == (2, 1)
    assert compression.compression_verdict(b"again and " * 50, packer)[::2] == (False, 1)
    for size in (1, 20, 60, 99):  # every length has a band
        assert compression.compression_verdict(prose[:size], packer)[::2] == (True, 1)
    assert compression.compression_verdict(b"a " * 40, packer)[2:] == (1, 1)
    assert compression.compression_verdict(b"", packer) == (True, None, 0, 0)
    # one chunk of prose, one and a half of noise, so most of the chunks are bad
    noise = rng.integers(0, 256, compression.CHUNK + 900, dtype=np.uint8).tobytes()
    assert compression.compression_verdict(prose[:2048] + noise, packer)[2:] == (3, 2)


def test_more_languages_than_one_mask_holds(spark, frame):
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĸĺļľŀłńņňŉŋ"
    assert len(letters) > 70
    docs = [(i * 3 + k, f"{c}{c}{letters[(i + 1) % 26]} {c}{letters[i % 7]}{c} " * 30, f"l{i:03d}") for i, c in enumerate(letters) for k in range(3)]
    masks = langmask.fit(frame(docs))
    assert len(masks.languages) == len(letters) > langmask.MASK and len(masks.masks) == 2
    got = {r["doc_id"]: r["lang_pred"] for r in langmask.identify(frame(docs), masks).collect()}
    assert sum(got[i] == lang for i, _, lang in docs) >= 0.95 * len(docs)

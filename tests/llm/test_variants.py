"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayline.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def made_words(seed, size):
    rng = random.Random(seed)
    base = ["".join(rng.choice("eaéßst") for _ in range(rng.randint(7, 10))) for _ in range(size // 4)]
    out = set(base)
    while len(out) < size:
        w = rng.choice(base)
        i = rng.randrange(len(w))
        out.add(rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("eaéxz") + w[i + 1 :], w[:i] + rng.choice("eaéx") + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :])))
    return sorted(out), rng


@pytest.mark.parametrize("shard,block", [(20_000, 50_000), (15, 20), (4, 7)])
def test_all_pairs_and_forms(spark, shard, block):
    words, rng = made_words(shard, 300)
    n = {w: rng.choice((2, 3, 20, 25, 300, 4000, 50_000)) for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    pairs = [tuple(sorted((r["word"], r["near"]))) for r in variants.near_words(frame, shard=shard, block=block).collect()]
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    around = {w: [b if a == w else a for a, b in want if w in (a, b)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    got = variants.forms(frame, shard=shard, block=block).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == {
        (w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in words
    }
    assert len(got) == len(words) and any(form[w] and form[form[w]] for w in words)


def test_one_apart_on_odd_words():
    words = ["", "a", "b", "ab", "ba", "aa", "aaa", "abc", "acb", "a" * 500, "a" * 499 + "b", "éa", "eé", "日本", "日"]
    pairs = [(a, b) for a in words for b in words]
    got = variants.one_apart(np.array([a for a, _ in pairs], object), np.array([b for _, b in pairs], object))
    assert got.tolist() == [near(a, b) for a, b in pairs]


def test_counts_of_whole_texts(spark, frame):
    rng = random.Random(3)
    base = ["Éclairage", "straße", "lighthouse", "LIGHTHOUSE", "abcdefgé", "short", "x÷y×zéèê", "naïveté's"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(("", ",", "9", "—", "日本")) for _ in range(40))) for i in range(60)]
    docs += [(None, "lighthouse lighthouse"), (7, None), (8, ""), (9, "lighthouse\n" * 5000), (10, "Z" * 50_000), (10, "Z" * 50_000)]
    want: Counter = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if code % 31 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                want[run] += 1
    want = {w: c for w, c in want.items() if c >= 2}
    assert {r["word"]: r["n"] for r in variants.count_words(frame(docs)).collect()} == want
    assert any(len(w) == 49_999 or len(w) == 50_000 for w in want)
    empty = variants.count_words(frame(docs).where("false"))
    assert variants.forms(empty).count() == 0

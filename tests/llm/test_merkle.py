"""Merkle manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wayline.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, at, arity):
    for nodes in levels[:-1]:
        start = at - at % arity
        yield "".join(nodes[start:at]), "".join(nodes[at + 1 : start + arity])
        at //= arity


def plain(groups, arity):
    """{(group, idx): (subroot, root, steps)} of groups {name: leaves in order}."""
    trees = {g: climb(leaves, arity) for g, leaves in groups.items()}
    names = sorted(trees)
    top = climb([trees[g][-1][0] for g in names], arity)
    return {
        (g, i): (trees[g][-1][0], top[-1][0], [*steps(trees[g], i, arity), *steps(top, names.index(g), arity)])
        for g in names for i in range(len(groups[g]))
    }


@pytest.mark.parametrize("arity,every", [(8, 2), (2, 3), (3, 1)])
def test_every_proof_equals_the_plain_tree(spark, arity, every):
    sizes = {"": 1, "=a": 2, "=b": 8, "=c": 9, "=d": 65, "=e": 150, "=ß": 64, **{f"=x{i:02d}": 1 + i % 3 for i in range(20)}}
    rows = [(g, i, h(g, str(i)), f"p{i}") for g, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "grp string, k long, digest string, more string").repartition(5)
    manifest = merkle.build(frame, ["k"], arity=arity, every=every)
    want = plain({g: [h(g, str(i)) for i in range(n)] for g, n in sizes.items()}, arity)
    got = merkle.proofs(manifest).withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    assert len(got) == len(want)
    for r in got:
        subroot, root, path = want[r["grp"], r["idx"]]
        assert (r["subroot"], r["root"], [tuple(s) for s in r["path"]]) == (subroot, root, path)
        assert r["folded"] == root and r["k"] == r["idx"] and r["more"] == f"p{r['k']}"
    assert manifest.root().collect()[0][0] == root
    # only every few levels is stored
    assert len(manifest.levels) == 1 + -(-(len(climb(["x"] * 150, arity)) - 1) // every)
    wanted = spark.createDataFrame([("=e", 0), ("=e", 149), ("=d", 64), ("", 0), ("=nowhere", 0)], "grp string, idx long")
    some = merkle.proofs(manifest, wanted).collect()
    assert {(r["grp"], r["idx"]): [tuple(s) for s in r["path"]] for r in some} == {k: want[k][2] for k in (("=e", 0), ("=e", 149), ("=d", 64), ("", 0))}


def test_documents_odd_rows_and_tampering(spark, frame):
    rows = [
        (3, "Some Text", "en", "s", 9), (1, None, None, None, None), (2, "", "", "", 0), (None, "X", "en", "s", 1), (5, "lower", "en", "s", 5),
        (3, "Some Text", "en", "s", 9), (3, "Another", "en", "s", 7), (-4, "É Ä x", "fr", "q", 5), (2**40, "Z" * 100_000, "en", "s", 1),
        *((i, f"Text {i}", "de", "web", 6) for i in range(10, 90)),
    ]
    folder = frame(rows)
    leaves = merkle.document_leaves(folder)
    got = merkle.proofs(merkle.build(leaves, ["doc_id"])).collect()
    groups: dict = {}
    for doc, text, lang, source, n in rows:
        made = h(*map(text_of, (doc, source, lang, n, text)))
        groups.setdefault("" if lang is None else "=" + lang, []).append((doc is not None, doc or 0, made))
    groups = {g: [x[2] for x in sorted(v)] for g, v in groups.items()}
    want = plain(groups, 8)
    assert sorted((r["grp"], r["idx"], r["digest"]) for r in got) == sorted((g, i, d) for g, v in groups.items() for i, d in enumerate(v))
    for r in got:
        assert (r["subroot"], r["root"]) == want[r["grp"], r["idx"]][:2]
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        assert (r["tampered"] is not None) == hit
    for doc, text, lang, source, n in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = {r["tampered"] for r in got if r["doc_id"] == doc and r["digest"] == h(*map(text_of, (doc, source, lang, n, text)))}
        assert tampered <= {None, h(*map(text_of, (doc, source, lang, n, low)))}
    assert merkle.proofs(merkle.build(leaves.where("false"), ["doc_id"])).count() == 0
    one = merkle.proofs(merkle.build(leaves.where("doc_id = 5"), ["doc_id"])).collect()
    assert one[0]["path"] == [] and one[0]["root"] == one[0]["digest"]

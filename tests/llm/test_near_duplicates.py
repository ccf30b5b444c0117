"""SetSketch near-duplicates, components, the pipeline and the SQL twins."""

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from wayline.llm import ORACLES, QUERIES, graph, setsketch

SMALL = "/root/testdata/sf0.001"


def plain_sets(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_components(sets):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if one and sets[j] and 100 * common >= 75 * (len(one) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(sets))]


def documents():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    texts = [None, "", " ", "one two three", "ONE two three", "one two three four", "a b c d e", "É a b c d"]
    base = rng.choices(words, k=120)
    for edits in [0, 1, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5] * 4:
        copy = list(base)
        for at in rng.sample(range(len(copy)), edits):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(6):  # a chain: each one close to the one before
        for at in rng.sample(range(len(base)), 2):
            base[at] = rng.choice(words)
        texts.append(" ".join(base))
    passage = rng.choices(words, k=40)
    texts += [" ".join(rng.choices(words, k=25) + passage) for _ in range(20)]
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(40)] + texts[10:14]
    return texts


def test_components_of_near_duplicates(spark, frame):
    texts = documents()
    sets = plain_sets(texts)
    want = plain_components(sets)
    rows = setsketch.near_duplicates(frame([*enumerate(texts), (None, "x y z")])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1 and got[None]["kept"] and got[None]["component_id"] is None
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), i


def test_links_inside_large_families(spark, frame):
    """Passages in hundreds of longer documents, and in pairs of short ones that meet longer strangers only."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    some = lambda low, high: rng.choices(words, k=rng.randint(low, high))
    passages = [rng.choices(words, k=60) for _ in range(20)]
    texts = [" ".join(some(12, 60) + p + some(12, 60)) for p in passages for _ in range(30)]
    texts += [" ".join(some(3, 4) + p + some(3, 4)) for p in passages for _ in range(2)]
    want = plain_components(plain_sets(texts))
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(frame(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x != i for i, x in enumerate(want)) >= len(passages)


def test_pairs_with_different_nearest_leaders(spark):
    """Documents 10 and 11 are near; each is nearest to a leader that the other has not met."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passage = some(60)
    texts = {k: f"{some(30)} {passage} {some(30)}" for k in range(3)} | {k: f"{some(4)} {passage} {some(4)}" for k in (10, 11)}
    packed = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "doc_id long, text binary")
    packed = setsketch.map_columns(packed, setsketch._press, "doc_id long, packed binary")
    met = [(0, 10, 10, False), (0, 11, 11, False), (1, 10, 10, True), (2, 11, 11, True)]
    families = spark.createDataFrame(met, "a long, b long, component long, nearest boolean")
    assert [tuple(r) for r in setsketch._beside_leader(families, packed).collect()] == [(10, 11)]


def test_pairs_inside_the_leader(spark, monkeypatch):
    """The same pairs as all pairs of a family, with families cut into slices, and none of its largest component."""
    monkeypatch.setattr(setsketch, "SLICE", 7)
    rng = random.Random(5)
    rows, b = [], 0
    for a, kinds in ((1, [1]), (2, [1] * 12 + [2, 3, 4]), (3, [5, 6, 7]), (4, [8, 8, 9, 9, 9, 8])):
        for _ in range(40):
            n = rng.randint(40, 60)
            rows.append((a, b, rng.choice(kinds), n, rng.randint(n * 7 // 10, n)))
            b += 1
    sizes = spark.createDataFrame(rows, "a long, b long, component long, n long, shared long")
    want = {
        (u[1], m[1]) for u in rows for m in rows
        if u[0] == m[0] and u[1] < m[1] and u[2] != m[2] and 175 * min(u[4], m[4]) >= 75 * (u[3] + m[3])
    }
    got = [tuple(r) for r in setsketch._inside_leader(sizes).collect()]
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_empty_table(spark, frame):
    assert setsketch.near_duplicates(frame([(1, "a")]).where("false")).count() == 0


def test_estimates():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.75, 0.9):
        both = rng.integers(0, 1 << 63, int(1000 * share)).astype(np.uint64)
        one, two = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (1000 - len(both)) // 2).astype(np.uint64)])) for _ in range(2))
        a, b = (setsketch.registers(x)[None, :] for x in (one, two))
        assert setsketch.likely_similarity(a, b, np.array([len(one)]), np.array([len(two)]))[0] == pytest.approx(share, abs=0.12)


def test_registers_merge():
    rng = np.random.default_rng(8)
    one, two = (rng.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(2))
    merged = np.maximum(setsketch.registers(one), setsketch.registers(two))
    assert (merged == setsketch.registers(np.concatenate([one, two]))).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    tidy = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
    assert tidy(got) == tidy(want)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(3).selectExpr("cast(null as long) doc_id", "text", "lang", "cast(null as string) source", "n_chars").unionByName(
        docs.limit(2).selectExpr("doc_id + 100000 doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "cast(null as long) n_chars")
    )
    docs = docs.unionByName(odd)
    before = {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(out)
        after = spark.read.parquet(out)
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= before
        if k < 4:
            assert after.columns == docs.columns
        if name == "language_id":
            assert before - ids == {r["doc_id"] for r in docs.where("text is null").collect()}
        elif name == "near_dedup":
            rows = sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect())
            want = plain_components(plain_sets([t for _, t in rows]))
            assert ids - {None} == {rows[i][0] for i, x in enumerate(want) if x == i}
        else:
            assert ids == before
        docs, before = after, ids
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_each_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_different_texts_that_share_an_id_are_different_documents(spark, frame):
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join(reversed(words))
    rows = [(5, one), (5, two), (5, one), (7, one + " more"), (None, two), (None, "quite another text of seven words"), (None, None), (9, "")]
    out = corpus_pipeline.near_dedup(spark, frame(rows), SMALL).collect()
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out)
    assert got == sorted([("5", one), ("5", two), ("None", "quite another text of seven words"), ("None", "None"), ("9", "")])

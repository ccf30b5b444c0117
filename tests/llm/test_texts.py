"""Line frequency, personal data, license scans and suffix levels against plain loops."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayline.llm import licenses, line_frequency, personal_data, suffix_index

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def fine(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if fine(kind, m.group())]


def test_base_spans(spark, frame):
    rng = random.Random(5)
    bits = ["a@b.c", "x@y", ".", "@", "a.b-c@d.e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (222) 555-0100", "+12", " ", "é", "\n", "0", "12", "+", "-", "(at)", "\x01", "\x02", "😀"]
    texts = [None, "", "no digits", "x@a.b_c@d.ef", "4012888888881881", "b" * 3000 + "@" + "c.d", "1" * 3000] + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(400)]
    docs = frame(list(enumerate(texts)))
    found = personal_data.find(docs, personal_data.BoostedTrees()).collect()
    for r in found:
        want = plain_spans(texts[r["doc_id"]])
        assert [tuple(x) for x in r["base"]] == want, repr(texts[r["doc_id"]])
        assert r["spans"] == r["base"]


def seeded(n):
    """Documents with a base span of every kind in each."""
    cards = [f"4{i:014d}" for i in range(n)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    return [(i, f"call us +1 ({200 + i}) 555-{1000 + i} or write to n{i}.x@mail.example.com now, card {cards[i]} at 10.{i}.7.{i + 3} end") for i in range(n)]


ADDED = [
    ("email", "write jo.doe (at) mail (dot) example (dot) com now", "jo.doe (at) mail (dot) example (dot) com"),
    ("email", "reach me[at]site[dot]org", "me[at]site[dot]org"),
    ("ip", "host 2001:db8:1a2b:33cc:44dd:55ee:66ff:7788 up", "2001:db8:1a2b:33cc:44dd:55ee:66ff:7788"),
    ("ip", "é addr fe80:12ab::9f3c:01de ok", "fe80:12ab::9f3c:01de"),
    ("card", "card 4111.1111.1111.1111 please", "4111.1111.1111.1111"),
    ("card", "pay 4012/8888/8888/1881 now", "4012/8888/8888/1881"),
    ("phone", "call (212) 555-0142 today", "(212) 555-0142"),
    ("phone", "phone 212-555-0142", "212-555-0142"),
]
ALIKE = [
    "order no. 2125550142", "invoice 212-555-0142", "on 2021-03-04 we", "at 12:30:45:10 it", "#4111.1111.1111.1112", "costs 100 @ 20.50 each",
    "id 99887-77665", "pages 12 13 14 15 16", "card 4111/1111/1111/1112", "order 55 of 12", "no digits",
]


def test_added_spans_and_redaction(spark, frame):
    good = seeded(120)
    planted = [(500 + i, t) for i, (_, t, _) in enumerate(ADDED)]
    alike = [(700 + i, t) for i, t in enumerate(ALIKE)]
    docs = frame([*good, *planted, *alike, (901, None), (902, "")])
    model = personal_data.fit(docs)
    assert sorted(model.thresholds) == [0, 1, 2, 3]
    rows = {r["doc_id"]: r for r in personal_data.find(docs, model).collect()}
    for i, text in good:
        spans = [tuple(x) for x in rows[i]["spans"]]
        assert set(plain_spans(text)) <= set(spans) and spans == sorted(spans)
    for (i, text), (kind, _, span) in zip(planted, ADDED, strict=True):
        assert rows[i]["base"] == [] and [(personal_data.KINDS[x["k"]], text[x["s"] : x["e"]]) for x in rows[i]["spans"]] == [(kind, span)]
    for i, text in [*alike, (901, None), (902, "")]:
        assert rows[i]["spans"] == [], text
    named = docs.withColumnRenamed("score", "_spans")
    assert personal_data.redact(named, model).columns == named.columns
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(named, model).collect()}
    assert clean[3] == "call us [PHONE] or write to [EMAIL] now, card [CARD] at [IP] end" and clean[901] is None
    assert clean[500] == "write [EMAIL] now" and clean[506] == "call [PHONE] today" and clean[700] == ALIKE[0]
    assert personal_data.find(docs.where("false"), model).count() == 0
    assert personal_data.fit(docs.where("false")).thresholds == {}
    assert personal_data.fit(frame([(1, None), (2, "a@b.cd")])).thresholds == {}


def test_labels_are_bounded(frame):
    few = personal_data.labelled(frame(seeded(60)), bound=5)
    assert 0 < few.count() < personal_data.labelled(frame(seeded(60))).count()
    assert few.count() == personal_data.labelled(frame(seeded(60)), bound=5).count()


def test_long_lists_of_matches(spark):
    for n in (1, 63, 64, 65, 127, 128, 129, 20_000):
        text = "é " + "1.2.3.4 ü " * n
        row = spark.createDataFrame([(text,)], "t string").select(personal_data.matches(F.col("t"), personal_data.BASE["ip"], personal_data.HINTS["ip"])).first()
        assert [(x["s"], x["e"], x["t"]) for x in row[0]] == [(2 + 10 * i, 9 + 10 * i, "1.2.3.4") for i in range(n)]


def test_trees_as_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (200, 1 + len(personal_data.GRID)))
    good = np.where(x[:, 3] > 1, 30.0, 1.0)
    model = personal_data.BoostedTrees.fit(x, good, 31 - good)
    model.calibrate(x, x[:, 0], good, 31 - good, 0.9)
    assert model.thresholds
    names = ["g", *personal_data.GRID]
    rows = spark.createDataFrame([tuple(int(v) for v in r) for r in x], ", ".join(f"{n} int" for n in names)).select(F.struct(*names).alias("c"))
    scored = [r[0] for r in rows.select(model.column(F.col("c"))).collect()]
    assert np.allclose(sorted(scored), sorted(model.score(x)))


def test_line_frequency(spark):
    rng = random.Random(1)
    hosts = ["a"] * 60 + ["b"] * 30 + ["c"] * 5 + [None] * 4
    rows = []
    for i, host in enumerate(hosts):
        lines = [rng.choice(["menu", " menu\t", "footer", f"own {i}", "", "  ", f"pair {i // 2}", "üç"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, host, "\n".join(lines) if i % 17 else None, "clash"))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _bad string")
    bare = lambda x: x.strip(" \t\r\f\x0b")
    pages = Counter(h for _, h, _, _ in rows)
    held = Counter((h, x) for _, h, t, _ in rows if t is not None for x in {bare(y) for y in t.split("\n")} if x)
    bad = {k for k, n in held.items() if k[0] and n >= 3 and n > 0.1 * pages[k[0]]}
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, bare(x)) not in bad)) for i, h, t, _ in rows)
    got = line_frequency.drop_lines(docs, counts=("n", "gone"))
    assert got.columns == [*docs.columns, "n", "gone"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_frequency.drop_lines(docs.where("false")).count() == 0
    assert bad


def plain_licenses(text):
    """Unbanded alignment of every template with the whole text."""
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    words = [w for w in licenses.words_of(text.encode()) if w]
    ids = [index.vocabulary.get(w, 0) for w in words]
    best = {}
    for t, name in enumerate(index.names):
        matched, first, end = licenses.align(index.words[t], ids, -10_000, 10_000)
        if matched >= licenses.COVERAGE * len(index.words[t]):
            best[name] = (matched, " ".join(w.decode() for w in words[first:end]))
    return best


def test_license_scan(spark, frame):
    mit = licenses.TEMPLATES["MIT"].split()
    cut = " ".join(w for i, w in enumerate(mit) if i % 11)  # every eleventh word is missing
    texts = [
        None, "", "no notice here", "é ü 😀 " + licenses.TEMPLATES["GPL-3.0-line"] + ". And more words follow.", "Licensed under the Apache License, Version 2.0.\nText",
        "x " * 3000 + cut + " y" * 50, licenses.TEMPLATES["MPL-2.0"].upper(), "This work is licensed to nobody", "lead " + licenses.TEMPLATES["CC-BY-NC-4.0"] + " gap " * 40 + licenses.TEMPLATES["CC-BY-NC-4.0"],
    ]
    rows = licenses.license_spans(frame(list(enumerate(texts)))).collect()
    for i, text in enumerate(texts):
        found = [r for r in rows if r["doc_id"] == i]
        want = plain_licenses(text or "")
        assert bool(found) == bool(want), text
        for r in found:
            assert r["matched"] == want[r["license"]][0]
            span = texts[i][r["start"] : r["end"]]
            assert " ".join(w.decode() for w in licenses.words_of(span.encode()) if w) == want[r["license"]][1] or i == 8
    assert len([r for r in rows if r["doc_id"] == 8]) == 2
    assert licenses.license_spans(frame([(1, "a")]).where("false")).count() == 0


def test_licenses_are_told_apart():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    work = "é, this work is licensed under "
    for text, want in [
        (work + "the GNU Lesser General Public License, version 2.1 only", ["LGPL-2.1-line"]), (work + "the GNU Affero General Public License, version 3.", ["AGPL-3.0-line"]),
        (work + "a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0-long"]), (work + "a Creative Commons Attribution 3.0 Unported License", ["CC-BY-3.0"]),
        ("licensed under CC BY 4.0", ["CC-BY-4.0-short"]), ("licensed under CC BY-ND 4.0", ["CC-BY-ND-4.0-short"]), ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0-line"]),
        (work + "the GNU General Public License, version 9", []), ("licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
    ]:
        assert [x[0] for x in licenses.scan(text.encode(), index)] == want, text


def test_license_near_hits_are_quick():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    begun = time.monotonic()
    assert licenses.scan(b"you may obtain a copy of it now. " * 30_000 + licenses.TEMPLATES["ISC"].encode(), index)[0][0] == "ISC"
    assert len(licenses.scan(b"licensed under CC BY 4.0. " * 5_000, index)) == 5_000
    assert time.monotonic() - begun < 60


def test_adjacent_licenses():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        for n in (1, 2, 3, 5):
            for gap in ("\n", " and ", " x y z w v "):
                text = gap.join([template] * n)
                found = [x for x in licenses.scan(text.encode(), index) if x[0] == name]
                starts = [k * len(template + gap) for k in range(n)]
                assert [x[1] for x in found] == starts and all(x[4] == 1 for x in found), (name, n, gap)


def plain_removal(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone = gone[: len(d)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_levels(spark, frame, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, exact = prose(90), prose(60)
    texts = [None, "", "short", prose(200), prose(200) + passage + prose(30), passage + prose(50), "p" + passage[:399], "q" + passage[:400], exact * 2, "ab" * 700, "z" * 399, "z" * 399, "z" * 400]
    texts += [prose(20) + passage[k : k + 420 + k] + prose(20) for k in range(0, 40, 3)] + [texts[3]] * 3
    want = plain_removal(texts)
    for group, batches in ((512, 5), (2, 2)):
        monkeypatch.setattr(suffix_index, "GROUP", group)
        rows = suffix_index.deduplicate(frame(list(enumerate(texts))), batches=batches, digest=True).collect()
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
        assert [got[i] for i in range(len(texts))] == want
    assert suffix_index.deduplicate(frame([(1, "a")]).where("false")).count() == 0


def test_support_of_a_line_decides_not_the_size_of_its_host(spark):
    rows = []
    for host, pages in (("two", 2), ("three", 3), ("nineteen", 19), ("twenty", 20), ("thirty", 30)):
        rows += [(host, i, "\n".join((["footer"] if i < 3 else []) + (["often"] if i < 4 else []) + [f"own {i}"])) for i in range(pages)]
    docs = spark.createDataFrame(rows, "source string, n long, text string").repartition(3)
    got = {(r["source"], r["n"]): r["text"] for r in line_frequency.drop_lines(docs).collect()}
    for host, i, text in rows:
        lines = text.split("\n")
        pages = sum(r[0] == host for r in rows)
        support = {x: sum(r[0] == host and x in r[2].split("\n") for r in rows) for x in lines}
        assert got[host, i] == "\n".join(x for x in lines if not (support[x] >= 3 and support[x] > 0.1 * pages))
    assert got["nineteen", 0] == "own 0" and got["twenty", 0] == "own 0" and got["two", 0].startswith("footer")
    assert got["thirty", 0] == "footer\nown 0"


def test_suffix_levels_ids_of_any_sign_and_the_text_that_is_left(spark, frame):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh é", k=500))
    docs = [(-1, "x" + passage), (None, passage + "y"), (0, "left alone"), (-(2**62), None)]
    rows = {r["doc_id"]: r for r in suffix_index.deduplicate(frame(docs), digest=True).collect()}
    assert rows.keys() == {-1, None, 0, -(2**62)}
    assert (rows[-1]["kept_text"], rows[None]["kept_text"], rows[0]["kept_text"], rows[-(2**62)]["kept_text"]) == ("x", "y", "left alone", "")


def test_suffix_levels_passages_of_words_shorter_than_a_span(spark, frame):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(n))
    passages = [prose(51), prose(64), prose(200)]
    texts = [None, "", prose(51), passages[0], prose(300), passages[2]]
    texts += [f"{prose(rng.randint(0, 90))} {p}{gap}{prose(rng.randint(0, 90))}" for p in passages for gap in (" ", "\n\t", "  ")]
    own, short = prose(60), prose(31)
    texts += [f"{own} {prose(5)} {own}", f"{short} {prose(40)}", f"{prose(40)} {short}", "x " * 90, "x " * 70 + "y", texts[4]]
    rows = {r["doc_id"]: r for r in suffix_index.deduplicate(frame(list(enumerate(texts))), digest=True).collect()}
    words = [(t or "").split() for t in texts]
    runs = lambda i, n: {tuple(words[i][k : k + n]) for k in range(len(words[i]) - n + 1)}
    for i in range(len(texts)):
        others = set().union(*(runs(k, 32) for k in range(len(texts)) if k != i))
        longer = set().union(*(runs(k, 51) for k in range(len(texts)) if k != i))
        held = np.zeros(len(words[i]), bool)
        for k in range(len(words[i]) - 31):
            held[k : k + 32] |= tuple(words[i][k : k + 32]) in others
        got = rows[i]["n_shared_words"]
        assert got <= held.sum() and (got >= 32 if runs(i, 51) & longer else True), i
    assert all(rows[i]["n_shared_words"] >= 32 and rows[i]["n_removed"] == 0 for i in (3, 6, 7, 8))
    assert [rows[i]["n_shared_words"] for i in (0, 1, 2, 15, 16, 17)] == [0] * 6


def test_runs_of_long_texts_do_not_depend_on_where_they_are_cut(monkeypatch):
    rng = random.Random(2)
    data = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(4000)).encode()
    want = suffix_index.picked_runs(data)
    monkeypatch.setattr(suffix_index, "_STEP", 997)
    got = suffix_index.picked_runs(data)
    assert sorted(zip(*map(np.ndarray.tolist, want))) == sorted(set(zip(*map(np.ndarray.tolist, got)))) and len(want[0]) > 200


def test_short_texts_are_hashed_together(monkeypatch):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(n))
    texts = [prose(rng.choice((0, 3, 50, 51, 52, 130, 400))) + rng.choice(("", " ", "\n\t")) for _ in range(300)]
    texts[7:9] = [texts[5] * 2, prose(20_000)]  # the long one stands alone
    texts = [None, "", "y" * 399, "z" * 400, "z" * 401, " x" * 60, *texts, texts[5], " ", None]
    keys = [None if i % 50 == 9 else i - 20 for i in range(len(texts))]
    columns = [pa.array(keys, pa.int64()), pa.array([t and t.encode() for t in texts], pa.binary())]
    spans, runs = [], []
    for key, text in zip(keys, texts):
        data, key = (text or "").encode(), suffix_index.NO_ID if key is None else key
        first, last, left, seed, whole = (x.tolist() for x in suffix_index.entries(data))
        spans += [(s, w, key, suffix_index._place(a, b, n, suffix_index._tag(data))) for a, b, n, s, w in zip(first, last, left, seed, whole)]
        seen = set()
        for at, run in zip(*(x.tolist() for x in suffix_index.picked_runs(data))):
            runs.append((run, key, (at * 2 + (run not in seen)) * 32768 + suffix_index._tag(data)))
            seen.add(run)
    made, hashed = [], suffix_index.Hashed
    monkeypatch.setattr(suffix_index, "Hashed", lambda data: made.append(len(data)) or hashed(data))
    for rows, want in ((suffix_index._entry_rows, spans), (suffix_index._run_rows, runs)):
        got = [row for part in rows(columns) for row in zip(*(x.tolist() for x in part))]
        assert got == want and len(want) > 500
    assert len(made) < 50  # one for every text and reader before


def test_spans_read_the_entries_of_the_index(spark, frame):
    rows = frame([(i, "ab" * 300 + str(i)) for i in range(4)]).selectExpr("doc_id", "cast(text as binary) text")
    index = suffix_index.SuffixIndex()
    index.add(rows.where("doc_id < 2"))
    index.add(rows.where("doc_id >= 2"))
    index.rows = rows
    spans = suffix_index.removed_spans(index.places, index.covered())
    assert "MapInArrow" not in spans._jdf.queryExecution().toString()  # texts are not hashed again
    assert {r["doc_id"] for r in spans.collect()} == {0, 1, 2, 3}


def test_ranges_and_words_of_a_slice_of_rows():
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())
    texts = [b"", b"abcdefghij", b"0123456789", b"xyz", b"klm"]
    spans = [None, [(6, 8), (1, 3), (2, 4)], [], [(0, 3)], None]
    columns = [
        pa.array([1, None, 3, suffix_index.NO_ID, 5], pa.int64()), pa.array(suffix_index._pack_text([pa.array([1] * 5), pa.array(texts)])[2], pa.binary()),
        pa.array([s and [{"start": a, "end": b} for a, b in s] for s in spans], kinds[0]), pa.array([[4], [40, 0, 10], None, [], [7, 100]], kinds[1]),
    ]
    for start, end in ((0, 5), (1, 4), (2, 3), (0, 0)):
        ids, n, removed, count, _, kept, shared = (list(x) for x in suffix_index._digest([c[start:end] for c in columns]))
        assert ids == [1, None, 3, None, 5][start:end] and n == [0, 10, 10, 3, 3][start:end] and removed == [0, 5, 0, 3, 0][start:end]
        assert count == [0, 2, 0, 1, 0][start:end] and kept == ["", "aefij", "0123456789", "", "klm"][start:end] and shared == [32, 72, 0, 0, 64][start:end]

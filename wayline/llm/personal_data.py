"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Strict patterns give the base spans of four kinds. Generators then propose looser spans that may overlap each
other and the base: addresses with blanks or spelled-out signs, dotted and colon-separated numbers, digit groups. A
candidate is described by its format (length, digits, groups, separators, whether its check holds) and its context
(the signs around it, words before it). Boosted trees score it.

The trees learn from rewritten spans, so that what counts as genuine does not presuppose the base patterns. Up to
``LABELLED`` base spans of each kind, those whose window has the least hash, are taken with the text around them and
written anew in forms the base patterns miss (spelled-out signs, IPv6, cards with dots, phone numbers without plus)
and in forms that look alike but are no personal data (order numbers, versions, dates, failing check digits, octets
above 255); see ``rewritten``. The candidates of these windows are the labelled rows. Half of the windows, by hash, fit
the trees; the other half sets each generator's threshold: the least score from which on the wanted share of candidates
is genuine. In the documents, candidates at or above it that touch no span already chosen are added, the longest first.

Only DataFrame expressions touch the rows; the trees become one CASE expression. The bound on the windows bounds what
reaches the driver.

Results for odd input: null and empty texts have no spans; overlapping candidates of equal length go to the earlier
one; repeated rows each get a row; extra columns are ignored; an empty table gives no rows, and kinds with fewer than
``LEAST_ROWS`` labelled candidates get no added spans. Texts are searched whole, positions count code points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.frames import col, pick, unused

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS = 20
DEPTH = 2
RATE = 0.3
LEAST_ROWS = 20
#: Base spans of each kind that are rewritten into labelled rows.
LABELLED = 2_000
#: Code points of a window on either side of its span.
AROUND = 24
#: Matches whose places are added up at a time.
STEP = 64

#: Base patterns. A run of signs is taken whole and from its start (or from the end of the match before), which
#: is where the leftmost match begins, so that long runs are not searched again from every sign.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs a text must hold for a pattern to match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Generators: (kind of their spans, hint, pattern).
GENERATORS = (
    (
        "email", r"@|[(\[](?:at|AT)[)\]]",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]|\(AT\)|\[AT\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\(DOT\)|\[DOT\]) ?[A-Za-z0-9-]++)++",
    ),
    ("ip", r"[0-9A-Fa-f][.:][0-9A-Fa-f]", r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}+(?:[.:]{1,2}[0-9A-Fa-f]{1,4}+){3,7}+(?![0-9A-Za-z])"),
    ("card", r"[0-9][ .-]?[0-9]", r"(?<![0-9A-Za-z])[0-9](?:[\x20./-]?[0-9]){11,22}+(?![0-9A-Za-z])"),
    ("phone", r"[0-9][ ().-]*[0-9]", r"(?<![0-9A-Za-z+])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}+(?![0-9A-Za-z])"),
)
#: What any span needs; most texts hold nothing of it and are passed over.
ANY = r"[0-9@]|[(\[](?:at|AT)[)\]]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
IPV6 = r"^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,6})$"
DATE = r"^[(]?(?:(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)[0-9]{2})(?![0-9])"
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|account|ip|host|addr|reach)[a-z]*[ :.=-]*$"
DOUBTS = r"(?i)(?:\b(?:order|invoice|version|ver|v|rev|release|build|no|nr|ref|id|isbn|serial|sku|part|item|page|section|line|table|date)s?[ :.=#-]*|#)$"

SPAN = "struct<k:int,s:int,e:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check digit of a string of digits."""
    signs = F.reverse(F.split(digits, ""))
    value = F.transform(signs, lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    return {
        "email": F.lit(True),
        "ip": text.rlike(OCTETS),
        "card": F.length(digits).between(16, 19) & luhn(digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<s, e, t>>: start, end (exclusive) and text of every match, left to right.

    The text must be free of the marks U+0001 and U+0002.
    """
    hit = lambda at, t: F.struct(at.cast("int").alias("s"), (at + F.length(t)).cast("int").alias("e"), t.alias("t"))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(state: Column, part: Column) -> Column:
        here = hit(state["at"], F.substring_index(part, "\x02", 1))
        return F.struct((state["at"] + F.length(part) - 1).cast("int").alias("at"), F.concat(state["hits"], F.array(here)).alias("hits"))

    def walk(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.cast("int").alias("at"), none.alias("hits")), step, lambda state: state["hits"])

    def walk_long(parts: Column) -> Column:
        # arrays grow by copying, so a long list is walked in pieces whose starts are added up first
        pieces = F.transform(F.sequence(F.lit(2), F.size(parts), F.lit(STEP)), lambda i: F.slice(parts, i, F.lit(STEP)))
        width = lambda some: F.aggregate(some, F.lit(0), lambda n, part: n + F.length(part) - 1)
        starts = F.aggregate(pieces, F.array(F.length(parts[0])), lambda ends, some: F.concat(ends, F.array(F.element_at(ends, -1) + width(some))))
        return F.flatten(F.zip_with(pieces, F.slice(starts, 1, F.size(pieces)), walk))

    def walked(parts: Column) -> Column:
        few = walk(F.slice(parts, 2, F.size(parts)), F.length(parts[0]))
        return F.when(F.size(parts) < 2, none).when(F.size(parts) <= STEP, few).otherwise(walk_long(parts))

    # an array of one binds the parts, so that the text is split once
    split = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "\x01", -1)
    return F.when(text.rlike(hint), F.get(F.transform(F.array(split), walked), 0)).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e>> of the checked base spans, by kind, then start."""

    def of_kind(k: int, kind: str) -> Column:
        fine = F.filter(matches(text, BASE[kind], HINTS[kind]), lambda m: _valid(kind, m["t"]))
        return F.transform(fine, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e")))

    found = F.flatten(F.array(*(of_kind(k, kind) for k, kind in enumerate(KINDS))))
    return F.when(text.rlike(ANY), found).otherwise(F.array().cast(f"array<{SPAN}>"))


#: Features with their largest value; each is a small whole number, so their vectors are a bounded grid.
GRID = {
    "length": 8, "digits": 7, "letters": 4, "groups": 6, "dots": 4, "dashes": 3, "blanks": 3, "colons": 2, "slashes": 1, "plus": 1, "sign": 2,
    "valid": 1, "left": 3, "right": 3, "cue": 1, "doubt": 1,
}


def _bucket(x: Column, *bounds: int) -> Column:
    return sum(((x >= b).cast("int") for b in bounds), F.lit(0))


def plausible(kind: str, text: Column) -> Column:
    """Whether the check of a kind holds for a span in a looser form."""
    digits = _digits(text)
    return {
        "email": text.rlike("[.)\\]] ?[A-Za-z]{2,}$"),
        "ip": text.rlike(OCTETS) | text.rlike(IPV6),
        "card": F.length(digits).between(13, 19) & luhn(digits),
        "phone": F.length(digits).between(9, 15) & ~text.rlike(DATE),
    }[kind]


def _features(text: Column, m: Column, kind: str) -> dict[str, Column]:
    t = m["t"]
    before = F.substring(text, F.greatest(F.lit(1), m["s"] - 19), F.least(m["s"], F.lit(20)))
    left = F.substring(text, m["s"], 1)  # 1-based, so this is the sign before the start
    right = F.substring(text, m["e"] + 1, 1)

    def sort(sign: Column, there: Column) -> Column:
        return F.when(~there | (sign == ""), 0).when(sign.rlike("[A-Za-z]"), 1).when(sign.rlike("[0-9]"), 2).otherwise(3)

    count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return {
        "length": _bucket(F.length(t), 6, 8, 11, 14, 16, 19, 24, 32),
        "digits": _bucket(count("[^0-9]"), 1, 4, 8, 12, 14, 16, 17),
        "letters": _bucket(count("[^A-Za-z]"), 1, 4, 12, 24),
        "groups": _bucket(F.size(F.split(t, "[^A-Za-z0-9]+")), 2, 3, 4, 5, 6, 8),
        "dots": F.least(count("[^.]"), F.lit(4)),
        "dashes": F.least(count("[^-]"), F.lit(3)),
        "blanks": F.least(count("[^ ]"), F.lit(3)),
        "colons": _bucket(count("[^:]"), 1, 4),
        "slashes": t.contains("/").cast("int"),
        "plus": t.startswith("+").cast("int"),
        "sign": F.when(t.contains("@"), 1).when(t.rlike("[(\\[]"), 2).otherwise(0),
        "valid": plausible(kind, t).cast("int"),
        "left": sort(left, m["s"] > 0),
        "right": sort(right, F.lit(True)),
        "cue": before.rlike(CUES).cast("int"),
        "doubt": before.rlike(DOUBTS).cast("int"),
    }


def candidates(text: Column) -> Column:
    """array<struct<g, s, e, features...>> of all generators."""

    def of_generator(g: int, kind: str, hint: str, pattern: str) -> Column:
        def described(m: Column) -> Column:
            features = (c.cast("int").alias(n) for n, c in _features(text, m, kind).items())
            return F.struct(F.lit(g).alias("g"), m["s"].alias("s"), m["e"].alias("e"), *features)

        return F.transform(matches(text, pattern, hint), described)

    return F.flatten(F.array(*(of_generator(g, *one) for g, one in enumerate(GENERATORS))))


def rewritten(kind: str, span: Column, before: Column) -> tuple[list[tuple], list[tuple]]:
    """(text before, span) of forms that are personal data, and of forms that only look like it.

    ``span`` is a base span; ``before`` the text ahead of it.
    """
    digits = _digits(span)
    lead = lambda *words: [F.lit(w) for w in words]
    if kind == "email":
        name, host = F.substring_index(span, "@", 1), F.substring_index(span, "@", -1)
        spelled = [
            F.concat(name, F.lit(" (at) "), host), F.concat(name, F.lit("[at]"), F.replace(host, F.lit("."), F.lit("[dot]"))),
            F.concat(name, F.lit(" @ "), host), F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))),
        ]
        numbers = F.concat(F.lit("1"), F.translate(F.substring(F.md5(span), 1, 2), "abcdef", "123456"))
        return [(before, x) for x in spelled], [(w, F.concat(numbers, sign, numbers, F.lit("."), numbers)) for w in [before, *lead("costs ")] for sign in lead(" @ ", " (at) ")]
    if kind == "ip":
        h = [F.substring(F.md5(span), i, 4) for i in range(1, 32, 4)]
        six = [F.concat_ws(":", *h), F.concat_ws(":", F.lit("2001"), F.lit("db8"), *h[:6]), F.concat(F.concat_ws(":", h[0], h[1]), F.lit("::"), F.concat_ws(":", h[2], h[3]))]
        two = [F.format_string("%02d", F.conv(F.substring(F.md5(span), i, 2), 16, 10).cast("int") % 60) for i in (1, 3, 5, 7)]
        bad = [F.concat(span, F.lit(".7")), F.concat_ws(".", F.lit("999"), F.substring_index(span, ".", 3)), F.concat_ws(":", *two), F.concat_ws(".", *(F.concat(x, F.lit("a")) for x in two))]
        return [(w, x) for w in [before, *lead("host ", "and ")] for x in six], [(w, x) for w in [before, *lead("version ", "v", "and ")] for x in bad]
    if kind == "card":
        four = lambda d, sign: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1" + sign)
        wrong = F.concat(F.substring(digits, 1, F.length(digits) - 1), ((F.substring(digits, -1, 1).cast("int") + 3) % 10).cast("string"))
        forms = [four(digits, "."), four(digits, "/")]
        return (
            [(w, x) for w in [before, *lead("card ", "and ")] for x in forms],
            [(w, x) for w in [before, *lead("order ", "card ", "and ")] for x in (four(wrong, "."), four(wrong, "/"), wrong)],
        )
    ten = F.rpad(F.substring(digits, 2, 10), 10, "5")
    part = lambda i, n: F.substring(ten, i, n)
    us = [
        F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)), F.concat_ws("-", part(1, 3), part(4, 3), part(7, 4)),
        F.concat_ws(".", part(1, 3), part(4, 3), part(7, 4)),
    ]
    bare = F.substring(span, 2, F.length(span))
    year, month = F.concat(F.lit("20"), part(1, 2)), F.format_string("%02d", part(3, 2).cast("int") % 12 + 1)
    dates = [F.concat_ws(sign, year, month, F.format_string("%02d", part(5, 2).cast("int") % 28 + 1)) for sign in ("-", ".", " ")]
    looks = [ten, F.concat_ws("-", part(1, 5), part(6, 5)), F.concat_ws(" ", part(1, 2), part(3, 2), part(5, 2), part(7, 2)), *dates]
    pairs = F.concat_ws(" ", *(part(i, 2) for i in range(1, 10, 2)))
    fine = [(w, x) for w in [before, *lead("phone ", "call ", "and ")] for x in us] + [(F.lit("phone "), pairs)] + [(w, bare) for w in lead("phone ", "tel: ")] + [(F.lit("call "), ten)]
    alike = [(before, x) for x in looks] + [(w, x) for w in lead("order no. ", "invoice ", "pages ", "#") for x in (ten, *looks[1:3], *us[1:], pairs)]
    return fine, alike


def labelled(docs: DataFrame, *, text: str = "text", bound: int = LABELLED) -> DataFrame:
    """(fold, genuine, g, features...) of the candidates in rewritten windows of at most ``bound`` base spans a kind.

    A candidate is genuine if the window holds a span of its kind and it covers that; candidates that do not touch
    the span tell nothing and are left out. The windows as they stand show what of another kind looks alike.
    """
    rows = pick(docs, text=text).select(_searchable(F.col("text")).alias("text")).where(F.col("text").rlike(ANY))
    hit = rows.select("text", F.explode(base_spans(F.col("text"))).alias("b"))
    window = hit.select(
        F.col("b.k").alias("k"), F.substring(F.col("text"), F.col("b.s") + 1, F.col("b.e") - F.col("b.s")).alias("t"),
        F.substring(F.col("text"), F.greatest(F.lit(1), F.col("b.s") + 1 - AROUND), F.least(F.col("b.s"), F.lit(AROUND))).alias("before"),
        F.substring(F.col("text"), F.col("b.e") + 1, AROUND).alias("after"),
    ).withColumn("h", F.xxhash64("before", "t", "after"))
    order = Window.partitionBy("k").orderBy("h", "t", "before", "after")
    taken = window.withColumn("n", F.row_number().over(order)).where(F.col("n") <= bound)

    def forms(kind: str, w: Column) -> Column:
        fine, alike = rewritten(kind, w["t"], w["before"])
        form = lambda pair, good: F.struct(pair[0].alias("before"), pair[1].alias("t"), F.lit(good).alias("good"))
        return F.array(form((w["before"], w["t"]), True), *(form(x, True) for x in fine), *(form(x, False) for x in alike))

    of_kind = lambda w: F.coalesce(*(F.when(w["k"] == k, forms(kind, w)) for k, kind in enumerate(KINDS)))
    # inside a lambda, since the forms are too much for one generated method
    every = F.get(F.transform(F.array(F.struct("k", "t", "before")), of_kind), 0)
    made = taken.select("k", "h", "after", F.explode(every).alias("f")).select(
        "k", F.pmod("h", F.lit(2)).cast("int").alias("fold"), "f.good", F.length("f.before").alias("s"), (F.length("f.before") + F.length("f.t")).alias("e"),
        F.concat("f.before", "f.t", "after").alias("text"),
    ).repartition("k", "fold", "text")
    each = made.select("k", "fold", "good", "s", "e", F.explode(candidates(F.col("text"))).alias("c")).where("c.s < e and s < c.e")
    kinds = F.array(*(F.lit(KINDS.index(k)) for k, _, _ in GENERATORS))
    genuine = F.col("good") & (F.get(kinds, F.col("c.g")) == F.col("k")) & (F.col("c.s") <= F.col("s") + 1) & (F.col("c.e") >= F.col("e"))
    return each.select("fold", genuine.alias("genuine"), *(F.col(f"c.{n}").alias(n) for n in ["g", *GRID]))


@dataclass
class BoostedTrees:
    """Additive trees of depth two on small whole-number features, and a threshold for each generator."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> BoostedTrees:
        """Logistic boosting on counts: row i stands for ``good[i]`` genuine and ``bad[i]`` other candidates."""
        total = good + bad
        share = (good.sum() + 1) / (total.sum() + 2)
        model = cls(float(np.log(share / (1 - share))))
        score = np.full(len(x), model.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, good - total * p, total * p * (1 - p), total, DEPTH)
            model.trees.append(tree)
            score = score + RATE * _apply(tree, x)
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, generator: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float) -> None:
        """Least score of each generator from which on at least ``precision`` of the held-out candidates are genuine."""
        score = self.score(x)
        for g in np.unique(generator):
            own = generator == g
            order = np.argsort(-score[own], kind="stable")
            s, hit, miss = score[own][order], np.cumsum(good[own][order]), np.cumsum(bad[own][order])
            last = np.append(s[1:] != s[:-1], True)
            fine = last & (hit >= precision * (hit + miss)) & (hit + miss >= LEAST_ROWS)
            if fine.any():
                self.thresholds[int(g)] = float(s[np.flatnonzero(fine)[-1]])

    def column(self, row: Column) -> Column:
        """The same score as an expression on a candidate."""
        return sum((_tree_column(t, row) * RATE for t in self.trees), F.lit(self.start))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
    leaf = ("leaf", float(np.clip(gradient.sum() / (weight.sum() + 1), -4, 4)))
    if depth == 0 or rows.sum() < 2 * LEAST_ROWS:
        return leaf
    best, at = 1e-6 + gradient.sum() ** 2 / (weight.sum() + 1), None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[1:]:
            low = x[:, f] < cut
            if min(rows[low].sum(), rows[~low].sum()) < LEAST_ROWS:
                continue
            gain = sum(gradient[s].sum() ** 2 / (weight[s].sum() + 1) for s in (low, ~low))
            if gain > best:
                best, at = gain, (f, int(cut), low)
    if at is None:
        return leaf
    f, cut, low = at
    return (f, cut, _grow(x[low], gradient[low], weight[low], rows[low], depth - 1), _grow(x[~low], gradient[~low], weight[~low], rows[~low], depth - 1))


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    return np.where(x[:, tree[0]] < tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _tree_column(tree: tuple, row: Column) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    name = ["g", *GRID][tree[0]]
    return F.when(row[name] < tree[1], _tree_column(tree[2], row)).otherwise(_tree_column(tree[3], row))


def _searchable(text: Column) -> Column:
    """The text without the marks of ``matches``; no pattern looks at control signs."""
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "\x03\x03")


def fit(docs: DataFrame, *, text: str = "text", precision: float = PRECISION) -> BoostedTrees:
    """Trees and thresholds from rewritten base spans of the documents."""
    names = ["g", *GRID]
    grid = labelled(docs, text=text).groupBy("fold", *names).agg(F.count_if("genuine").alias("good"), F.count_if(~F.col("genuine")).alias("bad"))
    counts = grid.orderBy("fold", *names).collect()  # no more than the windows' forms have candidates
    if not counts:
        return BoostedTrees()
    x = np.array([[r[n] for n in names] for r in counts])
    good, bad = (np.array([r[n] for r in counts], float) for n in ("good", "bad"))
    fold = np.array([r["fold"] for r in counts])
    model = BoostedTrees.fit(x[fold == 0], good[fold == 0], bad[fold == 0])
    model.calibrate(x[fold == 1], x[fold == 1][:, 0], good[fold == 1], bad[fold == 1], precision)
    return model


def spans(text: Column, base: Column, model: BoostedTrees) -> Column:
    """Base spans and the candidates that pass their threshold, by kind, then start."""
    if not model.thresholds:
        return base
    score = lambda c: model.column(c)
    limit = lambda c: sum((F.when(c["g"] == g, F.lit(t)).otherwise(0.0) for g, t in model.thresholds.items()), F.lit(0.0))
    known = lambda c: c["g"].isin(*model.thresholds)
    proposed = F.when(text.rlike(ANY), candidates(text))
    chosen = F.filter(proposed, lambda c: known(c) & (score(c) >= limit(c) - 1e-9) & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    kind = F.array(*(F.lit(KINDS.index(k)) for k, _, _ in GENERATORS))
    found = F.array_sort(F.transform(chosen, lambda c: F.struct((c["s"] - c["e"]).alias("n"), c["s"].alias("s"), c["e"].alias("e"), F.get(kind, c["g"]).alias("k"))))

    def take(kept: Column, c: Column) -> Column:
        span = F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))
        clash = F.exists(kept, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span)))

    return F.coalesce(F.array_sort(F.aggregate(found, base, take)), base)


def find(docs: DataFrame, model: BoostedTrees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row, both array<struct<k, s, e>> with k an index into ``KINDS``."""
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), _searchable(F.col("text")).alias("text"))
    based = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return based.select("doc_id", "base", spans(F.col("text"), F.col("base"), model).alias("spans"))


def redact(docs: DataFrame, model: BoostedTrees, *, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by the kind in brackets.

    Spans that touch become one, under the first one's kind. All columns stay; a null text stays null.
    """
    body = _searchable(col(text))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    base, every = unused(docs, "_base", "_spans")
    found = docs.withColumn(base, base_spans(body)).withColumn(every, spans(body, F.col(base), model))
    ordered = F.array_sort(F.transform(every, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["k"].alias("k"))))

    def step(state: Column, b: Column) -> Column:
        gap = F.substring(col(text), state["at"] + 1, F.greatest(F.lit(0), b["s"] - state["at"]))
        return F.struct(
            F.when(b["s"] >= state["at"], F.concat(state["out"], gap, F.get(names, b["k"]))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], b["e"]).alias("at"),
        )

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    joined = F.aggregate(ordered, first, step, lambda s: F.concat(s["out"], F.substring(col(text), s["at"] + 1, F.length(col(text)))))
    clean = F.when(F.size(every) > 0, joined).otherwise(col(text))
    return found.select(*(clean.alias(c) if c == text else col(c) for c in docs.columns))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda b: F.concat_ws(":", F.get(names, b["k"]), b["s"], b["e"])), ",")


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = find(docs, fit(docs))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op10_personal_data": personal_data}

"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Every string of ``SPAN`` bytes holds one anchor: the start of its ``SEED`` bytes with the least hash. Equal
strings have equal anchors at equal places, so the suffixes that start at anchors are all that a search for
matches of ``SPAN`` bytes needs. A batch of documents becomes a suffix array of its anchors, ordered by a hash of the suffix's
leading bytes; suffixes that agree on all their strings (the bytes before and after the anchor that any of them
covers) are one entry with a count.

``SuffixIndex.add`` merge-scans a batch against the existing levels. Two levels of equal size then merge when the
next batch arrives, so n batches leave at most log2(n) + 1 levels and an entry is rewritten log2(n) times. A scan
notes the anchors under which entries differ; ``covered`` settles those by comparing every single string of the
entries: in small groups side by side, in large ones through counts of hashed strings, so that no group is
gathered; there the bytes before and after the anchor are matched first, which leaves few strings to count. Strings are compared by 64-bit hashes.

Passages of words are looked for beside the strings, since one of 51 words may be shorter than ``SPAN`` bytes: of every ``PASSAGE``
words the run of ``RUN`` words with the least hash is picked, and picked runs that other rows hold too are shared. Rows that share a passage of
``PASSAGE`` words pick the same run of it, so none is missed. Shared words are counted, never removed.

Results for odd input: null texts are empty; texts shorter than ``SPAN`` lose nothing; repeated rows are copies and
lose everything from ``SPAN`` bytes on; strings that overlap themselves count; extra columns are ignored; an empty table gives
no rows. Rows may share an id if their texts differ (of 32768 such pairs one is confused, whose texts then share their spans); the id
-2^63 means none. Texts are read whole, a million strings at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.frames import map_columns, pick
from wayline.session import settle

#: Stands for a missing id inside; no row may have it.
NO_ID = -(1 << 63)
SPAN = 400
SEED = 32
BATCHES = 3
#: Entries under one anchor hash up to which their strings are compared side by side.
GROUP = 512
#: Strings of such entries that are counted together, and the rows that hold them.
BLOCK = 8
BLOCKS = "block long, seed long, whole long, n long, start int, steps array<int>, strings array<long>"
#: Words of a run, and words from which a passage that rows share is always found.
RUN, PASSAGE = 32, 51
_STEP = 1 << 20
#: Bytes of short texts that are hashed together.
TOGETHER = 1 << 16
_REACH = SPAN - SEED + 1

_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256).astype(np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64; made once per process."""
    if not _POWERS:
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(_STEP + 2 * SPAN, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashed:
    """Hash of any run of a piece of text, or of hashes of words, in constant time."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _BYTES[data] if data.dtype == np.uint8 else data
        np.cumsum(values * self.power[: len(data)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_runs(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _finish((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, last string, first string's distance to the anchor, anchor hash, hash of the whole) per anchor.

    Strings are named by their start. A text's strings are taken a million at a time; anchors at the cuts give two entries.
    """
    whole = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, len(whole) - SPAN + 1, _STEP - SPAN):
        part = whole[at : at + _STEP - 1]
        if len(part) < SPAN:
            break
        hashed = Hashed(part)
        seeds = hashed.all_runs(SEED)
        least = _least((seeds & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(seeds), dtype=np.uint64), _REACH)
        anchor = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)
        last = np.append(first[1:], len(anchor)) - 1
        left = anchor[first] - first
        shape = (left * 1024 + last - first).astype(np.uint64) * np.uint64(_ODD)
        out.append((first + at, last + at, left, seeds[anchor[first]].view(np.int64), _finish(hashed.run(first, last + SPAN) ^ shape).view(np.int64)))
    if not out:
        return tuple(np.array([], np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tag(data: bytes) -> int:
    """15 bits of a text's hash, to tell texts apart that share an id."""
    return xxhash.xxh3_64_intdigest(data) & 0x7FFF


def _place(first, last, left, tag):
    return ((first * 512 + (last - first)) * 512 + left) * 32768 + tag


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = place // 32768
    first = rest // (512 * 512)
    return first, first + rest // 512 % 512, rest % 512


def entries_together(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of the text, then as ``entries``, for every text; several are less than ``TOGETHER`` bytes in all."""
    if len(texts) == 1:
        found = entries(texts[0])
        return np.zeros(len(found[0]), np.int64), *found
    sizes = np.array([len(x) for x in texts])
    end = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.flatnonzero(np.arange(len(owner)) + SPAN <= end[owner])  # strings that stay inside their text
    if not len(start):
        return tuple(np.array([], np.int64) for _ in range(6))
    hashed = Hashed(np.frombuffer(b"".join(texts), np.uint8))
    seeds = hashed.all_runs(SEED)
    least = _least((seeds & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(seeds), dtype=np.uint64), _REACH)
    anchor = (least[start] & np.uint64(0xFFFFF)).astype(np.int64)
    at = np.append(0, np.flatnonzero(np.diff(anchor)) + 1)  # texts share no anchor
    first, last = start[at], start[np.append(at[1:], len(anchor)) - 1]
    left = anchor[at] - first
    shape = (left * 1024 + last - first).astype(np.uint64) * np.uint64(_ODD)
    text = owner[first]
    base = (end - sizes)[text]
    return text, first - base, last - base, left, seeds[anchor[at]].view(np.int64), _finish(hashed.run(first, last + SPAN) ^ shape).view(np.int64)


def _batched(columns: list) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(ids, texts, tags) of rows in a row whose texts are hashed together; a long one stands alone."""
    keys = np.array([NO_ID if k is None else k for k in columns[0].to_pylist()], np.int64)
    texts: list[bytes] = []
    start = size = 0
    for i, text in enumerate(columns[1]):
        data = text.as_py() or b""
        if texts and size + len(data) + 1 >= TOGETHER:
            yield keys[start:i], texts, np.array([_tag(x) for x in texts])
            start, size, texts = i, 0, []
        texts.append(data)
        size += len(data) + 1
    if texts:
        yield keys[start:], texts, np.array([_tag(x) for x in texts])


def _entry_rows(columns: list) -> Iterator[tuple[list, ...]]:
    held: list[list[np.ndarray]] = [[], [], [], []]
    size = 0
    for keys, texts, tags in _batched(columns):
        owner, first, last, left, seed, whole = entries_together(texts)
        if len(first):
            for part, value in zip(held, (seed, whole, keys[owner], _place(first, last, left, tags[owner]))):
                part.append(value)
            size += len(first)
        if size > 100_000:
            yield tuple(map(np.concatenate, held))
            held, size = [[], [], [], []], 0
    if size:
        yield tuple(map(np.concatenate, held))


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of every word between ASCII blanks; one of over a million bytes is cut."""
    whole = np.frombuffer(data, np.uint8)
    out, at = [np.array([], np.uint64)], 0
    while at < len(whole):
        part = whole[at : at + _STEP]
        blank = _BLANK[part]
        if at + len(part) < len(whole) and blank.any():
            size = int(np.flatnonzero(blank)[-1]) + 1
            part, blank = part[:size], blank[:size]
        edges = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
        out.append(Hashed(part).run(np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)))
        at += len(part)
    return np.concatenate(out)


def picked_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of ``RUN`` words that have the least hash in some passage of ``PASSAGE`` words."""
    words = word_hashes(data)
    first, runs = [np.array([], np.int64)], [np.array([], np.int64)]
    for at in range(0, len(words) - PASSAGE + 1, _STEP - PASSAGE):
        hashes = Hashed(words[at : at + _STEP - 1]).all_runs(RUN)
        least = _least((hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(hashes), dtype=np.uint64), PASSAGE - RUN + 1)
        picked = np.unique((least & np.uint64(0xFFFFF)).astype(np.int64))
        first.append(picked + at)
        runs.append(hashes[picked].view(np.int64))
    return np.concatenate(first), np.concatenate(runs)


def runs_together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, then as ``picked_runs``, for every text; several are less than ``TOGETHER`` bytes in all."""
    if len(texts) == 1:
        found = picked_runs(texts[0])
        return np.zeros(len(found[0]), np.int64), *found
    part = np.frombuffer(b"\n".join(texts), np.uint8)
    edges = np.diff(np.concatenate(([True], _BLANK[part], [True])).view(np.int8))
    start = np.flatnonzero(edges == -1)
    words = Hashed(part).run(start, np.flatnonzero(edges == 1))
    # the words of text k stand from bounds[k] to bounds[k + 1]
    bounds = np.append(0, np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts])))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    passage = np.flatnonzero(np.arange(len(words)) + PASSAGE <= bounds[1:][owner])  # those that stay inside their text
    if not len(passage):
        return tuple(np.array([], np.int64) for _ in range(3))
    hashes = Hashed(words).all_runs(RUN)
    least = _least((hashes & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(hashes), dtype=np.uint64), PASSAGE - RUN + 1)
    picked = np.unique((least[passage] & np.uint64(0xFFFFF)).astype(np.int64))
    return owner[picked], picked - bounds[owner[picked]], hashes[picked].view(np.int64)


def _run_rows(columns: list) -> Iterator[tuple[list, ...]]:
    held: list[list[np.ndarray]] = [[], [], []]
    size = 0
    for keys, texts, tags in _batched(columns):
        owner, first, runs = runs_together(texts)
        if len(first):
            order = np.lexsort((runs, owner))
            fresh = np.ones(len(runs), np.int64)  # 1 where a run comes first in its row
            fresh[order[1:]] = (np.diff(runs[order]) != 0) | (np.diff(owner[order]) != 0)
            for part, value in zip(held, (runs, keys[owner], (first * 2 + fresh) * 32768 + tags[owner])):
                part.append(value)
            size += len(runs)
        if size > 100_000:
            yield tuple(map(np.concatenate, held))
            held, size = [[], [], []], 0
    if size:
        yield tuple(map(np.concatenate, held))


def shared_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, words): first words of the picked runs of every text that another row holds too."""
    found = settle(map_columns(rows, _run_rows, "run long, doc_id long, place long"), "runs")
    fresh = F.shiftright("place", 15) % 2
    shared = settle(found.groupBy("run").agg(F.sum(fresh).alias("n")).where("n > 1").select("run"), "shared-runs")
    return found.join(shared, "run").groupBy("doc_id", (F.col("place") % 32768).alias("tag")).agg(
        F.collect_set(F.shiftright("place", 16)).alias("words")  # bounded by the text
    )


def entry_rows(rows: DataFrame) -> DataFrame:
    """(seed, whole, doc_id, place): every entry of ``rows`` (doc_id, text)."""
    return map_columns(rows, _entry_rows, "seed long, whole long, doc_id long, place long")


def suffix_array(found: DataFrame) -> DataFrame:
    """(seed, whole, n, doc_id, place): the entries of ``entry_rows``, equal ones counted, one place each."""
    return _merged(found.withColumn("n", F.lit(1).cast("long")))


def _merged(found: DataFrame) -> DataFrame:
    one = F.min(F.struct("doc_id", "place")).alias("at")
    return found.groupBy("seed", "whole").agg(F.least(F.sum("n"), F.lit(2)).alias("n"), one).select(
        "seed", "whole", "n", "at.doc_id", "at.place"
    ).sortWithinPartitions("seed")


class SuffixIndex:
    """Levels of suffix arrays over batches of (doc_id, text); ``text`` is binary."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.noted: DataFrame | None = None
        self.repeated: DataFrame | None = None
        self.rows: DataFrame | None = None
        self.places: DataFrame | None = None

    def add(self, batch: DataFrame) -> None:
        """Scan a batch against all levels, then keep it as the smallest level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, small), (_, large) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, settle(_merged(large.unionByName(small)), "level")))
        places = settle(entry_rows(batch), "places")  # read again for the spans
        self.places = places if self.places is None else self.places.unionByName(places)
        own = settle(suffix_array(places), "level")
        met = own.select("seed", "whole", "n", F.lit(True).alias("fresh"))
        for _, level in self.levels:
            met = met.unionByName(level.select("seed", "whole", "n", F.lit(False).alias("fresh")))
        by_seed = met.groupBy("seed").agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.max("fresh").alias("fresh"), F.sum("n").alias("n"))
        # one entry alone under its anchor matches nothing; several equal ones match whole; different ones are compared later
        found = settle(by_seed.where("fresh and n > 1").select("seed", (F.col("low") != F.col("high")).alias("differ")), "matches")
        self.noted = found if self.noted is None else self.noted.unionByName(found)
        self.rows = batch if self.rows is None else self.rows.unionByName(batch)
        self.levels.append((1, own))

    def covered(self) -> DataFrame:
        """(seed, whole, runs): the strings of an entry that occur again, as runs of (first, last), counted from its first."""
        noted = settle(self.noted.groupBy("seed").agg(F.max("differ").alias("differ")), "noted")
        every = self.levels[0][1]
        for _, level in self.levels[1:]:
            every = every.unionByName(level)
        mine = settle(_merged(every.join(noted.select("seed"), "seed")), "noted-entries")
        length = F.shiftright("place", 24) % 512
        repeated = mine.where("n > 1").select("seed", "whole", F.array(F.struct(F.lit(0).alias("first"), length.cast("int").alias("last"))).alias("runs"))
        sizes = mine.groupBy("seed").agg(F.count("*").alias("entries")).where("entries > 1")
        differing = settle(mine.join(settle(sizes, "sizes"), "seed").select("seed", "whole", "n", "doc_id", "place", "entries"), "differing")
        by_text = differing.groupBy("doc_id", (F.col("place") % 32768).alias("tag")).agg(
            F.collect_list(F.struct("seed", "whole", "n", "place", "entries")).alias("wanted")  # bounded by the text
        )
        texts = packed_texts(self.rows).join(settle(by_text, "wanted"), ["doc_id", "tag"])
        cut = texts.select("packed", "wanted")
        small = cut.select("packed", F.filter("wanted", lambda w: w["entries"] <= GROUP).alias("wanted")).where(F.size("wanted") > 0)
        large = cut.select("packed", F.filter("wanted", lambda w: w["entries"] > GROUP).alias("wanted")).where(F.size("wanted") > 0)
        parts = small.mapInArrow(_slices, "seed long, whole long, n long, place long, text binary")
        runs = parts.repartition("seed").sortWithinPartitions("seed").mapInArrow(_compare, "seed long, whole long, runs array<struct<first:int,last:int>>")
        crowd = settle(large.mapInArrow(_slices, "seed long, whole long, n long, place long, text binary"), "crowds")
        # how far an entry agrees with any other, on either side of the anchor, bounds the strings they can share
        sides = crowd.mapInArrow(_sides, "seed long, whole long, before boolean, steps int, part long")
        shared = sides.groupBy("part").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high").select("part")
        steps = lambda side: F.coalesce(F.max(F.when(side, F.col("steps"))), F.lit(0))
        reach = sides.join(settle(shared, "shared-sides"), "part").groupBy("seed", "whole").agg(
            steps(F.col("before")).alias("left"), steps(~F.col("before")).alias("right")
        )
        blocks = settle(crowd.join(settle(reach, "reach"), ["seed", "whole"]).mapInArrow(_strings, BLOCKS), "blocks")
        # each different block of strings once; a string occurs again in another block, or with its block
        every = blocks.groupBy("block").agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.min(F.struct("steps", "strings")).alias("one"))
        every = every.select("block", (F.col("low") != F.col("high")).alias("common"), F.explode(F.arrays_zip("one.steps", "one.strings")).alias("x"))
        every = settle(every.select("block", "common", F.col("x.steps").alias("step"), F.col("x.strings").alias("string")), "strings")
        again = every.groupBy("string").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.max("common").alias("common"))
        again = settle(again.where("low <> high or common").select("string"), "again")
        steps = settle(every.join(again, "string").groupBy("block").agg(F.collect_set("step").alias("again")), "steps")  # at most BLOCK
        # entries that occur again as a whole are covered already
        hits = blocks.where("n = 1").join(steps, "block").select("seed", "whole", F.transform("again", lambda x: F.col("start") - x).alias("at"))
        hits = hits.groupBy("seed", "whole").agg(F.flatten(F.collect_list("at")).alias("at"))  # at most 369
        single = F.transform("at", lambda x: F.struct(x.alias("first"), x.alias("last")))
        return repeated.unionByName(runs).unionByName(hits.select("seed", "whole", single.alias("runs")))


def _pack_text(columns: list) -> tuple[list, ...]:
    packer = zstandard.ZstdCompressor(level=1)  # for one shuffle
    data = [x.as_py() or b"" for x in columns[1]]
    return [NO_ID if k is None else k for k in columns[0].to_pylist()], [_tag(x) for x in data], [packer.compress(x) for x in data]


def packed_texts(rows: DataFrame) -> DataFrame:
    return map_columns(rows, _pack_text, "doc_id long, tag long, packed binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the strings of each wanted entry cover."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data, rows = unpacker.decompress(packed.as_py()), wanted.as_py()
            first, last, _ = _unplace(np.array([w["place"] for w in rows]))
            texts = [data[a : b + SPAN] for a, b in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_pydict(
                {"seed": [w["seed"] for w in rows], "whole": [w["whole"] for w in rows], "n": [w["n"] for w in rows], "place": [w["place"] for w in rows], "text": pa.array(texts, pa.binary())}
            )


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of what stands before and after each entry's anchor, in steps of ``SEED`` bytes."""
    for batch in batches:
        seeds, wholes = batch.column("seed").to_numpy(), batch.column("whole").to_numpy()
        _, _, left = _unplace(batch.column("place").to_numpy())
        out: list[tuple[np.ndarray, ...]] = []
        for seed, whole, anchor, text in zip(seeds, wholes, left.tolist(), batch.column("text")):
            data = np.frombuffer(text.as_py(), np.uint8)
            hashed = Hashed(data)
            for before, most in ((True, anchor), (False, min(SPAN, len(data) - anchor))):
                steps = np.arange(1, most // SEED + 1)
                start = anchor - steps * SEED if before else np.full(len(steps), anchor)
                end = np.full(len(steps), anchor) if before else anchor + steps * SEED
                part = hashed.run(start, end) ^ (np.uint64(seed.view(np.uint64)) + steps.astype(np.uint64) * np.uint64(2) + np.uint64(before)) * np.uint64(_ODD)
                out.append((np.full(len(steps), seed), np.full(len(steps), whole), np.full(len(steps), before), steps.astype(np.int32), _finish(part).view(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["seed", "whole", "before", "steps", "part"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those strings of each entry, as hashes, that reach no further than it agrees with another entry.

    They come in blocks by their distance from the anchor: string ``step`` of a block starts at ``start - step``.
    """
    for batch in batches:
        first, last, anchor = _unplace(batch.column("place").to_numpy())
        rows = zip(
            batch.column("seed").to_pylist(), batch.column("whole").to_pylist(), batch.column("n").to_pylist(), batch.column("text"), (last - first).tolist(), anchor.tolist(),
            batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True,
        )
        out: dict[str, list] = {"block": [], "seed": [], "whole": [], "n": [], "start": [], "steps": [], "strings": []}
        for seed, whole, n, text, count, place, left, right in rows:
            # a string from ``at`` holds place - at bytes before the anchor, and the rest after it
            low = max(0, place - SEED * (left + 1) + 1)
            high = min(count, place + SEED * (right + 1) - 1 - SPAN)
            if low > high:
                continue
            strings = Hashed(np.frombuffer(text.as_py(), np.uint8)).all_runs(SPAN)[low : high + 1].view(np.int64)
            before = place - np.arange(low, high + 1)
            for b in range(int(before[-1]) // BLOCK, int(before[0]) // BLOCK + 1):
                mine = before // BLOCK == b
                steps, held = (before[mine] % BLOCK).astype(np.int32), strings[mine]
                name = xxhash.xxh3_64_intdigest(held.tobytes() + steps.tobytes()) - (1 << 63)
                for column, value in zip(out.values(), (name, seed, whole, n, place - b * BLOCK, steps, held), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], names=list(out))


_RUNS = pa.schema([("seed", pa.int64()), ("whole", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def _settle_group(seeds: list[int], wholes: list[int], texts: list[bytes]) -> pa.RecordBatch:
    hashes, owner, at = [], [], []
    for i, text in enumerate(texts):
        h = Hashed(np.frombuffer(text, np.uint8)).all_runs(SPAN)
        hashes.append(h)
        owner.append(np.full(len(h), i))
        at.append(np.arange(len(h)))
    h, owner, at = np.concatenate(hashes), np.concatenate(owner), np.concatenate(at)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    owner, at = owner[again], at[again]
    out: dict[str, list] = {"seed": [], "whole": [], "runs": []}
    starts = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(at) != 1))) if len(at) else np.array([], int)
    ends = np.append(starts[1:], len(at))
    last = -1
    for s, e in zip(starts.tolist(), ends.tolist()):
        i = int(owner[s])
        if i != last:
            out["seed"].append(seeds[i])
            out["whole"].append(wholes[i])
            out["runs"].append([])
            last = i
        out["runs"][-1].append({"first": int(at[s]), "last": int(at[e - 1])})
    return pa.RecordBatch.from_pydict(out, schema=_RUNS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by anchor hash; whole groups are settled a few thousand entries at a time."""
    seeds: list[int] = []
    wholes: list[int] = []
    texts: list[bytes] = []
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for seed, whole, text in zip(batch.column("seed").to_pylist(), batch.column("whole").to_pylist(), batch.column("text")):
            if seeds and seed != seeds[-1]:
                if len(seeds) >= 4_000:
                    yield _settle_group(seeds, wholes, texts)
                    seeds, wholes, texts = [], [], []
                seen = set()
            if whole not in seen:  # a repeated row brings its entries twice
                seen.add(whole)
                seeds.append(seed)
                wholes.append(whole)
                texts.append(text.as_py())
    if seeds:
        yield _settle_group(seeds, wholes, texts)


def removed_spans(places: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): the covered byte ranges of every text that has some, unmerged; ``places`` as ``entry_rows``."""
    hit = places.join(settle(covered, "covered"), ["seed", "whole"])
    first = F.shiftright("place", 33)
    spans = F.transform("runs", lambda r: F.struct((first + r["first"]).alias("start"), (first + r["last"] + SPAN).alias("end")))
    return hit.groupBy("doc_id", (F.col("place") % 32768).alias("tag")).agg(F.flatten(F.collect_list(spans)).alias("spans"))  # bounded by the text


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _ends(column: pa.ListArray) -> np.ndarray:
    """Where the values of each list end among those of all lists; a null one has none."""
    return np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def _cut(columns: list) -> tuple[list, list[bytes], list[list[tuple[int, int]]]]:
    """Ids, the bytes that are left, and the ranges that are not."""
    unpacker = zstandard.ZstdDecompressor()
    found = list(zip(*(x.to_pylist() for x in columns[2].flatten().flatten())))
    kept, spans, at = [], [], 0
    for packed, end in zip(columns[1], _ends(columns[2]).tolist(), strict=True):
        data = unpacker.decompress(packed.as_py())
        merged = merge_spans(found[at:end])
        at = end
        if merged:
            bounds = [0, *(x for span in merged for x in span), len(data)]
            data = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
        kept.append(data)
        spans.append(merged)
    return [None if k == NO_ID else k for k in columns[0].to_pylist()], kept, spans


def _remove(columns: list) -> tuple[list, ...]:
    ids, kept, spans = _cut(columns)
    return ids, kept, [[{"start": a, "end": b} for a, b in x] for x in spans]


def _shared_words(column: pa.ListArray) -> np.ndarray:
    """Words in runs that start at the listed words, for every list."""
    ends = _ends(column)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first = column.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((first, owner))
    words = np.full(len(order), RUN)
    same = np.diff(owner) == 0
    words[:-1][same] = np.minimum(np.diff(first[order]), RUN)[same]
    return np.bincount(owner, weights=words, minlength=len(ends)).astype(np.int64)


def _digest(columns: list) -> tuple[list, ...]:
    ids, kept, spans = _cut(columns)
    removed = [sum(b - a for a, b in x) for x in spans]
    return (
        ids, [len(k) + r for k, r in zip(kept, removed)], removed, [len(s) for s in spans], [hashlib.sha256(k).hexdigest() for k in kept],
        [k.decode(errors="replace") for k in kept], _shared_words(columns[3]),
    )


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """(doc_id, kept, spans): the bytes that are left of every row, and the ranges that were removed.

    ``batches``: the documents arrive in so many parts, by a hash of their id. ``digest`` gives counts, a
    checksum and the text of what is left (half a letter left at a cut shows as U+FFFD), and the number of words in runs
    that other rows hold too, removed or not.
    """
    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    index = SuffixIndex()
    for part in range(batches):
        index.add(rows.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(batches)) == part))
    index.rows = rows
    spans = settle(removed_spans(index.places, index.covered()), "spans")
    if digest:
        both = spans.join(settle(shared_runs(rows), "shared"), ["doc_id", "tag"], "full")
        met = packed_texts(rows).join(both, ["doc_id", "tag"], "left").select("doc_id", "packed", "spans", "words")
        return map_columns(
            met, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, n_shared_words long"
        )
    met = packed_texts(rows).join(spans, ["doc_id", "tag"], "left").select("doc_id", "packed", "spans")
    return map_columns(met, _remove, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{folder}/documents.parquet"), digest=True)


QUERIES = {"op1_suffix_levels": suffix_levels}

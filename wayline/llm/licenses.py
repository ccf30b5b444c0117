"""License scans: an inverted index of winnowed template fingerprints, then banded alignment.

Templates are cut into runs of three words; of every four neighbouring runs the one with the least hash is a
fingerprint, so six words in common are never missed. A text's runs are looked up in the index; hits of one template on
nearby diagonals are a candidate region, which local alignments inside a band settle, one for each copy: matched words, the
share of the template they cover, and where they stand in the text. A window that lacks the words for the wanted share is not
aligned. A copy counts only if it holds all names and numbers of its template and no name of another licence.

The templates are fixed and small; nothing but the texts grows. Only words that occur in a template are
told apart, so most texts end at the lookup.

Results for odd input: null and empty texts give no rows; a template that stands several times gives several
rows; regions that overlap go to the template with more matched words, then the first by name; repeated rows are
scanned each; extra columns are ignored. Texts are read whole, one at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.frames import map_columns, pick

RUN = 3
WINDOW = 4
BAND = 12
COVERAGE = 0.6

#: Notices as they are published. Fixed values.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more"
        " details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation the"
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and"
        " this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

#: Short lines of further licences. Fixed values.
TEMPLATES |= {
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3",
}
_CLAUSES = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
for _code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version, _port in (("3.0", "Unported"), ("4.0", "International")):
        _long = "-".join(_CLAUSES[part] for part in _code.split("-"))
        for _name, _text in (
            (f"CC-{_code}-{_version}", f"This work is licensed under a Creative Commons {_long} {_version} {_port} License"),
            (f"CC-{_code}-{_version}-short", f"Licensed under CC {_code} {_version}"),
        ):
            if _text not in TEMPLATES.values():
                TEMPLATES[_name if _name not in TEMPLATES else _name + "-long"] = _text
#: Words that tell a licence from its neighbours, as do numbers.
TELLING = frozenset(
    b"affero apache attribution boost eclipse gnu lesser mozilla mpl nc nd noncommercial noderivatives noderivs sa sharealike".split()
)

#: Letters and digits stay, capitals become small, all other ASCII signs end a word.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
_WORD = re.compile(rb"[^ ]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split(b" ")


@dataclass
class TemplateIndex:
    """Words of the templates as numbers, and fingerprints with their places."""

    names: list[str] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    telling: list[frozenset[bytes]] = field(default_factory=list)

    @classmethod
    def build(cls, templates: dict[str, str]) -> TemplateIndex:
        index = cls()
        for name in sorted(templates):
            found = [w for w in words_of(templates[name].encode()) if w]
            index.names.append(name)
            index.telling.append(frozenset(w for w in found if w in TELLING or w.isdigit()))
            index.words.append([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in found])
        for t, ids in enumerate(index.words):
            for at in index.winnowed(ids):
                index.places.setdefault(int(index.runs(np.array(ids))[at]), []).append((t, at))
        return index

    def told(self, t: int, words: list[bytes]) -> bool:
        """Whether these words name the licence of template ``t``: all its telling words and numbers, and no other name."""
        held = set(words)
        return self.telling[t] <= held and TELLING & held <= self.telling[t]

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """One number for each run of three template words; 0 where a word is in no template."""
        if len(ids) < RUN:
            return np.array([], np.int64)
        a, b, c = ids[:-2].astype(np.int64), ids[1:-1], ids[2:]
        size = len(self.vocabulary) + 1
        return np.where((a > 0) & (b > 0) & (c > 0), (a * size + b) * size + c, 0)

    def winnowed(self, ids: list[int]) -> list[int]:
        runs = self.runs(np.array(ids)).astype(np.uint64)
        mixed = (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        starts = range(max(1, len(mixed) - WINDOW + 1)) if len(mixed) else []
        return sorted({s + int(np.argmin(mixed[s : s + WINDOW])) for s in starts})


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on diagonals ``low`` to ``high`` (text minus template place): (matched words, first, end in the text).

    A match counts one, anything else costs one; of equal scores the earlier one stands.
    """
    # score, matched, first text word; one row for each template word
    before: dict[int, tuple[int, int, int]] = {}
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            diagonal = before.get(j - 1, (0, 0, j))
            if text[j] == word:
                cell = (diagonal[0] + 1, diagonal[1] + 1, diagonal[2] if diagonal[0] else j)
            else:
                options = [diagonal, before.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))]
                top = max(options, key=lambda x: (x[0], x[1]))
                cell = (top[0] - 1, top[1], top[2]) if top[0] > 1 else (0, 0, j)
            row[j] = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        before = row
    return best[1], best[2], best[3]


def copies(template: list[int], ids: np.ndarray, region: list[tuple[int, int]], coverage: float, telling: list[int]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of every copy of a template around its hits, which are (text place, template place).

    Each window of the hits within one template length and band of its first one is aligned; what lies left and
    right of a copy is looked at again until nothing more reaches the coverage.
    """
    size, found = len(template), []
    wanted = np.bincount(template)
    places = [a for a, _ in region]
    open_ = [(0, len(region), 0, len(ids))]
    while open_:
        lo, hi, least, most = open_.pop()
        while lo < hi:
            near = region[lo : bisect_right(places, places[lo] + size + BAND, lo, hi)]
            diagonals = [a - p for a, p in near]
            start = max(least, min(diagonals) - BAND)
            end = min(most, max(diagonals) + size + BAND)
            # a copy holds the telling words, and no alignment matches more words than the window has of the template's
            there = np.bincount(ids[start:end], minlength=len(wanted))[: len(wanted)]
            if there[telling].all() and np.minimum(there, wanted).sum() >= coverage * size:
                low, high = min(diagonals) - BAND - start, max(diagonals) + BAND - start
                matched, first, last = align(template, ids[start:end].tolist(), low, high)
                if matched >= coverage * size:
                    break
            # the first hit begins no copy that the others of its window would not give as well
            lo += 1
        else:
            continue
        first, last = start + first, start + last
        found.append((matched, first, last))
        open_.append((lo, bisect_right(places, first - RUN, lo, hi), least, first))
        open_.append((bisect_left(places, last, lo, hi), hi, last, most))
    return found


def scan(data: bytes, index: TemplateIndex, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(license, first byte, end byte, matched words, coverage) of a text in UTF-8."""
    get = index.vocabulary.get
    words = [w for w in words_of(data) if w]
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    runs = index.runs(ids)
    hits: dict[int, list[tuple[int, int]]] = {}
    for at in np.flatnonzero(runs).tolist():
        for t, place in index.places.get(int(runs[at]), ()):
            hits.setdefault(t, []).append((at, place))
    if not hits:
        return []
    found = []
    for t, pairs in hits.items():
        size, region = len(index.words[t]), []
        telling = [index.vocabulary[w] for w in index.telling[t]]
        for at, place in [*sorted(pairs), (1 << 60, 0)]:
            if region and at - region[-1][0] > size + BAND:
                found += [
                    (-matched, index.names[t], first, last, matched / size)
                    for matched, first, last in copies(index.words[t], ids, region, coverage, telling) if index.told(t, words[first:last])
                ]
                region = []
            region.append((at, place))
    kept: list[tuple[int, int]] = []
    bounds = [m.span() for m in _WORD.finditer(data.translate(_FOLD))] if found else []
    out = []
    for negative, name, first, last, share in sorted(found):
        at = bisect_left(kept, (first, last))
        if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or last <= kept[at][0]):
            kept.insert(at, (first, last))
            out.append((name, bounds[first][0], bounds[last - 1][1], -negative, share))
    return sorted(out, key=lambda x: x[1])


SCHEMA = "doc_id long, license string, start long, end long, matched long, coverage double"


def license_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each notice found: its code points in the text (end exclusive), matched words and template coverage."""
    index = TemplateIndex.build(templates or TEMPLATES)

    def run(columns: list) -> tuple[list, ...]:
        rows = []
        for doc, text_ in zip(columns[0].to_pylist(), columns[1]):
            data = text_.as_py() or b""
            for name, first, end, matched, share in scan(data, index, coverage):
                rows.append((doc, name, len(data[:first].decode()), len(data[:end].decode()), matched, share))
        return tuple(map(list, zip(*rows))) if rows else ([], [], [], [], [], [])

    rows = pick(docs, doc_id=key, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_columns(rows, run, SCHEMA)


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_spans(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op5_license_scan": license_scan}

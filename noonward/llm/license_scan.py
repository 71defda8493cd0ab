"""License scans by patience alignment.

Where a text may hold a template, the two are aligned as patience sorting does: words that are unique in both are
anchors, the longest increasing subsequence of these is kept, equal words next to an anchor extend it, and the
gaps between anchors are aligned in the same way. The share of the template's words that find a partner is its
coverage.

Where a text may hold a template follows from the coverage asked for: a stretch of it must have so many of the
template's words, in any order. Only such stretches are aligned, each by itself, so that a notice that stands in
a text twice is found twice.

Coverage alone would let short templates lack no word. Those may lack one, but none of the words that name the
license; where such a find overlaps a better one of the same license, only the better one counts.
"""

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noonward.llm.common import extended, slices, without

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Notices of common licenses, as their authors ask to put them into files.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-notice": "This project is licensed under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-released": "Released under the MIT License.",
    "Apache-2.0-released": "Released under the Apache License 2.0.",
    "GPL-3.0-released": "Released under the GNU General Public License, version 3.",
    "GPL-3.0-v3": "Released under the GNU General Public License v3.0.",
    "GPL-3.0-short": "Released under the GNU GPL v3.",
    "BSD-2-Clause-released": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-released": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0-long": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-long": "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0-released": "Released under the Mozilla Public License 2.0.",
}

#: Words that name a license, besides those with a digit.
NAMING = frozenset(
    "mit apache bsd isc gnu gpl lgpl agpl lesser affero mozilla mpl eclipse cc by by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons "
    "attribution attribution-sharealike attribution-noncommercial attribution-noderivatives".split()
)
#: Templates of fewer words must be there whole.
SHORTEST = 5


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        common = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [common[k] for k in longest_increasing([j for _, j in common])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    """`least` words must match; `needed` are the places of those that must be among them; `full` words are the coverage asked for."""

    name: str
    words: tuple[str, ...]
    least: int
    full: int
    needed: tuple[int, ...] = ()

    @classmethod
    def of(cls, name: str, text: str, coverage: float) -> "Template":
        words = tuple(w for w, _, _ in words_of(text))
        full = max(1, -int(-len(words) * coverage // 1))
        naming = tuple(i for i, w in enumerate(words) if w in NAMING or re.search("[0-9]", w))
        if coverage < 1 and full == len(words) >= SHORTEST and 0 < len(naming) < len(words) - 1:
            return cls(name, words, full - 1, full, naming)
        return cls(name, words, full, full)

    @property
    def naming(self) -> set[str]:
        return {self.words[i] for i in self.needed}

    def regions(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches in which each window of twice the template's length that may hold it lies whole."""
        own, size = Counter(self.words), 2 * len(self.words)
        hits = [i for i, w in enumerate(words) if w in own]
        held: Counter = Counter()
        out: list[list[int]] = []
        first = enough = 0
        for i in hits:
            held[words[i]] += 1
            enough += held[words[i]] <= own[words[i]]
            while i - hits[first] >= size:
                w = words[hits[first]]
                enough -= held[w] <= own[w]
                held[w] -= 1
                first += 1
            if enough >= self.least:
                if out and hits[first] < out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([hits[first], i + 1])
        return [(a, b) for a, b in out]

    def finds(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, last word, matched) of each alignment that covers enough, in one region one after another."""
        out, todo = [], self.regions(words)
        while todo:
            low, high = todo.pop()
            part = words[low:high]
            if self.needed:
                out += [(low + a, low + b, n) for a, b, n in self._named(part)]
                continue
            for a, b in self._cuts(part):
                pairs = align(part[a:b], list(self.words))
                if len(pairs) >= self.least:
                    out.append((low + a + pairs[0][0], low + a + pairs[-1][0], len(pairs)))
        return sorted(out)

    def _named(self, part: list[str]) -> list[tuple[int, int, int]]:
        """The finds in a region, one at most around each place of the rarest naming word."""
        seen = Counter(part)
        word = min(self.naming, key=lambda w: (seen[w], self.words.index(w)))
        places = [i for i, w in enumerate(part) if w == word]
        out, size = [], 2 * len(self.words)
        for before, at, after in zip([-1, *places], places, [*places[1:], len(part)]):
            low = max(before + 1, at - size, out[-1][1] + 1 if out else 0)
            pairs = align(part[low : min(after, at + size)], list(self.words))
            if len(pairs) >= self.least and {j for _, j in pairs}.issuperset(self.needed):
                out.append((low + pairs[0][0], low + pairs[-1][0], len(pairs)))
        return out

    def _cuts(self, part: list[str]) -> list[tuple[int, int]]:
        """A region cut where the template's most telling word (the rarest in the region) stands again."""
        seen = Counter(w for w in part if w in set(self.words))
        own = Counter(self.words)
        telling = [w for w in dict.fromkeys(self.words) if own[w] == 1 and seen[w]]
        if not telling:
            return [(0, len(part))]
        word = min(telling, key=lambda w: seen[w])
        places = [i for i, w in enumerate(part) if w == word]
        at = self.words.index(word)
        edges = [0, *(max(x + 1, y - at) for x, y in zip(places, places[1:])), len(part)]
        return list(zip(edges, edges[1:]))


MATCH = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("matched", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


def scan_text(text: str, templates: list[Template]) -> list[dict]:
    """The finds of all templates in a whole text, by place, then name."""
    present = set(WORD.findall(text.lower()))
    possible = [t for t in templates if present.issuperset(t.naming) and sum(w in present for w in t.words) >= t.least]
    placed = words_of(text) if possible else []
    words = [w for w, _, _ in placed]
    out = []
    found = [(t, *f) for t in possible for f in t.finds(words)]
    for t, first, last, matched in found:
        if matched < t.full and any(_better(o, (t, first, last, matched)) for o in found):
            continue
        share = matched / len(t.words)
        out.append(dict(license=t.name, start=placed[first][1], end=placed[last][2], matched=matched, coverage=share))
    return sorted(out, key=lambda m: (m["start"], m["license"]))


def _better(a: tuple[Template, int, int, int], b: tuple[Template, int, int, int]) -> bool:
    """Whether find `a` overlaps find `b`, is of the same license by its naming words, and holds more of its template."""
    same = a[1] <= b[2] and b[1] <= a[2] and b[0].naming.issubset(a[0].words)
    rank = lambda f: (f[3] >= f[0].full, f[3], f[3] / len(f[0].words), f[0].name)
    return same and rank(a) > rank(b)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.9, text: str = "text") -> DataFrame:
    """`docs` with licenses: for each place where `coverage` of a template's words or more are found in order, its
    name, start and end (code points), the words matched, and their share. With a coverage below 1, a template of
    five words or more that name a license may lack one word that is not of the name, even if that is less than `coverage`.

    A missing or empty text has none, as has a template without words. Rows stay as they are, repeated ones too; a
    column called licenses is replaced. Templates go to all tasks: they are a list that the caller holds.
    """
    base = without(docs, "licenses")
    given = NOTICES if templates is None else templates
    made = [t for t in (Template.of(n, x, coverage) for n, x in given.items()) if t.words]
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))

    def run(batches):
        for batch, texts in slices(batches, text):
            found = [scan_text(t, made) for t in texts]
            yield extended(batch, licenses=pa.array(found, kind))

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField("licenses", T.ArrayType(MATCH))]))

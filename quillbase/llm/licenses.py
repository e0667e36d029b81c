"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Templates of fewer than SHORT words have too few grams for that: every word of theirs is indexed, and each stretch of a text with
enough of a template's words for the coverage is aligned whole.

Templates are a small table that a task holds whole: an inverted index from the winnowed hashes of
their word grams to (template, place). Every gram of a text is looked up in it. Hits of one template that lie in
order form a candidate, and a local alignment within a band around their diagonals
reports the matched share of the template and the span in the text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words in a gram, grams in a winnowing window, half-width of the band in words, share of a template that must match.
GRAM, WINNOW, BAND, COVERAGE = 4, 4, 12, 0.7
#: Words under which a template is looked for by its single words.
SHORT = 21
#: Bound of the templates, whose index every task holds.
MOST_TEMPLATES = 5_000
WORD = re.compile(rb"[a-z0-9]+")
#: Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL": "This work is licensed under the GNU General Public License",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
MATCH = T.StructType([T.StructField(n, t) for n, t in (("license_id", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("matched", T.IntegerType()), ("words", T.IntegerType()), ("coverage", T.DoubleType()))])


def align(text: list, template: list, low: int, high: int) -> tuple[int, int, int, int]:
    """Score, first, last + 1 and equal words of the best local alignment whose diagonals (place in text - place in template)
    lie in low..high. A match counts 2, a mismatch or gap -1; of equal scores the first to end wins."""
    best, before = (0, 0, 0, 0), {}
    for i in range(len(template)):
        row = {}
        for d in range(low, high + 1):
            j = i + d
            if 0 <= j < len(text):
                same = text[j] == template[i]
                s, a, m = before.get(d, (0, j, 0))  # from the diagonal
                s, m = (s + 2, m + 1) if same else (s - 1, m)
                up, left = before.get(d + 1), row.get(d - 1)
                for other in (up, left):
                    if other is not None and other[0] - 1 > s:
                        s, a, m = other[0] - 1, other[1], other[2]
                if s > 0:
                    row[d] = (s, a, m)
                    if s > best[0]:
                        best = (s, a, j + 1, m)
        before = row
    return best


class Scanner:
    """The templates' index and what to do with a text."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, winnow: int = WINNOW, band: int = BAND, coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.gram, self.band, self.coverage = gram, band, coverage
        self.words = [WORD.findall(templates[n].encode().lower()) for n in self.names]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.templates = [[self.ids[w] for w in t] for t in self.words]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.counts = {k: Counter(t) for k, t in enumerate(self.templates) if len(t) < SHORT}
        post = defaultdict(list)
        for k, c in self.counts.items():
            for w, n in c.items():
                post[w].append((k, n))
        self.post = {w: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for w, found in post.items()}
        for k, t in enumerate(self.templates):
            if k in self.counts:
                continue
            h = self.grams(np.array(t, np.uint64))
            ranks = h * np.uint64(0x9E3779B97F4A7C15)
            chosen = {max(range(i, min(i + winnow, len(h))), key=lambda p: (-int(ranks[p]), p)) for i in range(max(1, len(h) - winnow + 1))} if len(h) else set()
            for p in sorted(chosen):
                self.index[int(h[p])].append((k, p))
        self.known = np.array(sorted(self.index), np.uint64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """One number for each gram: its words' numbers as digits, so that equal numbers are equal grams."""
        n = len(ids) - self.gram + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(self.gram):
            out = out * np.uint64(len(self.ids) + 1) + ids[i : i + len(out)]
        return out

    def short(self, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(template, first, last + 1, equal words) of the short templates' matches, in words.

        A local alignment has fewer than two gaps or mismatches a match, so that it lies within three times the template's length.
        """
        total, seen = np.zeros(len(self.templates), np.int64), Counter(ids)
        for w, n in seen.items():
            if w in self.post:
                ks, most = self.post[w]
                total[ks] += np.minimum(most, n)
        for k in np.flatnonzero(total).tolist():
            t, count = self.templates[k], self.counts[k]
            if total[k] < self.coverage * len(t):
                continue
            at, i = [j for j, w in enumerate(ids) if w in count], 0
            reach = 3 * len(t)
            while i < len(at):
                low = at[i]
                near = Counter(w for w in ids[low : low + reach] if w in count)
                if sum(min(n, count[w]) for w, n in near.items()) < self.coverage * len(t):
                    i += 1
                    continue
                high, found = min(low + 2 * reach, len(ids)), None
                while True:  # the first match
                    _, first, end, same = align(ids[low:high], t, -len(t), high - low)
                    if same < self.coverage * len(t):
                        break
                    found = (k, low + first, low + end, same)
                    high = low + first
                if found and found[1] < low + reach:
                    yield found
                    upto = found[2]
                else:
                    upto = found[1] if found else low + reach
                while i < len(at) and at[i] < upto:
                    i += 1

    def scan(self, text: str | None) -> list[tuple]:
        """(license_id, start, end, matched, words, coverage) of the matches, by start; code points, end exclusive."""
        data = (text or "").encode()
        lower, get = data.lower(), self.ids.get
        ids = [get(w, 0) for w in WORD.findall(lower)]
        found = [*self.short(ids), *self.long(ids)]
        if not found:
            return []
        places = [(m.start(), m.end()) for m in WORD.finditer(lower)]
        out = []
        for k, first, end, same in found:
            start, stop = (len(data[:x].decode()) for x in (places[first][0], places[end - 1][1]))
            out.append((self.names[k], start, stop, same, len(self.templates[k]), same / len(self.templates[k])))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def long(self, ids: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """As short(), of the other templates."""
        if not len(self.known) or len(ids) < self.gram:
            return
        a = np.array(ids, np.uint64)
        h = self.grams(a)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        whole = np.cumsum(np.concatenate(([0], a == 0)))
        hits = np.flatnonzero((self.known[at] == h) & (whole[self.gram :] == whole[: len(h)]))
        if not len(hits):
            return
        by = defaultdict(list)
        for j in hits.tolist():
            for k, p in self.index[int(h[j])]:
                by[k].append((j, p))
        for k, found in by.items():
            t = self.templates[k]
            runs: list[list[tuple[int, int]]] = []
            for j, p in found:  # by place in the text
                if runs and abs((j - p) - (runs[-1][-1][0] - runs[-1][-1][1])) <= self.band and p >= runs[-1][-1][1]:
                    runs[-1].append((j, p))
                else:
                    runs.append([(j, p)])
            last = -1
            for r in runs:
                diagonals = [j - p for j, p in r]
                _, first, end, same = align(ids[max(0, min(diagonals) - self.band) :][: len(t) + max(diagonals) - min(diagonals) + 2 * self.band], t, *[d - max(0, min(diagonals) - self.band) for d in (min(diagonals) - self.band, max(diagonals) + self.band)])
                base = max(0, min(diagonals) - self.band)
                first, end = first + base, end + base
                if same >= self.coverage * len(t) and first >= last:
                    yield k, first, end, same
                    last = end


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """The kept columns of docs (all but the text, unless named) with matches: array of license_id, start, end, matched, words, coverage.

    A null or empty text has no matches. Words are runs of a-z and 0-9, A-Z lower-cased. Equal texts have equal matches. Of one template's overlapping
    matches the first stays; different templates may overlap. Templates of fewer words than a gram are an error, as is a column called matches.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if "matches" in keep:
        raise ValueError("a column is called matches")
    if short := [n for n, t in templates.items() if len(WORD.findall(t.encode().lower())) < options.get("gram", GRAM)]:
        raise ValueError(f"too short: {short}")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("matches", T.ArrayType(MATCH))])
    hidden = common.free_name(docs.select(*keep), "text")
    arrow = pa.list_(pa.struct([("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("words", pa.int32()), ("coverage", pa.float64())]))
    fields = [f.name for f in MATCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, **options)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = [[dict(zip(fields, m, strict=True)) for m in scanner.scan(x.as_py())] for x in batch.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, arrow)], names=schema.names)

    return common.in_arrow(docs.select(*keep, F.col(text).alias(hidden)), run, schema)

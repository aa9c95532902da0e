"""License scans by patience alignment (operator 4).

A template and a text are aligned by the words that are unique in both: the longest increasing subsequence of their places
anchors the alignment, and the gaps between anchors are aligned the same way, after equal words at their ends. Coverage is the
share of the template's words that are aligned. A text is held against a template only where that could reach the
threshold: in windows that have enough of the template's words. Texts stay in their task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices and texts of public licenses.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        "this permission notice appear in all copies.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_words = re.compile(r"[A-Za-z0-9]+")


def words(text: str) -> list[str]:
    return " ".join(_words.findall(text)).lower().split()


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both: the patience alignment of a and b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once = {w for w, n in Counter(a[i:i_end]).items() if n == 1}
        places: dict = {}
        for k in range(j, j_end):
            if b[k] in once:
                places[b[k]] = -1 if b[k] in places else k
        anchors = longest([(k, places[a[k]]) for k in range(i, i_end) if places.get(a[k], -1) >= 0])
        if anchors:
            ends = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            out.extend(anchors)
            todo.extend((p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False))
    return sorted(out)


def longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second places increase, by piles with back pointers."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back[k] = last[pile - 1] if pile else -1
        tops[pile : pile + 1] = [j]
        last[pile : pile + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def trimmed(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs without those at the ends that stand far from the others in the text, though not in the template."""
    low, high = 0, len(pairs)
    far = lambda p, q: q[1] - p[1] > 3 * (q[0] - p[0]) + 1
    while high - low > 1 and far(pairs[low], pairs[low + 1]):
        low += 1
    while high - low > 1 and far(pairs[high - 2], pairs[high - 1]):
        high -= 1
    return pairs[low:high]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        self.threshold = threshold
        self.templates = [(name, words(x)) for name, texts in templates.items() for x in texts]
        self.vocabularies = [frozenset(w) for _, w in self.templates]
        self.known = frozenset().union(*self.vocabularies)

    def scan(self, text: str | None) -> list[dict]:
        """Hits (license, start, end, coverage) in code points, by start; of hits that overlap, the one with most aligned words."""
        if not text or not self.known:
            return []
        tokens = words(text)
        there = self.known.intersection(tokens)
        ways = [k for k, (_, w) in enumerate(self.templates) if sum(x in there for x in w) >= self.threshold * len(w)]
        if not ways:
            return []
        found: list[tuple[int, int, int, str, float]] = []
        for k in ways:
            name, template = self.templates[k]
            need, reach = self.threshold * len(template), len(template) * 3 // 2 + 2
            hits = [i for i, w in enumerate(tokens) if w in self.vocabularies[k]]
            i = 0
            while i < len(hits):
                start = hits[i]
                if bisect_left(hits, start + reach) - i < need:
                    i += 1
                    continue
                pairs = align(template, tokens[start : start + reach])
                if len(pairs) >= need:
                    ahead = start + trimmed(pairs)[0][1]  # without stray words before it, and with room behind it
                    again = trimmed(align(template, tokens[ahead : ahead + 2 * reach]))
                    if len(again) >= need:
                        start, pairs = ahead, again
                    low, high = start + pairs[0][1], start + pairs[-1][1] + 1
                    found.append((len(pairs), low, high, name, len(pairs) / len(template)))
                    i = bisect_left(hits, high)
                else:
                    i += 1
        found.sort(key=lambda x: (-x[0], -x[4], x[1]))
        kept, starts = [], []  # by start; they don't overlap, so only the neighbours of a hit can overlap it
        for x in found:
            at = bisect_left(starts, x[1])
            if not ((at and kept[at - 1][2] > x[1]) or (at < len(kept) and kept[at][1] < x[2])):
                kept.insert(at, x)
                starts.insert(at, x[1])
        if not kept:
            return []
        spans = [m.span() for m in _words.finditer(text)]
        return [{"license": n, "start": spans[a][0], "end": spans[b - 1][1], "coverage": c} for _, a, b, n, c in sorted(kept, key=lambda x: x[1])]


_kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))


def _scanned(scanner, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.value.scan(x.as_py()) for x in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _kind)], names=batch.schema.names)

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, text_col: str = "text", threshold: float = 0.8, out_col: str = "licenses") -> DataFrame:
    """The rows of docs with an array more: (license, start, end, coverage) of each place that covers a template to the threshold.

    Words are runs of ASCII letters and digits, without regard to case. Null and empty texts have no hits. Of places that overlap, the one with
    the most aligned words counts, then the best covered, then the first. Texts are scanned whole, in windows of a template's length and a
    half; repeated rows are scanned one by one; an empty table gives no rows. A column of docs with the new name is replaced.
    """
    docs = docs.drop(out_col)
    out = docs.withColumn(out_col, F.lit(None).cast("array<struct<license: string, start: bigint, end: bigint, coverage: double>>"))
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, threshold))
    return out.mapInArrow(_scanned(scanner, docs.columns.index(text_col)), out.schema)

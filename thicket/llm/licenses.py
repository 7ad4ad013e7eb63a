"""License scan (operator 6) by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest increasing run of anchors is
kept and the gaps between them are aligned in the same way, down to equal ends and, for gaps without anchors, a longest
common subsequence.  Coverage is the share of the template's words that are aligned; where anchors that a repeated license
leaves lead the alignment astray, the longest common subsequence of the whole stretch takes its place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import plain
from .textcore import U64, Words, as_bytes, chunks, in_sorted

COVERAGE = 0.8
#: A template may be stretched to so many times its words.
STRETCH = 2

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_NONE = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_NONE = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details."

#: Texts of short public licenses, and the notices by which long ones are applied, after their published wording.
TEXTS: dict[str, str] = {
    "MIT": f"{_MIT} {_MIT_NONE}",
    "BSD-2-Clause": f"{_BSD} {_BSD_NONE}",
    "BSD-3-Clause": f"{_BSD} {_BSD_NAMES} {_BSD_NONE}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    **{f"{short}GPL-{v}.0": _GPL.format(name, v) for short, name, versions in (("", "", (2, 3)), ("L", "Lesser", (2, 3)), ("A", "Affero", (3,))) for v in versions},
}
#: Names of licenses, of which one-line notices are made.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "Unlicense": ("the Unlicense",),
    "Apache-2.0": ("the Apache License, Version 2.0",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    **{f"BSD-{k}-Clause": (f"the BSD {k}-Clause License", f"the {k}-Clause BSD License") for k in (2, 3)},
    **{f"{short}GPL-{v}.0": (f"the GNU {name} General Public License, version {v}",) for short, name, versions in (("", "", (2, 3)), ("L", "Lesser", (2, 3)), ("A", "Affero", (3,))) for v in versions},
    **{
        f"CC-{code}-{v}.0": (f"CC {code} {v}.0", f"a Creative Commons {name} {v}.0 {where} License")
        for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for v, where in ((3, "Unported"), (4, "International"))
    },
}
NOTICE = ("Licensed under {}.", "Released under {}.")
#: What is looked for: TEXTS, and for each of NAMES its notices, as ``MIT-notice``, ``MIT-notice/2`` and so
#: on; what is found is told without the number.
TEMPLATES: dict[str, str] = TEXTS | {f"{k}-notice" + (f"/{i + 1}" if i else ""): form.format(name) for k, names in NAMES.items() for i, (name, form) in enumerate((n, f) for n in names for f in NOTICE)}
#: Words that say little about a text; others are looked for first.
_COMMON = frozenset(plain(b"the a of to and or in is this that under any it by for with as be on not are version all following use you may at an 2 3 4 0 1").split())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of their first, whose seconds increase."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at], ends[at] = b, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _masks(b: list) -> dict:
    """For every item of b the bits of its places."""
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _rows(a: list, masks: dict, n: int) -> Iterator[int]:
    """For every beginning of a, a bit for each place of the other list of n items: 0 where the longest common subsequence
    grows by that place."""
    every = row = (1 << n) - 1
    for x in a:
        if both := row & masks.get(x, 0):
            row = (row + both | row - both) & every
        yield row


def _common_length(a: list, masks: dict, n: int) -> int:
    row = (1 << n) - 1
    for row in _rows(a, masks, n):  # noqa: B007
        pass
    return n - row.bit_count()


def _common(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of any length, with a bit for every pair of places."""
    rows = [(1 << len(b)) - 1, *_rows(a, _masks(b), len(b))]
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif rows[i - 1] >> j - 1 & 1:
            i, j = i - 1, j - 1
            out.append((a0 + i, b0 + j))
        else:
            i -= 1
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal items, increasing in both lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
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
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if na[x] == 1 and x in place])
        if not anchors:
            out += _common(a[a0:a1], b[b0:b1], a0, b0)
            continue
        out += anchors
        for (i, j), (k, l) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, l))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.names = sorted(templates)
        texts = [plain(templates[k].encode()) for k in self.names]
        words = Words(texts, lower=True)
        self.words = [words.of(words.hashes, i) for i in range(len(self.names))]
        self.lists = [w.tolist() for w in self.words]
        self.masks = [_masks(w) for w in self.lists]
        self.vocabulary = [np.unique(w) for w in self.words]
        self.need = [int(np.ceil(coverage * len(w))) for w in self.words]
        # a text without any of these words of a template lacks more of it than it may
        self.triggers: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            spelt = text.lower().split()
            count = Counter(self.lists[k])
            left = len(spelt) - self.need[k] + 1
            for h in sorted(count, key=lambda h: (spelt[self.lists[k].index(h)] in _COMMON, -len(spelt[self.lists[k].index(h)]), h)):
                if left <= 0:
                    break
                left -= count[h]
                self.triggers.setdefault(h, []).append(k)
        self.first = np.array(sorted(self.triggers), U64)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.first >> U64(46)).astype(np.int64)] = True

    def regions(self, places: np.ndarray, k: int, n: int) -> list[tuple[int, int]]:
        """Stretches of a text where enough words of template k are within STRETCH times its length, one for every word that
        such a stretch may begin with: they overlap and are never merged, so that each holds a few repetitions at most."""
        size = len(self.words[k])
        need, reach = self.need[k], STRETCH * size
        if len(places) < need or not need:
            return []
        begins = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < reach)
        return [(max(0, a - size), min(n, a + reach + size)) for a in places[begins].tolist()]

    def best(self, text: np.ndarray, places: np.ndarray, k: int) -> tuple[str, float, int, int, int] | None:
        """The first of the best stretches for template k, if it is covered well enough."""
        size, template = len(self.lists[k]), self.lists[k]
        best = None
        most = self.need[k] - 1
        length, end = 0, 0
        for low, high in self.regions(places, k, len(text)):
            # every word that comes in adds one at most
            if length + high - end <= most:
                continue
            window = text[low:high].tolist()
            length, end = _common_length(window, self.masks[k], size), high
            if length > most:
                pairs = patience(window, template)
                if len(pairs) < length:
                    pairs = _common(window, template, 0, 0)
                most = length
                best = (self.names[k], length / size, low + pairs[0][0], low + pairs[-1][0] + 1, length)
                if length == size:
                    break
        return best

    def told_apart(self, text: np.ndarray, found: dict[int, tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Findings by template, the most aligned words first, then the larger coverage, then by name.  One is told if none
        before it overlaps it, is of its license, or aligns with its stretch as well."""
        out: dict[int, tuple[str, float, int, int]] = {}
        for k, x in sorted(found.items(), key=lambda kx: (-kx[1][4], -kx[1][1], kx[1][0])):
            name, stretch = x[0].partition("/")[0], text[x[2] : x[3]].tolist()
            if all(name != y[0] and (x[3] <= y[2] or x[2] >= y[3]) and _common_length(stretch, self.masks[j], len(self.lists[j])) < x[4] for j, y in out.items()):
                out[k] = (name, *x[1:4])
        return sorted(out.values())

    def scan(self, texts: list[bytes]) -> Iterator[list[tuple[str, float, int, int]]]:
        for a, b in chunks(texts):
            words = Words([plain(t) for t in texts[a:b]], lower=True)
            hits = np.flatnonzero(self.maybe[(words.hashes >> U64(46)).astype(np.int64)])
            hits = hits[in_sorted(words.hashes[hits], self.first)]
            cut = np.searchsorted(hits, words.first)
            for i in range(b - a):
                found, text = {}, words.hashes[:0]
                if cut[i + 1] > cut[i]:
                    text = words.of(words.hashes, i)
                    asked = {k for h in set(words.hashes[hits[cut[i] : cut[i + 1]]].tolist()) for k in self.triggers[h]}
                    for k in sorted(asked):
                        if len(text) >= self.need[k] and (best := self.best(text, np.flatnonzero(in_sorted(text, self.vocabulary[k])), k)):
                            found[k] = best
                yield self.told_apart(text, found)


_OUT = "doc_id long, license string, coverage double, start_word long, end_word long"


def _scan(batches: Iterable[pa.RecordBatch], templates: dict[str, str], coverage: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, coverage)
    for batch in batches:
        rows = [(d, *x) for d, found in zip(batch.column("doc_id").to_pylist(), scanner.scan(as_bytes(batch.column("text"))), strict=True) for x in found]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word) of every template that a text of docs(doc_id, text) covers by
    ``coverage`` or more, once each, at the first of its best stretches; of templates that overlap in a text only the one
    with the most aligned words is told.

    Words are compared without ASCII case and punctuation.  Null and empty texts give no rows, repeated rows repeat theirs,
    a null doc_id stays null; templates without words are never found; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, templates=templates or TEMPLATES, coverage=coverage), _OUT)

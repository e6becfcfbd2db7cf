"""License scans by patience alignment of texts with license notices and texts.

Words that are unique both in the template and in the window of text under test are anchors; the
longest run of anchors that ascends in both is kept, and the gaps between them are aligned the
same way. The share of the template's words that align is its coverage.

A template's phrases in braces, which name the license and its version, must stand in the text
word for word; the rest may miss up to 1 - COVERAGE of the template's words. Windows are opened
where a template's first phrase stands. One without a phrase can only reach the wanted coverage if
one of its seed words is there: its longest words, as many as exceed what may be missing. So all
texts are scanned whole at little cost and no notice of that coverage is lost to the filter. Between two
phrases of a template no more than JUMP words may stand that align with nothing, so that no notice reaches
over another. Of notices that overlap, the one with the most words aligned is reported, unless the words
that lead up to it deny it ("not licensed under the").

Defined cases: a null or empty text has no notice; a notice that a document holds several times
gives a row each time; rows that share a doc_id, or repeat each other, are scanned each; nothing is
found in an empty table; other columns are ignored. Case and punctuation don't count. A very long
text is scanned whole, with windows of the templates' sizes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.text_batches import slices, text_column

COVERAGE = 0.8
WORD = regex.compile(r"[\p{L}\p{N}]+")
COLUMNS = "doc_id long, license string, template string, start_word long, end_word long, matched int, coverage double"

# Notices and texts of public licenses, (license, template, text).
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software."""
_BSD_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = f"""{_BSD_USE}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = [("GPL", "2", "2.0", "June 1991"), ("GPL", "3", "3.0", "29 June 2007"), ("LGPL", "2.1", "2.1", "February 1999"), ("LGPL", "3", "3.0", "29 June 2007"), ("AGPL", "3", "3.0", "19 November 2007")]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_SPDX = ["MIT", "ISC", "Unlicense", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", *(f"{k}-{spdx}" for k, _, spdx, _ in _GNU_VERSIONS), *(f"CC-{k}-{v}" for k in _CC for v in _CC_VERSIONS)]
TEMPLATES = [
    *((spdx, "identifier", f"{{SPDX-License-Identifier: {spdx}}}") for spdx in _SPDX),
    *(("Apache-2.0", "line", f"{{{name}}}") for name in ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("Apache-2.0", "title", "{Apache License Version 2.0, January 2004}"),
    ("Apache-2.0", "header", """Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    *((name, "line", f"{{{name} License}}") for name in ("MIT", "ISC")),
    ("MIT", "grant", _GRANT),
    ("MIT", "text", f"{_GRANT} {_WARRANTY}"),
    ("ISC", "text", f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"""),
    ("Unlicense", "text", _UNLICENSE),
    ("MPL-2.0", "notice", """This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "title", "{Mozilla Public License Version 2.0}"),
    ("BSD-2-Clause OR BSD-3-Clause", "line", _BSD_USE),
    ("BSD-2-Clause", "text", f"{_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", "text", f"{_BSD_TWO} {{Neither the name of}} {_BSD_THREE.removeprefix('3. Neither the name of')} {_BSD_END}"),
    *((f"BSD-{n}-Clause", "line", f"{{BSD {n} Clause}}") for n in (2, 3)),
    *((f"{k}-{spdx}", "line", f"{{{_GNU[k]}}}, {{version {v}}}") for k, v, spdx, _ in _GNU_VERSIONS),
    *((f"{k}-{spdx}", "line", f"{{{_GNU[k]} v{v}}}") for k, v, spdx, _ in _GNU_VERSIONS),
    *((f"{k}-{spdx}", "title", f"{{{_GNU[k]} Version {v}, {date}}}") for k, v, spdx, date in _GNU_VERSIONS),
    *((f"{k}-{spdx}", "notice", f"""This program is free software: you can redistribute it and/or modify it under the terms of the {{{_GNU[k]}}} as published by the
Free Software Foundation, either {{version {v}}} of the License, or (at your option) any later version.""") for k, v, spdx, _ in _GNU_VERSIONS),
    *((f"CC-{k}-{v}", "line", f"{{CC {k} {v}}}") for k in _CC for v in _CC_VERSIONS),
    *((f"CC-{k}-{v}", "name", f"{{Creative Commons {name} {v}}}") for k, name in _CC.items() for v in _CC_VERSIONS),
    *((f"CC-{k}-4.0", "work", f"This work is licensed under a {{Creative Commons {name} 4.0 International}} License.") for k, name in _CC.items()),
]
#: What may stand between a denial and the notice that it denies.
LINKS = frozenset("licensed released distributed published available covered offered provided under by the a an terms of any".split())
DENIALS = frozenset(("not", "never"))
#: Words that align with nothing between two required phrases, besides half of what the template has there.
JUMP = 3


def denied(text: list[str], start: int) -> bool:
    """Whether a notice's words are led up to by a denial: "not licensed under the"."""
    while start and text[start - 1] in LINKS:
        start -= 1
    return start > 0 and (text[start - 1] in DENIALS or text[max(0, start - 2) : start] in (["isn", "t"], ["aren", "t"]))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ascending(values: list[int]) -> list[int]:
    """Positions of a longest strictly ascending subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending in both, with a[i] == b[j]."""
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
        of_a, of_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, at[a[i]]) for i in range(a0, a1) if of_a[a[i]] == 1 and of_b.get(a[i]) == 1]
        kept = [anchors[k] for k in ascending([j for _, j in anchors])]
        out += kept
        if kept:
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Template:
    def __init__(self, license: str, name: str, text: str, coverage: float):
        self.license, self.name, self.words, self.coverage = license, name, words(text), coverage
        #: (first word, end) of the phrases that must stand word for word
        self.phrases: list[tuple[int, int]] = []
        at = 0
        for k, part in enumerate(regex.split(r"[{}]", text)):
            n = len(words(part))
            if k % 2:
                self.phrases.append((at, at + n))
            at += n
        n = len(self.words)
        missing = int(n * (1 - coverage) + 1e-9)
        self.slack = n // 2 + 2
        self.seeds: dict[str, list[int]] = {}
        if self.phrases:
            self.seeds[self.words[self.phrases[0][0]]] = [self.phrases[0][0]]
            return
        taken = 0
        for i in sorted(range(n), key=lambda i: (-len(self.words[i]), i)):
            if taken > missing and self.words[i] not in self.seeds:
                continue
            self.seeds.setdefault(self.words[i], []).append(i)
            taken += 1

    def pattern(self) -> str:
        """Matches every text that a window can be opened in."""
        if self.phrases:
            lo, hi = self.phrases[0]
            hi = min(hi, lo + 3)  # many notices begin alike, and the expression must stay small
            return r"[^\p{L}\p{N}]+".join(map(regex.escape, self.words[lo:hi]))
        return "|".join(sorted(map(regex.escape, self.seeds)))

    def aligned(self, text: list[str], p: int, q: int, first: int) -> list[tuple[int, int]]:
        """Pairs of word q of the template standing at word p of the text, none before word `first`."""
        n = len(self.words)
        lo, hi = max(first, p - q - self.slack), min(len(text), p - q + n + self.slack)
        if not self.phrases:
            return [(i, j + lo) for i, j in align(self.words, text[lo:hi])]
        a, b = self.phrases[0]  # anchored where it stands; what is before and after it aligns on its own
        if text[p : p + b - a] != self.words[a:b]:
            return []
        pairs = [(i, j + lo) for i, j in align(self.words[:a], text[lo:p])]
        pairs += [(i, p + i - a) for i in range(a, b)]
        for a, b in self.phrases[1:]:  # the next phrase stands where it comes first
            end, since = pairs[-1][0] + 1, pairs[-1][1] + 1
            at = next((j for j in range(since, hi - (b - a) + 1) if text[j : j + b - a] == self.words[a:b]), None)
            if at is None:
                return []
            between = align(self.words[end:a], text[since:at])
            if at - since - len(between) > JUMP + (a - end) // 2:  # what stands between is of something else
                return []
            pairs += [(i + end, j + since) for i, j in between]
            pairs += [(i, at + i - a) for i in range(a, b)]
        end, since = pairs[-1][0] + 1, pairs[-1][1] + 1
        return pairs + [(i + end, j + since) for i, j in align(self.words[end:], text[since:hi])]

    def find(self, text: list[str], at: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, words aligned) of each notice. at: where seed words stand."""
        done = -1
        for p in at:
            if p <= done:
                continue
            best: tuple[int, int, int] | None = None
            for q in self.seeds[text[p]]:
                pairs = self.aligned(text, p, q, done + 1)
                if pairs and len(pairs) >= self.coverage * len(self.words) - 1e-9 and (best is None or len(pairs) > best[2]):
                    best = (pairs[0][1], pairs[-1][1] + 1, len(pairs))
            if best:
                done = best[1] - 1
                yield best


def best_of_overlaps(found: list[tuple[Template, int, int, int]]) -> list[tuple[Template, int, int, int]]:
    """Of notices that share words, the one with the most words aligned, then the best covered."""
    starts: list[int] = []
    kept: list[tuple[Template, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[3], len(x[0].words) - x[3], x[1])):
        k = bisect_left(starts, x[1])
        if (k and kept[k - 1][2] > x[1]) or (k < len(kept) and starts[k] < x[2]):
            continue
        starts.insert(k, x[1])
        kept.insert(k, x)
    return kept


def scan(texts: list[str], templates: list[Template]) -> Iterator[tuple[int, Template, int, int, int]]:
    """(text number, template, first word, end, words aligned)."""
    for k, text in enumerate(texts):
        own = words(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            places.setdefault(w, []).append(i)
        found = []
        for t in templates:
            at = sorted(i for s in t.seeds for i in places.get(s, ()))
            found += [(t, *x) for x in t.find(own, at)]
        for x in best_of_overlaps(found):
            if not denied(own, x[1]):
                yield (k, *x)


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """A row for each notice found in each document; a scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Template(*t, coverage) for t in templates]
        any_seed = "|".join(sorted({t.pattern() for t in own}))
        for batch in batches:
            for part in slices(batch):
                texts = pc.utf8_lower(text_column(part))
                hit = pc.match_substring_regex(texts, any_seed)
                ids, some = part.column(0).filter(hit), texts.filter(hit).to_pylist()
                rows = list(scan(some, own))
                cols = [ids.take(pa.array([r[0] for r in rows], pa.int64()))]
                cols += [pa.array([r[1].license for r in rows], pa.string()), pa.array([r[1].name for r in rows], pa.string())]
                cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)]
                cols += [pa.array([r[4] for r in rows], pa.int32()), pa.array([r[4] / len(r[1].words) for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)

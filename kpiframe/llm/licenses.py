"""Licence scans by patience alignment.

A template is aligned to a stretch of text on the words that occur once in both: the longest
increasing subsequence of their positions anchors the alignment, and the gaps between anchors
are aligned in the same way. The share of the template's words that are aligned is its
coverage.

A word that is unique in a stretch need not be in the whole text, and a text can hold a
template twice, so stretches of the template's size are aligned, not whole texts. A stretch
that holds too few of the template's words for the coverage asked for is left out, which
loses no match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: least coverage that is reported
COVERAGE = 0.8
#: a match may be longer than its template by this factor, and by this many words
STRETCH, SLACK = 1.25, 2

# --- fixed values: public licence texts without their copyright lines, headers and notices ---
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and "
                      "related or neighboring rights to this work.",
    "proprietary notice": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
           "software and associated documentation files (the \"Software\"), to deal in the "
           "Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
           "and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be "
           "included in all copies or substantial portions of the Software. THE SOFTWARE IS "
           "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
           "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
           "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
           "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
           "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
           "OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
           "or without fee is hereby granted, provided that the above copyright notice and this "
           "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE "
           "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
           "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
           "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
           "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
           "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
           "PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met: 1. Redistributions of "
                    "source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. 2. Redistributions in binary form must reproduce the above "
                    "copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution. THIS SOFTWARE "
                    "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
                    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
                    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
                    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
                    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
                    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
                    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
                    "DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met: 1. Redistributions of "
                    "source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. 2. Redistributions in binary form must reproduce the above "
                    "copyright notice, this list of conditions and the following disclaimer in the "
                    "documentation and/or other materials provided with the distribution. 3. Neither the "
                    "name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written "
                    "permission. THIS SOFTWARE "
                    "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
                    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
                    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
                    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
                    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
                    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
                    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
                    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
                    "DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no "
            "event will the authors be held liable for any damages arising from the use of this "
            "software. Permission is granted to anyone to use this software for any purpose, "
            "including commercial applications, and to alter it and redistribute it freely, subject "
            "to the following restrictions: 1. The origin of this software must not be "
            "misrepresented; you must not claim that you wrote the original software. If you use "
            "this software in a product, an acknowledgment in the product documentation would be "
            "appreciated but is not required. 2. Altered source versions must be plainly marked as "
            "such, and must not be misrepresented as being the original software. 3. This notice "
            "may not be removed or altered from any source distribution.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
                         "not use this file except in compliance with the License. You may obtain a "
                         "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                         "required by applicable law or agreed to in writing, software distributed "
                         "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
                         "OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                         "the specific language governing permissions and limitations under the "
                         "License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under "
                      "the terms of the GNU General Public License as published by the Free Software "
                      "Foundation, either version 3 of the License, or (at your option) any later "
                      "version. This program is distributed in the hope that it will be useful, but "
                      "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                      "FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, "
                      "v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                      "obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is "
                 "free to copy, modify, publish, use, compile, sell, or distribute this software, "
                 "either in source code form or as a compiled binary, for any purpose, commercial or "
                 "non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
                 "the author or authors of this software dedicate any and all copyright interest in "
                 "the software to the public domain. We make this dedication for the benefit of the "
                 "public at large and to the detriment of our heirs and successors. We intend this "
                 "dedication to be an overt act of relinquishment in perpetuity of all present and "
                 "future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS "
                 "IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
                 "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                 "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
                 "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
                 "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
                 "SOFTWARE.",
}
# --- end of fixed values ---

_PARTS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; NULL has none."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTS).split()


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) that rises in the second, by
    patience sorting: piles end in their least second, each card knows the pile before it."""
    tops: list[int] = []
    cards: list[int] = []
    before: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            cards.append(i)
        else:
            tops[pile], cards[pile] = y, i
        before.append(cards[pile - 1] if pile else -1)
    out = []
    i = cards[-1] if cards else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal words, rising in both. Common beginnings and ends of a gap
    are aligned first, then its anchors; a gap without an anchor stays open."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _rising([(i, at[w]) for i, w in enumerate(a[a0:a1], a0)
                           if once_a[w] == 1 and w in at])
        if not anchors:
            continue
        for i, j in anchors:
            gaps.append((a0, i, b0, j))
            out.append((i, j))
            a0, b0 = i + 1, j + 1
        gaps.append((a0, a1, b0, b1))
    return sorted(out)


@dataclass
class Template:
    name: str
    words: list[bytes]
    coverage: float

    def __post_init__(self):
        n = len(self.words)
        self.needed = max(1, int(np.ceil(self.coverage * n - 1e-9)))
        self.longest = int(n * STRETCH) + SLACK
        self.counts = Counter(self.words)
        # a match lacks at most n - needed words, so it has one of any n - needed + 1; long
        # words are the rarest in prose
        marks: list[bytes] = sorted(self.words, key=lambda w: (-len(w), w))
        self.marks = frozenset(marks[:n - self.needed + 1])

    def matches(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(aligned words, first word, end word) of the best stretch around each place where
        the text holds enough of the template's words; stretches do not overlap."""
        n = len(text)
        hits = np.concatenate([[0], np.cumsum(np.fromiter(map(self.counts.__contains__, text),
                                                          np.int64, n))])
        # every match of at most `longest` words lies in a stretch of twice as many
        step, width = self.longest, 2 * self.longest
        found = []
        stretches = [(a, min(n, a + width)) for a in range(0, max(1, n - step), step)]
        while stretches:
            a, b = stretches.pop()
            best = self._best(text, a, b) if hits[b] - hits[a] >= self.needed else None
            if best:
                found.append(best)
                stretches += [(a, best[1]), (best[2], b)]
        out: list[tuple[int, int, int]] = []
        for match in sorted(set(found), key=lambda m: (-m[0], m[1])):
            if all(match[2] <= first or end <= match[1] for _, first, end in out):
                out.append(match)
        return sorted(out, key=lambda m: m[1])

    def _best(self, text: list[bytes], a: int, b: int) -> tuple[int, int, int] | None:
        """The best alignment in text[a:b]: each place where one of the marks stands is tried
        as part of the match, with as many words before and after as a match can have. The
        marks are the template's words that are the rarest in the stretch: a word that fills
        it is none, and a stretch without some of them is left out."""
        here = Counter(w for w in text[a:b] if w in self.counts)
        if sum(min(here[w], c) for w, c in self.counts.items()) < self.needed:
            return None
        rarest = sorted(self.words, key=lambda w: (here[w], -len(w), w))
        marks = frozenset(rarest[:len(self.words) - self.needed + 1])
        best = None
        for i in range(a, b):
            if text[i] not in marks:
                continue
            # all that a match with this word can hold, and shorter windows, in which words
            # that stand twice in the longer one may be unique
            windows = {(i - self.longest + 1, i + self.longest)} | {
                (i - k, i - k + self.longest) for k in range(0, self.longest, -(-self.longest // 4))}
            for low, high in sorted(windows):
                found = self._run(text, max(a, low), min(b, high))
                if found and (best is None or (found[0], best[2] - best[1])
                              > (best[0], found[2] - found[1])):
                    best = found
            if best and best[0] == len(self.words) == best[2] - best[1]:
                break
        return best


    def _run(self, text: list[bytes], low: int, high: int) -> tuple[int, int, int] | None:
        """The longest run of aligned words of text[low:high] that fits into the greatest
        length, if it has enough."""
        pairs = patience(self.words, text[low:high])
        best, first = None, 0
        for last in range(len(pairs)):
            while pairs[last][1] - pairs[first][1] >= self.longest:
                first += 1
            match = (last - first + 1, low + pairs[first][1], low + pairs[last][1] + 1)
            if match[0] >= self.needed and (best is None or (match[0], best[2] - best[1])
                                            > (best[0], match[2] - match[1])):
                best = match
        return best


def scan(text: list[bytes], templates: list[Template]) -> list[tuple[str, int, int, int, int]]:
    """(template, its words, aligned words, first word, end word) of every match."""
    have = set(text)
    return [(t.name, len(t.words), *match) for t in templates if not t.marks.isdisjoint(have)
            for match in t.matches(text)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """One row per document row and place that holds a licence text: doc_id, license (the
    template's name), n_words (of the template), n_aligned, coverage (n_aligned / n_words, at
    least ``coverage``), first_word, end_word and best (no other template aligns more words
    there).

    Words are lower-cased and free of ASCII punctuation. A NULL or empty text holds nothing;
    documents without a match have no row; repeated rows are reported each. Templates are a
    parameter of the size of a licence list; those without a word are an error.
    """
    ready = [Template(name, words(text), coverage)
             for name, text in (TEMPLATES if templates is None else templates).items()]
    if not all(t.words for t in ready):
        raise ValueError("a template needs a word")
    kind = ("doc_id long, license string, n_words long, n_aligned long, coverage double, "
            "first_word long, end_word long, best boolean")
    names = [c.split()[0] for c in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(),
             pa.bool_()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = scan(words(text.as_py()), ready)
                for name, n, aligned, a, b in found:
                    best = not any(x > aligned and first < b and a < end
                                   for _, _, x, first, end in found)
                    rows.append((doc_id, name, n, aligned, aligned / n, a, b, best))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, kind)

"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Each template is a sequence of normalised words (A-Z lower-cased, punctuation at the ends trimmed). Of each window of
WINDOW successive K-grams the one with the smallest hash is kept (of templates of up to SHORT words, every one); these
fingerprints form an inverted index from hash to (template, position). All K-grams of a document probe it. Hits of a template that lie close in the document and on close
diagonals make a candidate region, and an alignment within BAND words of the diagonal gives the template words that
match in order, their share of the template (coverage) and the span in the document.

Defined results. A null or empty text has no match. Texts are scanned whole. Of overlapping matches in a document the one
with more matched words stays, then the higher coverage, then the earlier name. Repeated rows and null ids each report
their matches; an empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, tidy
from .text import mix, pieces, plain, span_hashes, word_bounds

K, WINDOW, BAND = 3, 4, 8
#: Words of a template up to which it keeps all fingerprints: one or two changed words leave it no whole window.
SHORT = 24

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:'
_BSD_TWO = 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'

#: The notices of widely used public licenses, and the whole texts of the short ones (`-text`).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": f"{_BSD} {_BSD_TWO} {_BSD_AS_IS}",
    "BSD-3-Clause": _BSD,
    "BSD-3-Clause-text": f"{_BSD} {_BSD_TWO} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": _ISC,
    "ISC-text": f'{_ISC} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": "Released under the MIT License.",
    "MIT-notice": _MIT,
    "MIT-text": f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_TRIM = np.zeros(256, dtype=bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray):
    """Hashes, starts and ends of the words of all rows, trimmed of ASCII punctuation, and each row's first word."""
    starts, ends, first = word_bounds(raw, offsets)
    a, b = starts.copy(), ends.copy()
    for _ in range(4):
        a += (b - a > 1) & _TRIM[raw[np.minimum(a, len(raw) - 1)]] if len(a) else 0
        b -= (b - a > 1) & _TRIM[raw[b - 1]] if len(b) else 0
    return span_hashes(raw, a, b), a, b, first


def grams(words: np.ndarray) -> np.ndarray:
    n = len(words) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(K):
        out += words[j : n + j] * np.uint64((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(out)


class Index:
    """Fingerprints of the templates, sorted by hash, with (template, position)."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, posts = sorted(templates), [], []
        for t, name in enumerate(self.names):
            raw, off = plain(pa.array([templates[name]]))
            words = word_hashes(raw, off)[0]
            self.words.append(words.tolist())
            g = grams(words)
            window = WINDOW if len(words) > SHORT else 1
            chosen = {int(a + np.lexsort((-np.arange(len(w)), w))[0]) for a in range(max(1, len(g) - window + 1)) if len(w := g[a : a + window])}
            posts += [(int(g[p]), t, p) for p in chosen]
        posts.sort()
        self.hash = np.array([h for h, _, _ in posts], np.uint64)
        self.post = [(t, p) for _, t, p in posts]

    def hits(self, g: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, diagonal, position in the document) of each fingerprint found."""
        if not len(g) or not len(self.hash):
            return []
        lo, hi = np.searchsorted(self.hash, g, "left"), np.searchsorted(self.hash, g, "right")
        return [(self.post[j][0], int(i) - self.post[j][1], int(i)) for i in np.flatnonzero(hi > lo) for j in range(lo[i], hi[i])]


def align(template: list[int], doc: list[int], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order within band words of the diagonal, and the first and last document word matched.

    Among alignments with as many matches, the one that starts nearest to the diagonal is taken, then the later and shorter.
    """
    best: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(template):
        now, left = {}, (0, 0, 0)
        for j in range(max(0, i + shift - band), min(len(doc), i + shift + band + 1)):
            got = max(best.get(j, (0, 0, 0)), left)
            if doc[j] == w:
                n, start, _ = best.get(j - 1, (0, 0, 0)) if j - 1 in best else (0, 0, 0)
                got = max(got, (n + 1, start if n else j, -j))
            now[j] = left = got
        best = {**{j: v for j, v in best.items() if j < min(now, default=0)}, **now} if now else best
    n, start, end = max(best.values(), key=lambda v: (v[0], -abs(v[1] - shift), v[1], v[2]), default=(0, 0, 0))
    return n, start, -end


def scan(words: np.ndarray, index: Index, least: float) -> list[tuple[str, int, int, int, int]]:
    """(template, matched words, template words, first word, last word) of a document's matches."""
    found = []
    hits = sorted(index.hits(grams(words)))
    # regions tried, in cells as wide as regions are alike: a cell holds one at most
    tried: dict[tuple[int, int, int], tuple[int, int]] = {}
    wide = BAND // 2 + 1
    for t, shift, at in hits:
        long = len(index.words[t]) + 1
        x, y = shift // wide, at // long
        around = [tried[c] for c in ((t, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if c in tried]
        if any(abs(shift - s) < wide and abs(at - a) < long for s, a in around):
            continue
        tried[t, x, y] = (shift, at)
        a, b = max(0, shift - BAND), min(len(words), shift + len(index.words[t]) + BAND + 1)
        doc = words[a:b].tolist()
        n, start, end = align(index.words[t], doc, shift - a)
        if n >= least * len(index.words[t]):
            found.append((index.names[t], n, len(index.words[t]), a + start, a + end))
    return apart(found)


def apart(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Of overlapping matches the one with more matched words, then the higher coverage, then the earlier name; in order."""
    out: list = []
    starts: list[int] = []
    for m in sorted(found, key=lambda m: (-m[1], -m[1] / m[2], m[0], m[3])):
        i = bisect.bisect(starts, m[4])  # those before i begin within or before the match
        if i == 0 or out[i - 1][4] < m[3]:
            starts.insert(i, m[3])
            out.insert(i, m)
    return out


_SHAPE = "doc_id long, license string, matched_words int, template_words int, coverage double, start_pos long, end_pos long"


def _run(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        marks = set(index.hash.tolist())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw_all, off_all = plain(batch.column(1))
            rows: list[tuple] = []
            for x, y in pieces(off_all):
                raw, off = raw_all[off_all[x] : off_all[y]], off_all[x : y + 1] - off_all[x]
                words, a, b, first = word_hashes(raw, off)
                g = grams(words)
                hit = np.flatnonzero(np.isin(g, index.hash)) if marks else np.zeros(0, np.int64)
                for d in np.unique(np.searchsorted(first, hit, side="right") - 1).tolist():
                    own = slice(first[d], first[d + 1])
                    matches = scan(words[own], index, least)
                    points = np.cumsum((raw[off[d] : off[d + 1]] & 0xC0) != 0x80) if matches else None  # code points up to each byte
                    for name, n, size, s, e in matches:
                        at, to = a[own][s] - off[d], b[own][e] - off[d]
                        rows.append((ids[x + d], name, n, size, n / size, int(points[at]) - 1, int(points[to - 1])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in _SHAPE.split(", ")])

    return run


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, matched_words, template_words, coverage, start_pos, end_pos (code points). No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(dict(templates or TEMPLATES))  # the templates: their size doesn't depend on the data
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(_run(sent, least)), _SHAPE)

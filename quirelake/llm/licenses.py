"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of ASCII letters and digits and of any other character beyond ASCII, in lower case.
Every k consecutive words are hashed and the smallest hash of each ``WINDOW`` of them is kept
(winnowing), so a shared passage of K + WINDOW - 1 words always shares a fingerprint. Templates' fingerprints are an
inverted index (bounded by the templates, so it travels with the task); seeds on nearby diagonals become one
candidate, which is aligned within a band and reported with matched coverage and span. Candidates of one template that
are too short alone (text put in or left out between them) are chained before the coverage test.
No shuffle: each document is scanned where it is read.

The band is a fifth of the template's words, so that it grows with the template and repeated short notices stay apart.

Cases: null or empty text has no match; parts of a template below ``min_coverage`` give no row (a lower one reports them); a text can match several templates, or one several times;
templates shorter than K + WINDOW - 1 words are refused; repeated rows are scanned each; spans count
characters of the text as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, text_bytes

K = 3
WINDOW = 3
MIN_COVERAGE = 0.8

#: Texts of common license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _words(column: pa.Array) -> Words:
    raw, rows = text_bytes(column)
    return Words(pa.StringArray.from_buffers(len(column), pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(_PLAIN[raw])), lower=True)


def winnow(hashes: np.ndarray, inside: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every ``window`` neighbours (the rightmost of equals).

    Hashes that are not ``inside`` a text never win and end its last window early.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.concatenate((np.where(inside, hashes, top), np.full(window - 1, top)))
    at, width = np.arange(len(value)), 1

    def later(at: np.ndarray, by: int) -> np.ndarray:
        """The smaller of each window and the one ``by`` further on."""
        here, there = at[: len(at) - by], at[by:]
        return np.where(value[there] <= value[here], there, here)

    while 2 * width <= window:
        at, width = later(at, width), 2 * width
    at = later(at, window - width) if window > width else at
    at = np.unique(at[at < n])
    return at[inside[at]]


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment within ``band`` of ``diagonal`` (text index less template index).

    Returns matched words, and first and last matched text index (or -1, -1).
    """
    width = 2 * band + 1
    score, place = np.zeros(width, np.int64), np.arange(width)
    best = (0, 0, -1, -1)
    state = np.zeros((width, 3), np.int64)  # matched, first, last
    state[:, 1:] = -1
    for j in range(len(template)):
        at = j + diagonal + np.arange(-band, band + 1)
        ok = (at >= 0) & (at < len(text))
        same = ok & (text[np.clip(at, 0, len(text) - 1)] == template[j])
        step = np.where(same, score + 2, score - 1)
        new = state.copy()
        new[same, 0] += 1
        fresh = same & (new[:, 1] < 0)
        new[fresh, 1] = at[fresh]
        new[same, 2] = at[same]
        above = np.append(score[1:] - 1, np.iinfo(np.int64).min // 2)  # template word without partner
        take = above > step
        moved = np.vstack([state[1:], [0, -1, -1]])
        step, new = np.where(take, above, step), np.where(take[:, None], moved, new)
        reach = np.maximum.accumulate(step + place)  # text words without partner
        new = new[np.maximum.accumulate(np.where(step + place == reach, place, 0))]
        step = reach - place
        low = step <= 0
        step[low] = 0
        new[low] = (0, -1, -1)
        score, state = step, new
        top = int(score.argmax())
        if (int(score[top]), int(state[top, 0])) > best[:2]:
            best = (int(score[top]), *map(int, state[top]))
    return best[1], best[2], best[3]


def chained(parts: set[tuple[int, int, int, int]], size: int, least: float) -> Iterator[tuple[int, int, int]]:
    """Matches (matched words, first, last) of at least ``least`` words made of partial ones (first, last, matched, diagonal).

    Parts follow each other in the text and in the template, at most ``size`` words of the text apart; template words that
    two neighbours may both have matched count once.
    """
    left = sorted(parts)
    while left:
        best: list[tuple[int, list[int]]] = []
        for j, (first, last, n, diagonal) in enumerate(left):
            top = (n, [j])
            for i in range(j):
                begin, end, _, other = left[i]
                twice = max(0, end - other - (first - diagonal) + 1)
                if end < first <= end + 1 + size and first - diagonal > begin - other and last - diagonal > end - other:
                    top = max(top, (best[i][0] + n - twice, [*best[i][1], j]), key=lambda x: x[0])
            best.append(top)
        n, used = max(best, key=lambda x: x[0])
        if n < least:
            return
        first, last = left[used[0]][0], left[used[-1]][1]
        yield min(n, size), first, last
        left = [p for p in left if p[1] < first or p[0] > last]


class _Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        w = _words(pa.array(list(templates.values()), pa.string()))
        self.words = [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        for name, own in zip(self.names, self.words):
            if len(own) < K + WINDOW - 1:
                raise ValueError(f"template {name} has fewer than {K + WINDOW - 1} words")
        hashes, inside = w.windows(K)
        at = winnow(hashes, inside)
        order = at[np.argsort(hashes[at], kind="stable")]
        self.hash = hashes[order]
        self.which = np.searchsorted(w.first, order, "right") - 1
        self.place = order - w.first[self.which]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each match: key, license, coverage, n_matched, and the span's characters (start_char, end_char) and words."""
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema[key], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("n_matched", "start_word", "end_word", "start_char", "end_char")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates)
        for b in slices(batches):
            w = _words(b.column("text"))
            hashes, inside = w.windows(K)
            at = winnow(hashes, inside)
            lo, hi = np.searchsorted(index.hash, hashes[at], "left"), np.searchsorted(index.hash, hashes[at], "right")
            seeds = [(int(np.searchsorted(w.first, p, "right")) - 1, int(index.which[i]), int(p), int(index.place[i])) for p, x, y in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]) for i in range(x, y)]
            out, short = [], {}

            def add(row: int, which: int, n: int, first: int, last: int) -> None:
                base = w.first[row]
                begin = w.raw[w.rows[row] :]
                chars = [len(begin[: x - w.rows[row]].tobytes().decode("utf-8")) for x in (w.start[base + first], w.end[base + last])]
                out.append((row, index.names[which], n / len(index.words[which]), n, first, last + 1, *chars))

            for row, which, group in _clusters(seeds, w.first, index):
                own, template = w.hash[w.first[row] : w.first[row + 1]], index.words[which]
                n, first, last = align(own, template, group, _band(template))
                if n >= min_coverage * len(template):
                    add(row, which, n, first, last)
                elif n:
                    short.setdefault((row, which), set()).add((first, last, n, group))
            for (row, which), parts in short.items():
                size = len(index.words[which])
                whole = [(x[4], x[5] - 1) for x in out if x[:2] == (row, index.names[which])]
                parts = {p for p in parts if all(p[1] < x or p[0] > y for x, y in whole)}
                for n, first, last in chained(parts, size, min_coverage * size):
                    add(row, which, n, first, last)
            out = sorted(set(out))
            columns = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), *[pa.array(c, pa.int64()) for c in columns[3:]]], schema.names)

    return rows.mapInArrow(run, schema)


def _band(template: np.ndarray) -> int:
    """Narrow for short templates, so that one match doesn't stand for its neighbour."""
    return 1 + len(template) // 5


def _clusters(seeds: list[tuple[int, int, int, int]], first: np.ndarray, index: _Index) -> Iterator[tuple[int, int, int]]:
    """Row, template and diagonal of each candidate: seeds of nearby diagonals are one."""
    found = sorted((row, which, p - int(first[row]) - place) for row, which, p, place in seeds)
    last = None
    for row, which, diagonal in found:
        if last and last[:2] == (row, which) and diagonal - last[2] <= _band(index.words[which]) // 2:
            continue
        last = (row, which, diagonal)
        yield last

"""License scan: normalised text compared to licence templates by Dice coefficient over word bigrams.

Normalised text: A-Z lower-cased, words ``[a-z0-9.]+`` without dots at their ends. A document's segments are its
lines, its paragraphs (blocks between blank lines) and its whole text; each is compared with templates by the
Dice coefficient of their sets of word bigrams. As ``2 |A & B| <= 2 min(|A|, |B|)``, a template of n bigrams can
reach the threshold t only with segments of ``n t / (2 - t)`` to ``n (2 - t) / t`` bigrams; templates are
sorted by size and only those within the bounds are compared. No segment has a bigram that its text lacks, so texts
that hold fewer than ``n t / (2 - t)`` bigrams of every template are done before any segment is cut.

A licence inside longer text, over several paragraphs or after another sentence of its line, is found by windows
over the text's bigrams that begin and end with one of the template's and reach the threshold; the same bounds
apply. Templates of which the text lacks too many bigrams are left out first. The best windows of a template that
don't overlap are taken, of overlapping ones of several templates that with the most bigrams in common. Windows
inside a segment that matches aren't compared again, so they only add what the segments miss.

Defined cases: null and empty texts and segments of fewer than two words match nothing; equal coefficients go
to the template that is first by name, then to the earlier segment; a segment that matches counts once, and so
does each window beside such segments; long texts are scanned whole; rows that repeat are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

THRESHOLD = 0.8
_WORD = re.compile(r"[a-z0-9.]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# The licences' own public wording.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "MIT-line-licensed": "Licensed under the MIT License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "LGPL-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def words_of(text: str) -> list[str]:
    return [w for x in _WORD.findall(text.translate(_LOWER)) if (w := x.strip("."))]


def bigrams(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:]))  # noqa: B905


def _paragraphs(text: str) -> list[str]:
    return re.split(r"\n[ \t\r]*\n", text)


def segments(text: str) -> list[str]:
    """Lines, paragraphs of several lines, and the whole text; equal ones once, in that order."""
    return list(dict.fromkeys([*text.split("\n"), *(p for p in _paragraphs(text) if "\n" in p), text]))


def _spans(text: str, matched: set[str]) -> list[tuple[int, int]]:
    """First word and the word after the last of each place of the segments ``matched``."""
    found = []
    for parts in (text.split("\n"), _paragraphs(text), [text]):
        at = 0
        for p in parts:
            n = len(words_of(p))
            if p in matched:
                found.append((at, at + n))
            at += n
    return found


def _apart(ordered: Iterable[tuple]) -> list[tuple]:
    """Of windows (..., first, last) the earlier ones that overlap none taken before."""
    taken: list[tuple] = []
    starts: list[int] = []
    for w in ordered:
        i = bisect_left(starts, w[-2])
        if (i == 0 or taken[i - 1][-1] < w[-2]) and (i == len(taken) or w[-1] < starts[i]):
            taken.insert(i, w)
            starts.insert(i, w[-2])
    return taken


class Templates:
    def __init__(self, templates: Mapping[str, str], threshold: float):
        rows = sorted((len(b := bigrams(t)), name, b) for name, t in templates.items())
        self.sizes, self.rows, self.t = [r[0] for r in rows], rows, threshold
        self.low, self.high = self.sizes[0] * threshold / (2 - threshold), self.sizes[-1] * (2 - threshold) / threshold

        self.any = set().union(*(r[2] for r in rows))

    def _ends(self, pairs: list[tuple[str, str]], size: int, other: set) -> list[tuple]:
        """(-dice, length, -common, first, last) of the best window before each bigram of a template."""
        need, high = size * self.t / (2 - self.t) - 1e-9, int(size * (2 - self.t) / self.t + 1e-9)
        # the latest place of each of the last ``high`` distinct bigrams: a window's set is an end piece of it
        recent: OrderedDict[tuple[str, str], int] = OrderedDict()
        shared, found = 0, []
        for e, p in enumerate(pairs):
            if p in recent:
                recent.move_to_end(p)
            else:
                shared += p in other
                if len(recent) == high:
                    shared -= recent.popitem(last=False)[0] in other
            recent[p] = e
            if shared < need or p not in other:
                continue
            top, common = None, 0
            for n, q in enumerate(reversed(recent), 1):
                if q in other:
                    common += 1
                    dice = 2 * common / (n + size)
                    if dice >= self.t and (top is None or dice > -top[0]):
                        top = (-dice, e - recent[q], -common, recent[q], e)
            if top:
                found.append(top)
        return found

    def likely(self, own: set[tuple[str, str]]) -> list[tuple[int, str, set]]:
        """The templates of which a text with these bigrams has enough for any of its parts to match."""
        have = own & self.any
        return [r for r in self.rows if len(have) >= (least := r[0] * self.t / (2 - self.t) - 1e-9) and len(have & r[2]) >= least]

    def windows(self, words: list[str], likely: list[tuple[int, str, set]]) -> list[tuple[float, str, int, int]]:
        """(dice, template, first word, word after the last) of the windows that match, none over another."""
        pairs = list(zip(words, words[1:]))  # noqa: B905
        found = [(common, dice, name, first, last) for size, name, other in likely for dice, _, common, first, last in _apart(sorted(self._ends(pairs, size, other)))]
        return [(-dice, name, first, last + 2) for _, dice, name, first, last in _apart(sorted(found))]

    def best(self, segment: str, own: set[tuple[str, str]] | None = None) -> tuple[float, str] | None:
        # a segment of n bigrams has at least 2 n + 1 characters, and at most one bigram for each two characters
        if len(segment) < 2 * self.low:
            return None
        own = bigrams(segment) if own is None else own
        n = len(own)
        if not self.low - 1e-9 <= n <= self.high + 1e-9:
            return None
        found = None
        lo = bisect_left(self.sizes, n * self.t / (2 - self.t) - 1e-9)
        for size, name, other in self.rows[lo : bisect_right(self.sizes, n * (2 - self.t) / self.t + 1e-9)]:
            dice = 2 * len(own & other) / (n + size)
            if dice >= self.t and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found


def scan_text(text: str | None, templates: Templates) -> tuple[str | None, float, int]:
    """Best template, its coefficient, and the number of distinct segments and of windows beside them that match any."""
    text = text or ""
    words = words_of(text)
    own = set(zip(words, words[1:]))  # noqa: B905
    if not (likely := templates.likely(own)):
        return None, 0.0, 0
    found = {s: h for s in segments(text) if (h := templates.best(s, own if s == text else None))}
    hits = list(found.values())
    if text not in found and (windows := templates.windows(words, likely)):
        spans = _spans(text, set(found)) if found else []
        hits += [(dice, name) for dice, name, first, end in windows if not any(a <= first and end <= b for a, b in spans)]
    if not hits:
        return None, 0.0, 0
    dice, name = min(hits, key=lambda h: (-h[0], h[1]))
    return name, dice, len(hits)


def _scanner(templates: Mapping[str, str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates, threshold)
        for b in batches:
            rows = [scan_text(t.as_py(), index) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["doc_id", "license", "dice", "n_segments"])

    return run


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (null: none), dice, n_segments of every row."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scanner(dict(templates), threshold), f"doc_id {slim.schema[0].dataType.simpleString()}, license string, dice double, n_segments long")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: f"list_filter(list_transform(regexp_extract_all({low.format(c)}, '[a-z0-9.]+'), lambda x: trim(x, '.')), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT name, {pairs} AS g FROM (SELECT name, {words('body')} AS w FROM (VALUES {values}) v(name, body))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))), [text])) AS seg FROM d),
g AS (SELECT r, seg, {pairs} AS g FROM (SELECT r, seg, {words('seg')} AS w FROM s) WHERE len(w) > 1),
m AS (SELECT r, seg, name, 2 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON 2 * least(len(g.g), len(t.g)) / (len(g.g) + len(t.g)) >= {THRESHOLD}),
h AS (SELECT r, seg, name, dice, row_number() OVER (PARTITION BY r ORDER BY dice DESC, name) AS k FROM m WHERE dice >= {THRESHOLD}),
n AS (SELECT r, count(DISTINCT seg) AS n_segments FROM h GROUP BY r)
SELECT d.doc_id, h.name AS license, coalesce(h.dice, 0.0)::DOUBLE AS dice, CAST(coalesce(n.n_segments, 0) AS BIGINT) AS n_segments
FROM d LEFT JOIN h ON h.r = d.r AND h.k = 1 LEFT JOIN n ON n.r = d.r
"""


SQL = _sql()

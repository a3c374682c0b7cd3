"""License scans (10): Dice coefficient over word bigrams against licence templates.

Lines, paragraphs (runs of lines between blank ones), whole texts, and every window of as many words as the template has are
compared with each template; windows find a licence of several paragraphs, or a notice in a sentence, within other text. A
unit of n distinct bigrams can reach the threshold t against a template of m only if t / (2 - t) <= n / m <= (2 - t) / t, and
a unit or window only if at least m * t / (2 - t) of its bigrams are the template's. Units, windows and templates that fail
these are never scored, which changes no result. The different bigrams of all windows of one length are counted in one pass:
a bigram is new in the windows that begin after the place where it was last, so that each adds to a range of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import BYTE, WORD, Words, buffers, mix, slices

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {0} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version {0} of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which
is available at https://www.eclipse.org/legal/epl-2.0/"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object
code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN
NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING,
DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."""
_CC = "This work is licensed under a Creative Commons {0} {1} International License."



def _file(name: str) -> str:
    return (Path(__file__).parent / "licence_texts" / name).read_text(encoding="utf-8")


#: (template, licence, text). Texts of licences, notices that they ask for, and one-line notices in common use; the README lists
#: the licences.
TEMPLATES: list[tuple[str, str, str]] = [
    ("mit-text", "MIT", _MIT),
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-notice-2", "MIT", "This project is licensed under the MIT License."),
    ("bsd-2-text", "BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("bsd-3-text", "BSD-3-Clause", f"{_BSD} {_BSD3} {_BSD_END}"),
    ("bsd-notice", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc-text", "ISC", _ISC),
    ("apache-2-notice", "Apache-2.0", _APACHE),
    ("apache-2-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2-notice", "GPL-2.0", _GPL.format("2")),
    ("gpl-3-notice", "GPL-3.0", _GPL.format("3")),
    ("gpl-2-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-text", "CC-BY-4.0", _CC.format("Attribution", "4.0")),
    ("cc-by-sa-text", "CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "4.0")),
    ("cc-by-nc-text", "CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "4.0")),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-line", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("apache-2-text", "Apache-2.0", _file("Apache-2.0")),
    ("gpl-2-text", "GPL-2.0", _file("GPL-2")),
    ("gpl-3-text", "GPL-3.0", _file("GPL-3")),
    ("lgpl-2.1-text", "LGPL-2.1", _file("LGPL-2.1")),
    ("lgpl-3-text", "LGPL-3.0", _file("LGPL-3")),
    ("mpl-2-text", "MPL-2.0", _file("MPL-2.0")),
    ("cc0-text", "CC0-1.0", _file("CC0-1.0")),
    ("lgpl-2.1-notice", "LGPL-2.1", _LGPL.format("2.1")),
    ("lgpl-3-notice", "LGPL-3.0", _LGPL.format("3")),
    ("agpl-3-notice", "AGPL-3.0", _AGPL),
    ("mpl-2-notice", "MPL-2.0", _MPL),
    ("epl-2-notice", "EPL-2.0", _EPL),
    ("unlicense-text", "Unlicense", _UNLICENSE),
    ("zlib-text", "Zlib", _ZLIB),
    ("bsl-text", "BSL-1.0", _BSL),
    ("wtfpl-text", "WTFPL", _WTFPL),
]
_BIT = np.uint64(64 - 20)


def bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word that begins it) of every two neighbouring words of one text."""
    n = len(words)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    return mix(words.hash[at] * BYTE[1] + words.hash[at + 1]), at


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]], threshold: float):
        self.templates, self.threshold = templates, threshold
        words = [Words(pa.array([t])) for _, _, t in templates]
        self.words = np.array([len(w) for w in words], np.int64)
        sets = [np.unique(bigrams(w)[0]) for w in words]
        self.size = np.array([len(s) for s in sets], np.int64)
        #: bigrams of a template that a unit or window must have
        self.least = np.maximum(1, np.ceil(self.size * threshold / (2 - threshold) - 1e-9)).astype(np.int64)
        pairs = sorted((int(h), k) for k, s in enumerate(sets) for h in s)
        self.hash = np.array([h for h, _ in pairs], np.uint64)
        self.template = np.array([k for _, k in pairs], np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.hash >> _BIT] = True

    def match(self, unit: np.ndarray, hashes: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, template, dice) of every pair that reaches the threshold. (unit, hashes): the units' bigrams, unit ascending."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        hit = np.flatnonzero(self.bitmap[hashes >> _BIT])
        lo, hi = np.searchsorted(self.hash, hashes[hit], "left"), np.searchsorted(self.hash, hashes[hit], "right")
        n = hi - lo
        k = self.template[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair, count = np.unique(np.repeat(unit[hit], n) * len(self.size) + k, return_counts=True)
        chosen = np.zeros(units, bool)
        chosen[(pair // len(self.size))[count >= self.least[pair % len(self.size)]]] = True
        if not chosen.any():
            return none
        use = chosen[unit]
        u, h = unit[use], hashes[use]
        order = np.lexsort((h, u))
        u, h = u[order], h[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (h[1:] != h[:-1])])
        u, h = u[new], h[new]
        size = np.bincount(u, minlength=units)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        pair = np.repeat(u, n) * len(self.size) + self.template[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair, shared = np.unique(pair, return_counts=True)
        u, k = pair // len(self.size), pair % len(self.size)
        t = self.threshold
        near = (size[u] * (2 - t) >= t * self.size[k]) & (size[u] * t <= (2 - t) * self.size[k])
        u, k, shared = u[near], k[near], shared[near]
        dice = 2 * shared / (size[u] + self.size[k])
        good = dice >= t
        return u[good], k[good], dice[good]

    def windows(self, doc: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(doc, template, dice) of every window that reaches the threshold. (doc, hashes): the texts' bigrams in their order."""
        at = np.flatnonzero(self.bitmap[hashes >> _BIT])
        lo, hi = np.searchsorted(self.hash, hashes[at], "left"), np.searchsorted(self.hash, hashes[at], "right")
        n = hi - lo
        template = self.template[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(template, kind="stable")
        at, bounds = np.repeat(at, n)[order], np.searchsorted(template[order], np.arange(len(self.size) + 1))
        total = len(hashes)
        last_at: np.ndarray | None = None
        for k, m in enumerate(self.size.tolist()):
            hits, span, least = at[bounds[k] : bounds[k + 1]], int(self.words[k]) - 1, int(self.least[k])
            if not m or len(hits) < least:
                continue
            first, last = np.maximum(hits[least - 1 :] - span + 1, 0), hits[: len(hits) - least + 1]
            first[1:] = np.maximum(first[1:], last[:-1] + 1)
            n = np.maximum(last - first + 1, 0)
            starts = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            starts = starts[starts + span <= total]
            starts = starts[doc[starts] == doc[starts + span - 1]]
            if not len(starts):
                continue
            if last_at is None:  # where each bigram was before
                order = np.argsort(hashes, kind="stable")
                same = hashes[order[1:]] == hashes[order[:-1]]
                last_at = np.full(total, -1)
                last_at[order[1:][same]] = order[:-1][same]

            def different(places: np.ndarray) -> np.ndarray:
                """By where a window begins, how many of its bigrams at these places are not again before in it."""
                step = np.bincount(np.maximum(last_at[places] + 1, places - span + 1).clip(0), minlength=total + 1)
                return np.cumsum(step - np.bincount(places + 1, minlength=total + 1))

            dice = 2 * different(hits)[starts] / (different(np.arange(total))[starts] + m)
            good = dice >= self.threshold
            yield doc[starts[good]], k, dice[good]


def _blank_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin and where paragraphs begin; both begin with each text."""
    new = np.flatnonzero(raw == 10) + 1
    starts = np.unique(np.concatenate([offsets[:-1], new]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    seen = np.concatenate([[0], np.cumsum(WORD[raw])])
    blank = seen[ends] == seen[starts]
    texts = np.isin(starts, offsets)
    after = np.concatenate([[True], blank[:-1]])
    return starts, starts[texts | after]


def _scan(batches: Iterator[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words = Words(b.column("text"))
        h, at = bigrams(words)
        lines, paragraphs = _blank_lines(words.raw, words.offsets)
        best: dict[tuple[int, int], float] = {}
        for starts in (lines, paragraphs, np.unique(words.offsets[:-1])):
            if not len(starts):
                continue
            unit = np.searchsorted(starts, words.start, "right") - 1
            same = unit[at] == unit[at + 1]
            u, k, d = templates.match(unit[at][same], h[same], len(starts))
            doc = np.searchsorted(words.offsets, starts[u], "right") - 1
            for key, dice in zip(zip(doc.tolist(), k.tolist()), d.tolist()):
                best[key] = max(best.get(key, 0), dice)
        for doc, k, d in templates.windows(words.doc[at], h):
            for r, dice in zip(doc.tolist(), d.tolist()):
                best[r, k] = max(best.get((r, k), 0), dice)
        rows = sorted(best)
        ids = b.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64()))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": ids,
                "template": pa.array([templates.templates[k][0] for _, k in rows], pa.string()),
                "licence": pa.array([templates.templates[k][1] for _, k in rows], pa.string()),
                "dice": pa.array([round(best[r], 6) for r in rows], pa.float64()),
            }
        )


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, licence and dice, for every row of docs and every template that one of its units or windows
    reaches the threshold with; dice is the largest of them, to six places.

    Words are runs of letters and digits of the lower-cased text; bigrams are a set, and do not cross a unit's end;
    windows do cross the ends of lines and paragraphs. A null or
    empty text, or one of a single word, matches nothing. Ties between templates are all returned. Repeated rows are scanned
    each for itself, a null id stays null, other columns are not read, no rows give no rows."""
    t = Templates(TEMPLATES if templates is None else templates, threshold)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _scan(it, t), "doc_id bigint, template string, licence string, dice double")


def oracle_sql(templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, which scores every unit against every template, but no windows; on the test tables they add nothing."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in templates)
    words = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = lambda w: f"list_distinct(list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    blank = "'\\n(?:[^a-z0-9A-Z\\x{80}-\\x{10FFFF}\\n]*\\n)+'"
    return f"""
WITH template AS (SELECT column0 AS template, column1 AS licence, {words('column2')} AS w FROM (VALUES {values}) v(column0, column1, column2)),
t AS (SELECT template, licence, {grams('w')} AS g FROM template),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
units AS (SELECT rid, unnest(string_split(text, chr(10))) AS unit FROM docs
  UNION ALL SELECT rid, unnest(string_split_regex(text, {blank})) FROM docs
  UNION ALL SELECT rid, text FROM docs),
u AS (SELECT rid, {words('unit')} AS w FROM units),
g AS (SELECT rid, {grams('w')} AS g FROM u WHERE len(w) > 1),
g2 AS (SELECT DISTINCT rid, g FROM g WHERE len(g) <= (SELECT max(len(g)) * {2 - threshold} / {threshold} FROM t)),
scored AS (SELECT rid, template, licence, 2.0 * len(list_intersect(g2.g, t.g)) / (len(g2.g) + len(t.g)) AS dice
  FROM g2, t WHERE len(g2.g) * {2 - threshold} >= {threshold} * len(t.g) AND len(g2.g) * {threshold} <= {2 - threshold} * len(t.g))
SELECT doc_id, template, licence, round(max(dice), 6) AS dice FROM scored JOIN docs USING (rid)
WHERE dice >= {threshold} GROUP BY rid, doc_id, template, licence
"""

"""Licence scans: Dice coefficient over word bigrams against licence templates.

A document is compared as a whole, by paragraph, by line and by runs of adjacent
lines (of any paragraphs), each normalised to lower-case words without copyright
lines. A unit of ``a`` distinct bigrams and
a template of ``b`` reach a coefficient ``t`` only if they share at least
``t b / (2 - t)`` bigrams and if ``b t / (2 - t) <= a <= b (2 - t) / t``; units
and templates outside these bounds are never compared. Templates are a bounded
parameter and travel with the task; documents are not shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import text_of

THRESHOLD = 0.8

# Notices and short licences as published, by SPDX identifier. Full-length licence texts are not among them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.""",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "LGPL-3.0",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU Lesser General Public License for more details.""",
    ),
)

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TOKENS = re.compile(r"\n|" + _WORD)
_COPYRIGHT = r"(^|\n)[ \t]*(?:copyright|\(c\))[^\n]*"
_COPYRIGHT_LINE = re.compile(_COPYRIGHT)
_UNITS = ("line", "paragraph", "text", "run")


def tokens_of(text: str) -> list[str]:
    """Words and line breaks of a normalised text."""
    low = text.lower()
    if "copyright" in low or "(c)" in low:
        low = _COPYRIGHT_LINE.sub(r"\1", low)
    return _TOKENS.findall(low)


class Scanner:
    """Compares texts with the templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, runs: bool = False):
        self.threshold, self.numbers, self.templates, self.runs = threshold, {"\n": 1}, [], runs
        for name, text in templates:
            words = [w for w in tokens_of(text) if w != "\n"]
            grams = set(zip(words, words[1:]))
            if grams:
                for w in words:
                    self.numbers.setdefault(w, len(self.numbers) + 1)
                self.templates.append((name, grams))
        self.base = len(self.numbers) + 1
        codes = [{self.numbers[a] * self.base + self.numbers[b] for a, b in grams} for _, grams in self.templates]
        self.known = np.array(sorted(set().union(*codes)), np.int64)
        self.member = np.array([[int(c) in own for c in self.known] for own in codes], bool).reshape(len(codes), len(self.known))
        sizes = np.array([len(g) for _, g in self.templates])
        # Rounded towards more candidates; the coefficient itself decides.
        self.need = np.maximum(1, np.ceil(threshold * sizes / (2 - threshold) - 1e-9)).astype(int)
        self.low, self.high = threshold * sizes / (2 - threshold) - 1e-9, sizes * (2 - threshold) / threshold + 1e-9

    def _unit(self, words: list[str], hits: np.ndarray, kind: int, best: dict) -> None:
        shared = self.member[:, np.unique(hits)].sum(axis=1)
        near = np.flatnonzero(shared >= self.need)
        if not len(near):
            return
        size = len(set(zip(words, words[1:])))
        for i in near:
            if self.low[i] <= size <= self.high[i]:
                name, grams = self.templates[i]
                dice = 2 * int(shared[i]) / (size + len(grams))
                if dice >= self.threshold and (-dice, kind) < best.get(name, (0, 0)):
                    best[name] = (-dice, kind)

    def _runs(self, words: list[str], line: np.ndarray, places: np.ndarray, hits: np.ndarray, best: dict) -> None:
        """The best run of adjacent lines for each template.

        A run that is better than all shorter ones starts in a line with a known
        bigram, ends in one, and does not repeat all the known bigrams of its first
        line. Gaps between equal bigrams add up to the text, so the work is linear in
        it for each bigram of a template.
        """
        near = np.flatnonzero(self.member[:, np.unique(hits)].sum(axis=1) >= self.need)
        if not len(near):
            return
        edges = np.append(np.searchsorted(line, np.arange(line[-1] + 1)), len(words)).tolist()
        for i in near:
            name, grams = self.templates[i]
            held = self.member[i, hits]
            at, which = places[held], hits[held].tolist()
            first, last = line[at].tolist(), line[at + 1].tolist()
            again, seen = [0] * len(which), {}
            for k in range(len(which) - 1, -1, -1):
                again[k] = seen.get(which[k], edges[-1])
                seen[which[k]] = last[k]
            low, high, k = self.low[i], self.high[i], 0
            while k < len(which):
                start, until = first[k], -1
                head = k
                while k < len(which) and first[k] == start:
                    # A bigram over the end of the first line is lost with it only if the line is.
                    until = max(until, again[k])
                    k += 1
                shared, size, done, j = set(), set(), edges[start], head
                while j < len(which):
                    end = last[j]
                    if end >= until and end > start:
                        break
                    while j < len(which) and last[j] == end:
                        shared.add(which[j])
                        j += 1
                    stop = edges[end + 1]
                    size.update(zip(words[max(done - 1, edges[start]) : stop - 1], words[max(done, edges[start] + 1) : stop]))
                    done = stop
                    if len(size) > high:
                        break
                    if len(shared) >= self.need[i] and len(size) >= low:
                        dice = 2 * len(shared) / (len(size) + len(grams))
                        if dice >= self.threshold and (-dice, 3) < best.get(name, (0, 0)):
                            best[name] = (-dice, 3)

    def _bigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bigrams that some template has, and their numbers."""
        codes = ids[:-1] * self.base + ids[1:]
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        places = np.flatnonzero((self.known[at] == codes) & (ids[:-1] > 0) & (ids[1:] > 0))
        return places, at[places]

    def __call__(self, text: str) -> list[tuple[str, float, str]]:
        """``(licence, coefficient, unit)`` of each licence found, by its best unit, the smallest kind of equals."""
        if not self.templates:
            return []
        tokens = tokens_of(text)
        get = self.numbers.get
        ids = np.fromiter((get(t, 0) for t in tokens), np.int64, len(tokens))
        whole = np.flatnonzero(ids != 1)
        if len(whole) < 2:
            return []
        places, hits = self._bigrams(ids[whole])
        if len(hits) < self.need.min():
            return []
        words = [tokens[i] for i in whole]
        # A break between two words ends a line; two or more end a paragraph.
        breaks = np.diff(whole) - 1
        best: dict[str, tuple[float, int]] = {}
        for kind, least in enumerate((1, 2, None)):
            cuts = np.flatnonzero(breaks >= least) + 1 if least else np.empty(0, np.int64)
            unit = np.searchsorted(cuts, places, "right")
            inside = np.searchsorted(cuts, places + 1, "right") == unit
            edges = [0, *cuts.tolist(), len(words)]
            for u in np.unique(unit[inside]).tolist():
                own = hits[inside & (unit == u)]
                if len(own) >= self.need.min():
                    self._unit(words[edges[u] : edges[u + 1]], own, kind, best)
        if self.runs:
            self._runs(words, np.concatenate([[0], np.cumsum(breaks > 0)]), places, hits, best)
        return sorted((name, -dice, _UNITS[kind]) for name, (dice, kind) in best.items())


def scan_licences(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, runs: bool = True) -> DataFrame:
    """``doc_id``, ``licence``, ``dice`` and ``unit`` of every licence found in a document.

    A licence with several templates counts once, by the best. Without ``runs``,
    only lines, paragraphs and whole texts are compared, as the SQL does. Null and empty
    texts and texts of one word have no bigrams and match nothing; repeated rows
    give repeated results; an empty table or no templates give an empty result.
    """

    def run(batches):
        scan = Scanner(templates, threshold, runs)
        for batch in batches:
            rows = [(d, *found) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in scan(t)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "licence", "dice", "unit"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, licence string, dice double, unit string")


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    clean = f"regexp_replace(lower(coalesce(text, '')), {quoted(_COPYRIGHT)}, '\\1', 'g')"
    other = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    grams = "SELECT DISTINCT {keys}, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g"
    words = f"regexp_extract_all(u, {quoted(_WORD)})"
    return rf"""WITH t AS (SELECT m, licence, regexp_extract_all({clean}, {quoted(_WORD)}) AS w FROM (VALUES {values}) v(m, licence, text)),
    tg AS MATERIALIZED ({grams.format(keys="m, licence")} FROM t),
    ts AS (SELECT m, count(*) AS b FROM tg GROUP BY m),
    d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {clean} AS c FROM documents),
    u AS (SELECT n, 0 AS kind, unnest(string_split(c, chr(10))) AS u FROM d
      UNION ALL SELECT n, 1, unnest(string_split_regex(c, '\n(?:{other}\n)+')) FROM d UNION ALL SELECT n, 2, c FROM d),
    k AS MATERIALIZED (SELECT n, kind, row_number() OVER () AS k, {words} AS w FROM u),
    g AS MATERIALIZED ({grams.format(keys="k")} FROM k),
    a AS (SELECT k, count(*) AS a FROM g GROUP BY k),
    s AS (SELECT k, m, licence, count(*) AS n_both FROM g JOIN tg USING (g) GROUP BY ALL),
    f AS (SELECT n, licence, 2 * n_both / (a + b) AS dice, kind FROM s JOIN a USING (k) JOIN ts USING (m) JOIN k USING (k) WHERE 2 * n_both / (a + b) >= {threshold})
    SELECT doc_id, licence, dice, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' ELSE 'text' END AS unit
    FROM (SELECT *, row_number() OVER (PARTITION BY n, licence ORDER BY dice DESC, kind) AS r FROM f) JOIN d USING (n) WHERE r = 1"""

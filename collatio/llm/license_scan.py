"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are lower-cased runs of letters and digits, shingles have five words. A notice is a chain of shingles that a text has in the template's
order; what lies between two of them may be twice as long as the template, or 64 words. Its containment is the share of the template's
shingles (repeats count) in the chain, CONTAINED or more for a match. A match spans its first to its last shingle.
Matches of one template don't overlap. Of all ways to cut a text into them that way is taken which holds the most shingles, found by one pass over
the hits with the best cut and chain so far at each (ties: the longer chain, then the nearer hit). So notices in a row are all found, each
with its own span, and a notice that something interrupts is one.

Retrieval: a template is indexed by all of its windows of c shingles, and texts are covered by windows of every such c at steps of c / 2. Each window has
BANDS bands of ROWS minima; windows of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: more than 0.9997 at 0.8, and certainty
at 1. Every interruption, change or gap costs a template four shingles or more, so that a match has at most (1 - CONTAINED) n / 4 of them and one
whole piece of at least a known length; c is the largest power of two with which such a piece holds a whole window, which
equals one of the template's. So no match is missed, but for templates that repeat themselves inside five words. (A window of one shingle has one band, which decides alone.)

Null texts and texts of fewer than five words have no matches. Templates have five words or more, and together at most
MAX_TEMPLATE_WORDS words, as they travel in the task. Very long texts are scanned whole. Repeated rows repeat, empty tables stay empty, other columns stay, whatever their
names; the result is one struct column that the caller names, in place of one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import alnum_words, bound_batches, mixed

WIDTH, BANDS, ROWS, WIDEST, CONTAINED = 5, 8, 2, 32, 0.8
MAX_TEMPLATE_WORDS = 1_000_000
#: What interrupts a notice is at most so many times as long as it, or so many words.
INTERRUPTED, LEAST_REACH = 2, 64
SCHEMA = "n long, ids array<string>, best double, found array<struct<id: string, containment: double, start: int, stop: int>>"

# Public license notices and the phrases that name a license.
TEMPLATES = [
    ("apache-2.0-name", "Licensed under the Apache License, Version 2.0."),
    ("mit-name", "Released under the MIT License."),
    ("gpl-3.0-name", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-name", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-name", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-name", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("mit-full", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc-full", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("unlicense-full", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
]
# End of fixed values.

STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH, 0, -1)], np.uint64)
FACTORS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64), 11) | np.uint64(1)


def shingled(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts, end to end; first shingle of each text and the end of the last)."""
    import xxhash

    words = [w for t in texts for w in t]
    index = dict(zip(dict.fromkeys(words), count()))
    values = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
    h = values[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]
    n = len(h) - WIDTH + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes - WIDTH + 1, 0))))
    if n < 1:
        return np.empty(0, np.uint64), starts
    total = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        total += h[k : k + n] * STEPS[k]
    kept = np.arange(n) + WIDTH <= np.repeat(np.cumsum(sizes), sizes)[:n]
    return mixed(total[kept], 5), starts


def minima(shingles: np.ndarray, band: int, row: int) -> np.ndarray:
    k = 2 * (band * ROWS + row)
    return (shingles * FACTORS[k] + FACTORS[k + 1]) >> np.uint64(32)


def levels(shingles: np.ndarray, band: int, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each width, the band's key of the window that begins at every place."""
    m, c = [minima(shingles, band, r) for r in range(ROWS)], 1
    while c <= widths[-1]:
        if c in widths:
            key = m[0]
            for x in m[1:]:
                key = key * np.uint64(0xC2B2AE3D27D4EB4F) ^ x
            yield c, mixed(key, 1000 * c + band)
        m, c = [np.minimum(x[:-c], x[c:]) for x in m], 2 * c


def least(n: int) -> int:
    """Shingles that a match of a template of n has at least."""
    return ceil(CONTAINED * n - 1e-9)


def reach(n: int) -> int:
    """Words from one shingle of a match to the next at most."""
    return max(INTERRUPTED * n, LEAST_REACH) + WIDTH


def window_of(n: int) -> int:
    """Shingles of the windows of a template of n: such that the longest piece of any match holds a whole one."""
    breaks = (n - least(n)) // (WIDTH - 1)
    piece = -(-least(n) // (breaks + 1))
    c = 1
    while 2 * c <= WIDEST and 2 * c + c - 1 <= piece:
        c *= 2
    return c


def chains(p: np.ndarray, q: np.ndarray, need: int, far: int) -> list[tuple[int, int, int]]:
    """(hits, first place, last place) of the disjoint chains of `need` hits or more that hold the most hits together.

    Hits (p, q) are ordered by p, then q. In a chain both rise, p by at most `far`. Chains are disjoint in words.
    """
    if len(np.unique(q)) < need:
        return []
    low, same = np.searchsorted(p, p - far), np.searchsorted(p, p)
    rank = np.zeros(len(p), np.int64)  # hits of the best cut that ends here, then those of its last chain
    before = [-1] * len(p)
    cut, best, ready = [-1] * len(p), -1, 0  # the end of the cut before a chain begins; the best end so far that is WIDTH words behind
    places, lows, sames = p.tolist(), low.tolist(), same.tolist()

    def total(i: int) -> int:
        return int(rank[i]) >> 24 if i >= 0 else 0

    for i, place in enumerate(places):
        while places[ready] + WIDTH <= place:
            if rank[ready] & 0xFFFFFF >= need and total(ready) > total(best):
                best = ready
            ready += 1
        key, back = total(best) + 1 << 24 | 1, -1
        a, b = lows[i], sames[i]
        if a < b:
            seen = np.where(q[a:b] < q[i], rank[a:b], -1)[::-1]
            k = int(seen.argmax())
            if seen[k] >= 0 and (longer := int(seen[k]) + (1 << 24) + 1) >= key:
                key, back = longer, b - 1 - k
        rank[i], before[i], cut[i] = key, back, best if back < 0 else cut[back]
    ends = np.flatnonzero(rank & 0xFFFFFF >= need)
    out, i = [], int(ends[np.argmax(rank[ends] >> 24)]) if len(ends) else -1
    while i >= 0:
        size, last, first = int(rank[i]) & 0xFFFFFF, places[i], i
        while before[first] >= 0:
            first = before[first]
        out.append((size, places[first], last))
        i = cut[i]
    return out[::-1]


class Index:
    """Templates by the bands of their windows."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        texts = [alnum_words(t) for _, t in templates]
        if any(len(t) < WIDTH for t in texts) or sum(map(len, texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"a template has fewer than {WIDTH} words, or all have more than {MAX_TEMPLATE_WORDS}")
        self.shingles = [shingled([t])[0] for t in texts]
        self.order = [np.argsort(s, kind="stable") for s in self.shingles]
        self.wide = [window_of(len(s)) for s in self.shingles]
        self.widths = sorted(set(self.wide))
        self.bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for band in range(BANDS):
            rows: dict[int, list[tuple[np.ndarray, int]]] = {}
            for t, s in enumerate(self.shingles):
                rows.setdefault(self.wide[t], []).extend((key, t) for c, key in levels(s, band, [self.wide[t]]))
            for c, found in rows.items():
                if c == 1 and band:
                    continue
                keys = np.concatenate([k for k, _ in found])
                owner = np.concatenate([np.stack([np.full(len(k), t), np.arange(len(k))], 1) for k, t in found])
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                table = np.zeros(1 << 18, bool)
                table[(keys >> np.uint64(46)).astype(np.int64)] = True
                self.bands[c, band] = keys, owner, table

    def candidates(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (text, template) that bands give."""
        out = []
        if not len(shingles) or not self.names:
            return np.empty((0, 2), np.int64)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for band in range(BANDS):
            for c, keys in levels(shingles, band, self.widths):
                if (c, band) not in self.bands or not len(keys):
                    continue
                known, owner, table = self.bands[c, band]
                step = max(1, c // 2)
                at = np.flatnonzero(table[(keys[::step] >> np.uint64(46)).astype(np.int64)]) * step
                at = at[text[at] == text[at + c - 1]]
                low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
                for k in range(int((high - low).max(initial=0))):
                    live = low + k < high
                    out.append(np.unique(np.stack([text[at[live]], owner[low[live] + k, 0]], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)

    def hits(self, part: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in a text's shingles, places in a template's) of all pairs of equal shingles, by place in the text."""
        order = self.order[t]
        known = self.shingles[t][order]
        low, high = np.searchsorted(known, part, "left"), np.searchsorted(known, part, "right")
        at = np.flatnonzero(high > low)
        times = (high - low)[at]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), order[np.repeat(low[at], times) + within]

    def scan(self, texts: list[list[bytes]]) -> dict[int, list[tuple[str, float, int, int]]]:
        """Matches (name, containment, first word, word behind the last) by text."""
        shingles, starts = shingled(texts)
        found: dict[int, list[tuple[str, float, int, int]]] = {}
        for d, t in self.candidates(shingles, starts).tolist():
            n = len(self.shingles[t])
            p, q = self.hits(shingles[starts[d] : starts[d + 1]], t)
            for size, first, last in chains(p, q, least(n), reach(n)):
                found.setdefault(d, []).append((self.names[t], size / n, first, last + WIDTH))
        return found


def with_licenses(df: DataFrame, text: str = "text", into: str = "licenses", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """df and a struct column: number of matches, names, best containment and all matches."""
    bound_batches(df.sparkSession)
    chosen = TEMPLATES if templates is None else templates
    Index(chosen)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(chosen)
        for texts in batches:
            found = index.scan([alnum_words(t) for t in texts])
            rows = []
            for d in range(len(texts)):
                own = sorted(found.get(d, []), key=lambda x: (x[2], x[0]))
                rows.append((len(own), sorted({x[0] for x in own}), max((x[1] for x in own), default=0.0), [dict(zip(("id", "containment", "start", "stop"), x)) for x in own]))
            yield pd.DataFrame(rows, columns=["n", "ids", "best", "found"])

    return df.withColumn(into, run.asNondeterministic()(F.col(text)))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    x = F.col("licenses")
    spans = F.array_join(F.transform(x["found"], lambda m: F.concat_ws(":", m["id"], m["start"], m["stop"])), ",")
    return with_licenses(docs).select("doc_id", x["n"].alias("n_licenses"), F.array_join(x["ids"], ",").alias("license_ids"), x["best"].alias("best_containment"), spans.alias("spans"))

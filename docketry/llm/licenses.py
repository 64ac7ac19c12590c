"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment decides.

Words are runs of letters and digits, ASCII letters in lower case; shingles are
five words.  A template of n words is looked for in windows of twice the next
size class c >= n that start every c words, so each occurrence lies whole in a
window, and at least a share 1/(2c/n) of the window's shingles are its own.
With ``BANDS`` bands of one row the chance to meet a template that fills an
eighth of a window is 1 - (7/8)^BANDS, over 0.9998; one that fills more is surer.
In a band of one row a window agrees with a template only by the template's least
shingle of that band; so windows without one of those are never signed, the
others are signed and looked up in their bands.  Windows that meet a template
give the places of its shingles; each run of them that holds the template by
``CONTAINED`` is an occurrence and a row of its own.

Cases: null texts are empty; a text of fewer than five words matches nothing.
Rows that repeat a doc_id are scanned each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, MARKS, U, Words, cuts, mix, utf8

SHINGLE = 5
BANDS = 64
CONTAINED = 0.8
SIZES = (6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

# fixed values: public licence texts and notices by SPDX identifier
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_SEEDS = mix(np.arange(1, 1025, dtype=U) * U(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The least hash of a set under each of ``bands`` hash functions."""
    return mix(shingles[None, :] ^ _SEEDS[:bands, None]).min(axis=1)


class Index:
    """Templates by size class: their shingles and their band values."""

    def __init__(self, templates: tuple[tuple[str, str], ...], bands: int = BANDS):
        self.names, self.bands = [name for name, _ in templates], bands
        words = Words(*utf8(pa.array([text for _, text in templates], pa.string())), MARKS, LOWER)
        at, own = words.shingles(SHINGLE)
        self.shingles = [np.unique(own[words.row[at] == k]) for k in range(len(templates))]
        self.classes: dict[int, tuple[np.ndarray, dict]] = {}
        for k, n in enumerate(np.diff(words.first).tolist()):
            if n < SHINGLE:
                raise ValueError(f"a template of under {SHINGLE} words: {templates[k]}")
            size = next((c for c in SIZES if c >= n), n)
            known, buckets = self.classes.get(size, (np.zeros(0, U), {}))
            for band, value in enumerate(signature(self.shingles[k], bands).tolist()):
                buckets.setdefault((band, value), set()).add(k)
            self.classes[size] = (np.union1d(known, self.shingles[k]), buckets)
        # the shingles by which a band can agree: each template's least one of each band
        self.leads = np.unique(np.concatenate([x[mix(x[None, :] ^ _SEEDS[:bands, None]).argmin(axis=1)] for x in self.shingles]))
        self.counts = [dict(zip(*(v.tolist() for v in np.unique(own[words.row[at] == k], return_counts=True)), strict=True)) for k in range(len(templates))]
        self.length = np.diff(words.first).tolist()

    def matches(self, place: np.ndarray, shingles: np.ndarray, contained: float) -> list[tuple[int, int, int, float, int]]:
        """(template, first word, end, containment, windows) of each occurrence over one text's shingles at word places."""
        met: dict[int, tuple[list[np.ndarray], int]] = {}
        lead = place[np.isin(shingles, self.leads)]
        for size, (_, buckets) in self.classes.items():
            starts = np.unique(np.concatenate([lead // size, lead // size - 1]))
            for j in starts[starts >= 0].tolist():
                lo, hi = np.searchsorted(place, (j * size, (j + 2) * size - SHINGLE + 1))
                inside = shingles[lo:hi]
                if not len(inside):
                    continue
                near = set()
                for band, value in enumerate(signature(inside, self.bands).tolist()):
                    near |= buckets.get((band, value), set())
                for k in near:
                    own = np.isin(inside, self.shingles[k])
                    if len(np.unique(inside[own])) >= contained * len(self.shingles[k]):
                        spots, many = met.get(k, ([], 0))
                        met[k] = ([*spots, lo + np.flatnonzero(own)], many + 1)
        return [(k, *x, many) for k, (spots, many) in sorted(met.items()) for x in self._occurrences(k, np.unique(np.concatenate(spots)), place, shingles, contained)]

    def _occurrences(self, k: int, spots: np.ndarray, place: np.ndarray, shingles: np.ndarray, contained: float) -> list[tuple[int, int, float]]:
        """Runs of a template's shingles: one ends where the next shingle is further off than the template is long, or is one too many of its kind."""
        runs: list[tuple[list[int], dict[int, int]]] = []
        for p, x in zip(place[spots].tolist(), shingles[spots].tolist(), strict=True):
            if not runs or p - runs[-1][0][-1] > self.length[k] or runs[-1][1].get(x, 0) >= self.counts[k][x]:
                runs.append(([], {}))
            at, had = runs[-1]
            at.append(p)
            had[x] = had.get(x, 0) + 1
        shares = ((at[0], at[-1] + SHINGLE, len(had) / len(self.shingles[k])) for at, had in runs)
        return [x for x in shares if x[2] >= contained]


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64()), ("windows", pa.int32())])


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, template, start, end, containment, windows) of each occurrence of a template in each text; words count from 0.

    windows: how many windows of the text met the template.
    """
    index = Index(templates, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out = []
            for i, j in cuts(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], MARKS, LOWER)
                at, own = words.shingles(SHINGLE)
                spot = np.minimum(np.searchsorted(index.leads, own), len(index.leads) - 1)
                for row in np.unique(words.row[at[index.leads[spot] == own]]).tolist():
                    first, last = words.first[row], words.first[row + 1]
                    lo, hi = np.searchsorted(at, (first, last))
                    out += [(ids[i + row], index.names[m[0]], *m) for m in index.matches(at[lo:hi] - first, own[lo:hi], contained)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, template int, start int, end int, containment double, windows int")

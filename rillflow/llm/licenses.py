"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

#: Notices and texts of public licenses. Those called text are whole (without title and copyright line); others are what files and pages quote.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD line": "Released under the BSD License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
BANDS = 64  #: bands of one MinHash value each


def _hash_params(bands: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, bands, dtype=np.uint64)


def _signature(values: np.ndarray, params: np.ndarray) -> np.ndarray:
    return textvec.mix(values[None, :] ^ params[:, None]).min(1)


def _prepared(templates: dict[str, str], bands: int) -> list[tuple]:
    """(name, class, shingle set, signature) of each template; class c holds those of more than 2**(c-1) and at most 2**c shingles."""
    params, out = _hash_params(bands), []
    for name, text in templates.items():
        for _, _, data, off in textvec.chunks(pa.array([text], pa.string())):
            own = np.unique(textvec.shingles(*textvec.word_hashes(data, off, bare=True))[0])
            if len(own):
                out.append((name, int(len(own) - 1).bit_length(), own, _signature(own, params)))
    return out


def _band_table(prepared: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (band, value) keys of the templates of one class, and the template of each. A band's parameter is in its value, so values of two bands don't meet but by chance."""
    keys = np.concatenate([t[3] for t in prepared])
    owner = np.repeat(np.arange(len(prepared)), [len(t[3]) for t in prepared])
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order]


def _retrieved(table: tuple[np.ndarray, np.ndarray], signature: np.ndarray) -> np.ndarray:
    """Templates that share a band with a signature."""
    keys, owner = table
    lo, hi = np.searchsorted(keys, signature, "left"), np.searchsorted(keys, signature, "right")
    return np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi) if b > a] or [owner[:0]]))


def _best_passage(part: np.ndarray, shingle_set: np.ndarray, w: int) -> tuple[float, int, int]:
    """(containment, first, last) of the passage of ``w`` shingles of ``part``, from any start, that holds most of a template's shingles; of equal ones the first. first and last are matched places."""
    at = np.flatnonzero(np.isin(part, shingle_set))
    held, left, best = {}, 0, (0, 0, 0)
    for right, p in enumerate(at.tolist()):
        held[part[p]] = held.get(part[p], 0) + 1
        while at[left] <= p - w:
            x = part[at[left]]
            held[x] -= 1
            if not held[x]:
                del held[x]
            left += 1
        if len(held) > best[0]:
            best = (len(held), int(at[left]), p)
    return best[0] / len(shingle_set), best[1], best[2]


def _rivals(prepared: list[tuple], least: float) -> dict[str, list[tuple]]:
    """(name, shingle set) of the siblings of each template: those that hold ``least`` of its shingles and have ``least`` of theirs in it, as other versions of one notice do."""
    if not prepared:
        return {}
    sets = [t[2] for t in prepared]
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out: dict[str, list[tuple]] = {}
    for a, x in enumerate(sets):  # how many of its shingles each other template holds, from the lists of those that hold one
        lo, n = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right") - np.searchsorted(flat, x, "left")
        holders = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        near = np.flatnonzero(np.bincount(holders, minlength=len(sets)) >= least * np.maximum(sizes, len(x)))
        if len(near) > 1:
            out[prepared[a][0]] = [(prepared[b][0], sets[b]) for b in near.tolist() if b != a]
    return out


def license_hits(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = 0.75, bands: int = BANDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Which texts hold which license template: (id, template, start, n_words, containment, rival), the best passage for each document and template.

    A template of at most w = 2**c five-word shingles (A-Z folded) is held by a passage of w shingles, from any start, if that has ``least`` or more of the template's shingles. Texts are
    seen in windows of 2w shingles, each w after the last, so every such passage lies in one. A window around a match has a Jaccard similarity of at least 0.17 to the template, and collides
    with it in one of 64 bands of one MinHash value with probability above 1 - 1e-5. Retrieval is a look-up of the window's bands in a sorted table of (band, value) of the class; retrieved templates are then verified by exact
    containment at all starts. A window without any shingle of a template of its class can't collide and gets no signature; this is known from one look-up a shingle.
    start and n_words (of words that count) reach from the first matched shingle to the last.

    Words count without punctuation at their ends, and those of punctuation only don't count. Templates that differ in a few words (versions of one
    notice) are all found at one place; ``rival`` names the one that holds more of its shingles there, and is null where the template itself
    is unbeaten. A passage without rival goes before others, so a document that holds both notices has both without rival.

    ``templates`` is name -> text, or a table (name, text); TEMPLATES by default. They go to every task: license texts, thousands at most. Whole texts are read in one pass without a shuffle,
    very long ones too. Null, empty and short texts and null templates have no hits; equal rows have a result each; other columns are ignored; an empty table gives no rows.
    """
    if isinstance(templates, DataFrame):
        templates = {r["name"]: r["text"] for r in templates.select("name", "text").toLocalIterator()}
    prepared = _prepared(TEMPLATES if templates is None else templates, bands)
    params = _hash_params(bands)
    classes = {}
    for t in prepared:
        classes.setdefault(t[1], []).append(t)
    tables = {c: _band_table(ts) for c, ts in classes.items()}
    vocabulary = {c: np.unique(np.concatenate([t[2] for t in ts])) for c, ts in classes.items()}
    every = np.unique(np.concatenate(list(vocabulary.values()))) if vocabulary else np.zeros(0, np.uint64)
    bits = np.zeros(1 << 16, bool)
    bits[(every & np.uint64(0xFFFF)).astype(np.int64)] = True
    kind = dict(docs.dtypes)[id_col]
    siblings = _rivals(prepared, least)

    def rival(own: np.ndarray, start: int, w: int, name: str, shingle_set: np.ndarray) -> str | None:
        if name not in siblings:
            return None
        near = np.unique(own[max(start - w, 0) : start + 2 * w])
        held = lambda x: len(np.intersect1d(near, x, assume_unique=True)) / len(x)
        other, better = max(((held(x), n) for n, x in siblings[name]))[::-1]
        return other if better > held(shingle_set) else None

    def scanned(own: np.ndarray, spots: np.ndarray) -> dict[str, tuple]:
        best: dict[str, tuple] = {}
        for c, ts in classes.items():
            w = 1 << c
            touched = spots[np.isin(own[spots], vocabulary[c])] // w
            for block in np.unique(np.maximum(np.concatenate([touched, touched - 1]), 0)).tolist():
                part = own[block * w : block * w + 2 * w]
                for t in _retrieved(tables[c], _signature(np.unique(part), params)):
                    name, _, shingle_set, _ = ts[t]
                    share, first, last = _best_passage(part, shingle_set, w)
                    if share < least:
                        continue
                    other = rival(own, block * w + first, w, name, shingle_set)
                    found = (other is None, share, -(block * w + first), last - first, other)
                    if name not in best or found[:3] > best[name][:3]:
                        best[name] = found
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, _, data, off in textvec.chunks(batch.column(1)):
                hashes, word_at = textvec.word_hashes(data, off, bare=True)
                sh, to = textvec.shingles(hashes, word_at)
                spots = np.flatnonzero(bits[(sh & np.uint64(0xFFFF)).astype(np.int64)])
                spots = spots[np.isin(sh[spots], every)]
                owner = np.searchsorted(to, spots, "right") - 1
                for d in np.unique(owner):
                    for name, (_, share, start, n, other) in sorted(scanned(sh[to[d] : to[d + 1]], spots[owner == d] - to[d]).items()):
                        at.append(i + int(d))
                        rows.append((name, -start, min(n + 5, int(word_at[d + 1] - word_at[d])), share, other))
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], ["id", "template", "start", "n_words", "containment", "rival"])

    found = docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, f"id {kind}, template string, start long, n_words long, containment double, rival string")
    return found.withColumnRenamed("id", id_col)

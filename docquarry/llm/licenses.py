"""License scans: MinHash bands over text windows, verified by exact containment.

A template is the set of its WIDTH-word shingles. Each document is cut into
overlapping windows as long as the templates, for each of their lengths, a
quarter apart; windows without a shingle of any template are passed over, as
they can contain none. A window's MinHash bands retrieve the templates that
share a band. With BANDS bands of ROWS rows, a window of Jaccard similarity
LEAST_JACCARD with a template meets it with probability hit_probability(), over
0.9999; a window a quarter of whose stride is off and that contains CONTAINMENT
of a template is more similar than that. What is retrieved is verified: a match
holds CONTAINMENT of the template's shingles within the window and a quarter of
its length on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytesops import U, blocks, mix, randoms
from docquarry.llm.decontaminate import word_spans

WIDTH = 5
CONTAINMENT = 0.75
BANDS, ROWS = 64, 2
LEAST_JACCARD = 0.4
_BITS = 20

#: Notices by which texts state their license, by SPDX id.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
)

_PLACE = randoms(WIDTH, 53) | U(1)
_XOR, _MUL = randoms(BANDS * ROWS, 59), randoms(BANDS * ROWS, 61) | U(1)


def hit_probability(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """That two sets of this similarity share a band."""
    return 1 - (1 - jaccard**rows) ** bands


def word_shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the WIDTH words from each word on."""
    n = len(hashes) - WIDTH + 1
    return mix(sum((hashes[j : n + j] * _PLACE[j] for j in range(WIDTH)), np.zeros(n, np.uint64))) if n > 0 else np.zeros(0, np.uint64)


def band_keys(minima: np.ndarray, size: int) -> np.ndarray:
    """(BANDS, sets) keys of (BANDS * ROWS, sets) minima, for windows of one size."""
    m = minima.reshape(BANDS, ROWS, -1)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) * U(131) + U(size))[:, None], (BANDS, m.shape[2]))
    for r in range(ROWS):
        key = mix(key * U(3) + m[:, r])
    return key


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names, self.texts, self.sets, sizes = [], [], [], []
        for name, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            s = word_shingles(word_spans(data, np.array([0, len(data)]))[0])
            if not len(s):
                raise ValueError(f"a template needs {WIDTH} words: {text}")
            self.names.append(name)
            self.texts.append(text)
            self.sets.append(np.unique(s))
            sizes.append(len(s))  # in shingles
        self.size = np.array(sizes)
        self.known = np.unique(np.concatenate(self.sets))
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.known >> U(64 - _BITS)] = True
        keys = [band_keys(np.array([((s ^ x) * m).min() for x, m in zip(_XOR, _MUL, strict=True)])[:, None], n)[:, 0] for s, n in zip(self.sets, sizes, strict=True)]
        found = sorted((k, i) for i, ks in enumerate(keys) for k in ks.tolist())
        self.key, self.of = np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found])

    def _windows(self, hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows of n shingles, a quarter apart, that hold a hit; lo, hi bound the hit's text."""
        step = max(1, n // 4)
        last = np.maximum((hi - lo - n + step - 1) // step, 0)  # the last window may reach beyond the end
        a, b = np.maximum((hits - lo - n) // step + 1, 0), np.minimum((hits - lo) // step, last)
        count = np.maximum(b - a + 1, 0)
        at = np.repeat(a - np.append(0, np.cumsum(count))[:-1], count) + np.arange(int(count.sum()))
        return np.unique(np.repeat(lo, count) + at * step)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """{(text, template): (containment, first word, end word)}: the best match of each, of equal ones the first."""
        s = word_shingles(hashes)
        at = np.flatnonzero(self.maybe[s >> U(64 - _BITS)])
        ok = np.isin(s[at], self.known)
        text = np.searchsorted(first, at, "right") - 1
        ok &= at + WIDTH <= first[text + 1]
        hits, text = at[ok], text[ok]
        found: dict = {}
        if not len(hits):
            return found
        lo, hi = first[text], first[text + 1] - WIDTH + 1
        for n in np.unique(self.size).tolist():
            starts = self._windows(hits, lo, hi, n)
            texts = np.searchsorted(first, starts, "right") - 1
            ends = np.minimum(starts + n, first[texts + 1] - WIDTH + 1)
            starts, ends, texts = starts[ends > starts], ends[ends > starts], texts[ends > starts]
            for i in range(0, len(starts), 2048):
                a, b, t = starts[i : i + 2048], ends[i : i + 2048], texts[i : i + 2048]
                own = np.repeat(a - np.append(0, np.cumsum(b - a))[:-1], b - a) + np.arange(int((b - a).sum()))
                cut = np.append(0, np.cumsum(b - a))[:-1]
                minima = np.stack([np.minimum.reduceat((s[own] ^ x) * m, cut) for x, m in zip(_XOR, _MUL, strict=True)])
                keys = band_keys(minima, n)
                k = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
                pairs = set()
                for j, w in zip(k[self.key[k] == keys].tolist(), np.nonzero(self.key[k] == keys)[1].tolist(), strict=True):
                    x = self.key[j]
                    while j < len(self.key) and self.key[j] == x:
                        pairs.add((w, int(self.of[j])))
                        j += 1
                for w, template in sorted(pairs):
                    self._verify(found, s, first, int(t[w]), int(a[w]), n, template)
        return found

    def _verify(self, found: dict, s: np.ndarray, first: np.ndarray, text: int, start: int, n: int, template: int) -> None:
        begin = max(int(first[text]), start - max(1, n // 4))
        end = min(int(first[text + 1]) - WIDTH + 1, start + n + max(1, n // 4))
        own = np.isin(s[begin:end], self.sets[template])
        share = len(np.unique(s[begin:end][own])) / len(self.sets[template])
        if share >= CONTAINMENT:
            at = np.flatnonzero(own)
            match = (-share, begin + int(at[0]), begin + int(at[-1]) + WIDTH)
            old = found.get((text, template))
            found[text, template] = match if old is None else min(old, match)


def _scan(templates):
    def run(batches):
        index = templates.value
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(1)):
                hashes, starts, ends, first = word_spans(data, offsets)
                rows = [
                    (batch.column(0)[lo + t].as_py(), index.names[i], i, -share, int(starts[a] - offsets[t]), int(ends[b - 1] - offsets[t]))
                    for (t, i), (share, a, b) in sorted(index.search(hashes, first).items())
                ]
                if rows:
                    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "license", "template", "containment", "start_byte", "end_byte"])

    return run


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, license, template, containment, start_byte, end_byte: one row for each row of docs and template it contains.

    Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased;
    containment is the share of the template's shingles in the best stretch, of
    equal stretches the first. Null and empty texts contain nothing. Templates
    (name, text) need WIDTH words; they are sent to the tasks and are a fixed
    list. Rows that repeat an id each give their rows; ids may be null. Other
    columns are ignored; an empty table gives an empty result.
    """
    index = docs.sparkSession.sparkContext.broadcast(Templates(templates))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(index), "doc_id long, license string, template int, containment double, start_byte long, end_byte long")

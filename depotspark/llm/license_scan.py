"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

A template is a set of 5-word shingles. For templates of similar length the text is cut into windows that overlap, in
steps of a quarter of that length, long enough that every place a template can stand lies whole in one window. Each
window has one minimum under each of b hash functions (bands of one row); a window is a candidate for a template where
any of them meet. b follows from the least Jaccard similarity that a window with enough of the template has, so that a
match is missed with probability below `MISS`. Candidates are verified: at least `share` of the template's shingles
must stand in the window, in one text. Minima are taken over many texts at once; a window over two texts is harmless.

Words are runs of letters and digits without regard to case, so punctuation and quotes don't matter. Numbers do: each
number of a template (a version) must stand in the matched part after a word that it follows in the template, so one
version is never taken for another.

Templates are a short parameter and travel with the code; texts are scanned whole, row by row, in linear time.

Defined cases: null and empty texts match nothing; texts of fewer than five words have no shingle; a license found in
several places is one row entry with its best containment; where BSD-3-Clause stands, BSD-2-Clause isn't reported, and of
licenses that match at one place only the best; repeated rows give repeated results; other columns are
ignored, also those of the names made here; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from depotspark.llm.common import table
from depotspark.llm.tokens import PUNCTUATION, mix, slices, words

MISS = 1e-6
K = 5
#: License statements by SPDX id, as commonly written in sources and pages. Fixed texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "EPL-1.0": ["made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "BSD-2-Clause": ["2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."],
}
#: Licenses all of whose clauses stand in another one.
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}
_U = np.uint64


def positional(h: np.ndarray) -> np.ndarray:
    """Hash of the five words from each word on."""
    n = h.size - K + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K if n > 0 else 0):
            out += h[i : i + n] * _U(0x9E3779B97F4A7C15 + 2 * 0x1B873593 * i | 1)
    return mix(out)


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text]), PUNCTUATION)[0]


def numbers(text: str) -> list[set[tuple[int, int]]]:
    """For each number of a template, what may say it, a word and the digits after it: its words and their hash."""
    found: dict[str, set[tuple[int, int]]] = {}
    for m in re.finditer(r"[A-Za-z]+[^A-Za-z0-9]*([0-9]+(?:\.[0-9]+)*)(?![A-Za-z0-9])", text):
        h = _hashes(m[0])
        found.setdefault(m[1], set()).add((h.size, phrase(h)))
    return list(found.values())


def phrases(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on."""
    out = np.full(max(0, h.size - n + 1), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n if out.size else 0):
            out = mix(out + h[i : h.size - n + 1 + i])
    return out


def phrase(h: np.ndarray) -> int:
    return int(phrases(h, h.size)[0])


class Template:
    def __init__(self, name: str, text: str):
        h = _hashes(text)
        self.name, self.shingles, self.numbers = name, np.unique(positional(h)), numbers(text)
        self.lengths = {n for x in self.numbers for n, _ in x}

    def like(self, other: Template) -> bool:
        """Half of the shorter one's shingles or more stand in both."""
        return 2 * np.isin(self.shingles, other.shingles).sum() >= min(self.shingles.size, other.shingles.size)

    def containment(self, part: np.ndarray, h: np.ndarray) -> float:
        """Share of the shingles that stand in part; 0 where a number is missing among the words h of the part."""
        c = float(np.isin(self.shingles, part).sum()) / self.shingles.size if part.size else 0.0
        if c and self.numbers:
            said = {n: phrases(h, n) for n in self.lengths}
            if not all(any((said[n] == np.uint64(p)).any() for n, p in x) for x in self.numbers):
                return 0.0
        return c


class Family:
    """Templates of similar length: step, blocks of a window, bands and the templates' minima."""

    def __init__(self, members: list[Template], share: float):
        self.members = members
        most = max(t.shingles.size for t in members)
        self.step = max(1, (most + K - 1) // 4)
        self.blocks = -(-(most + self.step - 1) // self.step)
        window = self.blocks * self.step
        need = [(t.shingles.size, math.ceil(share * t.shingles.size - 1e-9)) for t in members]
        least = min(k / (window + t - k) for t, k in need)
        self.bands = 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))
        r = np.random.default_rng(5)
        self.odd = r.integers(1, 1 << 62, self.bands, dtype=np.uint64) * _U(2) + _U(1)
        with np.errstate(over="ignore"):
            self.minima = np.array([[(t.shingles * a).min() for a in self.odd] for t in members])  # members x bands

    def candidates(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(member, first and last shingle) of windows of the positional shingles s that share a minimum."""
        starts = np.arange(0, s.size, self.step)
        hit = np.zeros((len(self.members), starts.size), dtype=bool)
        with np.errstate(over="ignore"):
            for k, a in enumerate(self.odd):
                block = np.minimum.reduceat(s * a, starts) if self.step > 1 else s * a
                low = block.copy()
                for j in range(1, self.blocks):
                    np.minimum(low[:-j], block[j:], out=low[:-j])
                for m in range(len(self.members)):
                    hit[m] |= low == self.minima[m, k]
        return [(int(m), int(starts[w]), int(starts[w]) + self.blocks * self.step) for m, w in zip(*np.nonzero(hit))]


def families(templates: dict[str, list[str]], share: float) -> list[Family]:
    by: dict[int, list[Template]] = {}
    for name, texts in templates.items():
        for t in (Template(name, x) for x in texts):
            if t.shingles.size:
                by.setdefault(round(math.log(t.shingles.size, 1.5)), []).append(t)
    return [Family(m, share) for _, m in sorted(by.items())]


def matches(h: np.ndarray, first: np.ndarray, known: list[Family], share: float) -> list[dict[str, float]]:
    """Best containment of each license, for each text of a slice; h: word hashes, first: first word of each text."""
    found: list[dict[str, tuple[float, int, int, Template]]] = [{} for _ in range(first.size - 1)]  # containment and place
    s = positional(h)
    if not s.size:
        return [{} for _ in found]
    for f in known:
        for m, a, z in f.candidates(s):
            t = f.members[m]
            # the texts that the window touches; a shingle must end within its text
            for d in range(int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, min(z, h.size) - 1, side="right"))):
                if t.name in found[d] and found[d][t.name][0] == 1.0:
                    continue  # no window can be better
                lo, hi = max(a, int(first[d])), max(0, min(z, int(first[d + 1]) - K + 1))
                c = t.containment(s[lo:hi], h[lo : hi + K - 1])
                if c >= share and (t.name not in found[d] or c > found[d][t.name][0]):
                    found[d][t.name] = c, lo, hi, t
    # where the longer license stands, the clauses that it shares with a shorter one don't name that one
    # and of licenses that share most of their words one place names the one that it holds most of
    beaten = lambda x, c, a, z, t: any(d > c and b < z and a < y and t.like(u) for d, b, y, u in x.values())
    return [{name: v[0] for name, v in x.items() if CONTAINED.get(name) not in x and not beaten(x, *v)} for x in found]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, share: float = 0.8) -> DataFrame:
    """doc_id, n_licenses, licenses (ids, sorted, comma-joined), containment (the best) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(families(templates or TEMPLATES, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1)):
                h, first, _ = words(b.column(1).slice(s, e - s), PUNCTUATION)
                found = matches(h, first, shared.value, share)
                names, best = [sorted(x) for x in found], [max(x.values(), default=0.0) for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names], pa.string()), pa.array(best, pa.float64())], names=["doc_id", "n_licenses", "licenses", "containment"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_licenses long, licenses string, containment double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

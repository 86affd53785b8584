"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits, A-Z lower-cased. Every K consecutive words are hashed; of each WINDOW consecutive
hashes the smallest is a fingerprint, so K + WINDOW - 1 words in common always share one. An inverted index leads from
a fingerprint to its places in the templates; templates of fewer than SHORT words are instead looked for word by word,
wherever 2 n words of a text have enough of the n words of a template to cover it. Hits of a text on neighbouring diagonals of one template are a candidate,
whose words are aligned with the template's within a band, again on either side of each alignment while hits are left.
A match is reported if it covers enough of the template.

Edge cases: null, empty and word-free texts have no match; templates of fewer than K words are refused; of overlapping
matches the one with most words stays, ties go to the sooner template; repeated rows agree; an empty table gives no
rows; input columns named like an output are replaced. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from variq.llm import _text

K, WINDOW, BAND, SHORT = 3, 2, 6, 8
#: Public license notices and texts (opening or operative parts). Fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-notice": "Distributed under the BSD 3-Clause License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def _words(texts: pa.Array):
    data, offsets = _text.utf8(texts)
    low = _text.lower_ascii(data)
    starts, ends, doc = _text.runs(_WORD[low], offsets)
    return data, offsets, starts, ends, doc, _text.span_hashes(low, starts, ends)


def winnow(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the K-word hashes of each text (the rightmost of equal ones in a window)."""
    grams = _text.window_hashes(hashes, K)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    good = doc[: len(grams)] == doc[K - 1 :]
    pick = np.zeros(len(grams), bool)
    both = good[:-1] & good[1:] & (doc[: len(grams) - 1] == doc[1 : len(grams)])
    left = np.flatnonzero(both)
    pick[np.where(grams[left] < grams[left + 1], left, left + 1)] = True
    alone = good & ~np.append(both, False) & ~np.append(False, both)
    return np.flatnonzero(pick | alone), grams


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        _, _, starts, _, doc, hashes = _words(pa.array(list(templates.values())))
        self.words = [hashes[doc == t] for t in range(len(self.names))]
        if min(map(len, self.words), default=K) < K:
            raise ValueError(f"a template needs {K} words")
        # Winnowed by the same rule as texts: a run of K + WINDOW - 1 words in common has the same fingerprint in both.
        at, grams = winnow(hashes, doc)
        order = at[np.argsort(grams[at], kind="stable")]
        base = np.searchsorted(doc, np.arange(len(self.names)))
        self.keys, self.template = grams[order], doc[order]
        self.place = order - base[self.template]


def short_hits(index: Index, hashes: np.ndarray, doc: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, template, place) of single words, where a text's words can cover a template of fewer than SHORT words."""
    out = [(np.zeros(0, np.int64),) * 3]
    for t, goal in enumerate(index.words):
        if len(goal) >= SHORT:
            continue
        width = 2 * len(goal)
        enough = np.zeros(len(hashes), np.int64)
        stop = np.minimum(np.arange(len(hashes)) + width, np.searchsorted(doc, doc, "right"))
        for one, n in zip(*np.unique(goal, return_counts=True), strict=True):
            total = np.concatenate([[0], np.cumsum(hashes == one)])
            enough += np.minimum(total[stop] - total[:-1], n)
        first = np.flatnonzero(enough >= coverage * len(goal))
        live = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(live, first, 1)
        np.add.at(live, stop[first], -1)
        near = np.cumsum(live[:-1]) > 0
        for place, one in enumerate(goal):
            at = np.flatnonzero(near & (hashes == one))
            out.append((at, np.full(len(at), t), np.full(len(at), place)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Words matched and the span [start, end) of text words of the best local alignment near diagonal `shift`.

    Cell (i, j) pairs template word i with text word i + shift + j - band. Match 1, mismatch or gap -1.
    """
    width = 2 * band + 1
    zero = (0, 0, -1, -1)  # score, matched, start, end
    above, best = [zero] * (width + 1), zero
    for i, word in enumerate(template.tolist()):
        row, beside = [], zero
        for j in range(width):
            at = i + shift + j - band
            one = zero
            if 0 <= at < len(text):
                same = int(text[at]) == word
                s, m, a, _ = above[j]
                one = (s + 1, m + 1, a if s > 0 else at, at + 1) if same else (s - 1, m, a, at + 1)
                for s, m, a, e in (above[j + 1], beside):
                    if s - 1 > one[0]:
                        one = (s - 1, m, a, e)
                if one[0] <= 0:
                    one = zero
            if one[0] > best[0]:
                best = one
            row.append(one)
            beside = one
        above = [*row, zero]
    return best[1], best[2], best[3]


def copies(hashes: np.ndarray, goal: np.ndarray, hits: np.ndarray, first: int, last: int, start: int, end: int, coverage: float) -> list[tuple[int, int, int]]:
    """(words matched, start, end) of the disjoint copies of a template on diagonals first to last of a text [start, end)."""
    half = (last - first) // 2
    out, todo = [], [(max(start, first - BAND), min(end, last + len(goal) + BAND))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < coverage * len(goal) or not ((hits >= lo) & (hits < hi)).any():
            continue
        matched, s, e = align(hashes[lo:hi], goal, first + half - lo, BAND + half + (last - first) % 2)
        if matched >= coverage * len(goal):
            out.append((matched, lo + s, lo + e))
        if matched:
            todo += [(lo, lo + s), (lo + e, hi)]
    return out


def find(index: Index, texts: pa.Array, coverage: float) -> list[list[tuple[str, int, int, float]]]:
    """(template, start, end, share of its words matched) of each text."""
    data, offsets, starts, ends, doc, hashes = _words(texts)
    out: list[list] = [[] for _ in range(len(texts))]
    at, grams = winnow(hashes, doc)
    lo = np.searchsorted(index.keys, grams[at], "left")
    count = np.searchsorted(index.keys, grams[at], "right") - lo
    hit = _text.ragged(lo, count)
    small, of, place = short_hits(index, hashes, doc, coverage)
    word, template = np.concatenate([np.repeat(at, count), small]), np.concatenate([index.template[hit], of])
    shift = word - np.concatenate([index.place[hit], place])
    if not len(word):
        return out
    order = np.lexsort((shift, template, doc[word]))
    word, template, shift = word[order], template[order], shift[order]
    d = doc[word]
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (template[1:] != template[:-1]) | (shift[1:] - shift[:-1] > BAND)]))
    base = np.searchsorted(doc, np.arange(len(texts) + 1))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    found: dict[int, list] = {}
    for a, b in zip(cut, np.append(cut[1:], len(word)), strict=True):
        k, t = int(d[a]), int(template[a])
        goal = index.words[t]
        # A copy's diagonals span less than its template's length: windows of twice that, overlapping by half, hold each.
        for first in range(int(shift[a]), max(int(shift[b - 1]) - len(goal), int(shift[a]) + 1), len(goal)):
            x, y = a + np.searchsorted(shift[a:b], [first, first + 2 * len(goal) + 1])
            if x < y:
                found.setdefault(k, []).extend((m, -t, s, e, m / len(goal)) for m, s, e in copies(hashes, goal, word[x:y], int(shift[x]), int(shift[y - 1]), base[k], base[k + 1], coverage))
    for k, matches in found.items():
        taken: list[tuple[int, int]] = []
        for _, t, s, e, share in sorted(matches, reverse=True):
            i = bisect.bisect_left(taken, (s, e))
            if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                taken.insert(i, (s, e))
                out[k].append((index.names[-t], int(lead[starts[s]] - lead[offsets[k]]), int(lead[ends[e - 1]] - lead[offsets[k]]), share))
        out[k].sort(key=lambda x: (x[1], x[2]))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, text: str = "text", coverage: float = 0.8) -> DataFrame:
    """The rows with n_licenses, best_license, best_coverage and license_spans (template:start:end:coverage, comma-joined)."""
    index = Index(templates)
    made = [("n_licenses", T.LongType()), ("best_license", T.StringType()), ("best_coverage", T.DoubleType()), ("license_spans", T.StringType())]
    keep = docs.drop(*[a for a, _ in made])
    schema = T.StructType([*keep.schema.fields, *[T.StructField(a, b) for a, b in made]])

    def run(batches):
        for batch in _text.chunks(batches, text):
            found = find(index, batch.column(text), coverage)
            best = [max(x, key=lambda m: (m[3], -m[1]), default=None) for x in found]
            more = [
                pa.array([len(x) for x in found], pa.int64()), pa.array([b and b[0] for b in best], pa.string()), pa.array([b and float(b[3]) for b in best], pa.float64()),
                pa.array([",".join(f"{n}:{a}:{b}:{c:.3f}" for n, a, b, c in x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *[a for a, _ in made]])

    return keep.mapInArrow(run, schema)

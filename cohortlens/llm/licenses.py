"""Licence scans: Dice coefficient over word bigrams between passages and licence templates."""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlens.llm.bytestrings import Rolling, lower_ascii, runs, text_bytes, with_text_columns, word_spans

THRESHOLD = 0.8

# Notices by which texts state their licence, and the SPDX id of each.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
}

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_PUBLIC = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FSF_2007 = f"Copyright (C) 2007 Free Software Foundation, Inc. {_PUBLIC}"

# Whole texts of the short licences, and the opening passages of the long ones.
TEXTS = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",),
    "MIT": (
        TEMPLATES["MIT"][2] + " The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "BSD-3-Clause": (
        _REDISTRIBUTION + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. " + _DISCLAIMER,
    ),
    "BSD-2-Clause": (_REDISTRIBUTION + _DISCLAIMER,),
    "GPL-3.0": (f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF_2007}",),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_FSF_2007}",
        TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU Affero General"),
    ),
    "LGPL-3.0": (
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF_2007}",
        TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU Lesser General"),
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates",),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal Statement of Purpose"),
    **{
        f"CC-{code}-4.0": (f"Creative Commons {name} 4.0 International Public License By exercising the Licensed Rights",)
        for code, name in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
        )
    },
}

_BYTES = Rolling(31)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_LINE_FEED = 0x0A


@dataclass
class Templates:
    """Bigram sets and word counts of all templates, the bigrams of any of them in order, and which of those each holds."""

    ids: list[str]
    bigrams: list[set[int]]
    sizes: list[int]
    known: np.ndarray
    holds: list[np.ndarray]


def _bigrams(words: np.ndarray) -> np.ndarray:
    """The bigram that starts at each word but the last."""
    return words[:-1] * _SECOND + words[1:]


def _words(texts: pa.Array) -> list[np.ndarray]:
    data, ends = text_bytes(texts)
    starts, stops, counts = word_spans(lower_ascii(data), ends)
    words = _BYTES.between(_BYTES.prefix(lower_ascii(data)), starts, stops)
    return np.split(words, np.cumsum(counts)[:-1])


def build_templates(*templates: dict[str, tuple[str, ...]]) -> Templates:
    named = [(spdx, text) for group in templates for spdx, texts in group.items() for text in texts]
    words = _words(pa.array([text for _, text in named], pa.string()))
    own = [np.unique(_bigrams(x)) for x in words]
    known = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
    return Templates([spdx for spdx, _ in named], [set(x.tolist()) for x in own], [len(x) for x in words], known, [np.isin(known, x) for x in own])


def _fewest(size: int, threshold: float) -> float:
    """Fewest bigrams that a passage shares with a template of `size` bigrams where it reaches `threshold`."""
    return threshold * size / (2 - threshold) - 1e-9


def _best(found: set[int], templates: Templates, threshold: float) -> tuple[float, str] | None:
    """The best template at `threshold` or above; ties go to the smaller id."""
    best = None
    for spdx, own in zip(templates.ids, templates.bigrams):
        # 2 |A and B| / (|A| + |B|) is at most 2 min / (|A| + |B|): sizes too far apart cannot reach it.
        if 2 * min(len(own), len(found)) < threshold * (len(own) + len(found)):
            continue
        score = 2 * len(own & found) / (len(own) + len(found))
        if score >= threshold and (best is None or (-score, spdx) < (-best[0], best[1])):
            best = (score, spdx)
    return best


def _windows(templates: Templates, threshold: float, bigrams: np.ndarray, at: np.ndarray, slot: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """(score, licence, first word, past word) of windows of each template's size that start at one of its bigrams.

    `at` are the places of known bigrams, `slot` which ones they are, `ends` where each word's text ends.
    """
    found = []
    for spdx, own, size, holds in zip(templates.ids, templates.bigrams, templates.sizes, templates.holds):
        starts = at[holds[slot]]
        shared = np.searchsorted(starts, starts + size - 1) - np.arange(len(starts))
        for a in starts[shared >= _fewest(len(own), threshold)].tolist():
            past = min(a + size, int(ends[a]))
            window = set(bigrams[a : past - 1].tolist())
            score = 2 * len(own & window) / (len(own) + len(window))
            if score >= threshold:
                found.append((score, spdx, a, past))
    return found


def _without_overlaps(passages: list[tuple]) -> list[tuple]:
    """Best passages first, then longer ones, then smaller ids; those that overlap a chosen one are left out."""
    chosen: list[tuple] = []
    spans: list[tuple[int, int]] = []
    for passage in sorted(passages, key=lambda x: (-x[0], x[2] - x[3], x[1], x[2])):
        _, _, a, past = passage
        place = bisect(spans, (a, past))
        if (place == 0 or spans[place - 1][1] <= a) and (place == len(spans) or past <= spans[place][0]):
            spans.insert(place, (a, past))
            chosen.append(passage)
    return chosen


def _scan(templates: Templates, threshold: float, windows: bool, texts: pa.Array) -> list[pa.Array]:
    licences = []
    fewest = max(1, math.ceil(min((_fewest(len(own), threshold) for own in templates.bigrams), default=1)))
    for first, past, data, text_ends in runs(texts):
        lowered = lower_ascii(data)
        starts, stops, counts = word_spans(lowered, text_ends)
        words = _BYTES.between(_BYTES.prefix(lowered), starts, stops)
        owner = np.repeat(np.arange(past - first), counts)
        # A passage is a line, so passages change at line feeds and at text ends.
        line = np.searchsorted(np.flatnonzero(data == _LINE_FEED), starts) + owner
        found: list[dict[str, float]] = [{} for _ in range(past - first)]
        if len(words) > 1 and len(templates.known):
            bigrams = _bigrams(words)
            known = templates.known
            slot = np.minimum(np.searchsorted(known, bigrams), len(known) - 1)
            hits = known[slot] == bigrams
            hit, shared = np.unique(line[:-1][(line[:-1] == line[1:]) & hits], return_counts=True)
            hit = hit[shared >= fewest]
            low, high = np.searchsorted(line, hit), np.searchsorted(line, hit, side="right")
            passages = []
            for a, b in zip(low.tolist(), high.tolist()):
                best = _best(set(bigrams[a : b - 1].tolist()), templates, threshold)
                if best:
                    passages.append((*best, a, b))
            if windows:
                at = np.flatnonzero((owner[:-1] == owner[1:]) & hits)
                passages += _windows(templates, threshold, bigrams, at, slot[at], np.cumsum(counts)[owner])
                passages = _without_overlaps(passages)
            for score, spdx, a, _ in passages:
                own = found[owner[a]]
                own[spdx] = max(score, own.get(spdx, 0.0))
        licences += [sorted(x.items(), key=lambda pair: (-pair[1], pair[0])) for x in found]
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64())]))
    return [pa.array([[{"license": a, "score": s} for a, s in x] for x in licences], kind)]


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
    texts: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Adds `licenses`: the licences a document states, best first, each with its highest score.

    Texts are normalised to lower-case words (A-Z lowered; runs of `0-9`, `a-z` and
    characters beyond ASCII). Each line's set of word bigrams is compared with each
    template's by Dice coefficient; templates whose size alone rules out `threshold` are
    skipped, and a line counts for its best template, ties to the smaller id. Where `texts`,
    further templates, are given, windows of each template's number of words that start at
    one of its bigrams are compared too, across lines; of lines and windows that overlap,
    the best counts, then the longest, then the smaller id. Lines of
    fewer than two words, null and empty texts state nothing. One pass, no shuffle;
    repeated documents are scanned alike; an input column `licenses` is replaced.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        built = build_templates(templates, texts or {})
        return lambda values: _scan(built, threshold, texts is not None, values)

    return with_text_columns(docs, text, make, {"licenses": "array<struct<license:string,score:double>>"}, keep)

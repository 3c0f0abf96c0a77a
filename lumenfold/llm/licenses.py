"""Licence scans: texts against licence templates by the Dice coefficient over word bigrams.

A text, each of its lines and each run of its words are normalised (lower case,
runs of other signs as one space) and compared with the templates. Two multisets of ``a`` and ``b``
bigrams have a coefficient of at most ``2 min(a, b) / (a + b)``, so only
templates whose size is within the bounds for the threshold are compared. A run of
words has its best coefficient when it starts and ends with bigrams of the
template, so only such runs are tried: all of them, within the size bounds.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._words import pieces

#: fixed values: public licence notices by SPDX name
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "proprietary": ["All rights reserved."],
}
THRESHOLD = 0.8
_NOT_WORD = re.compile(r"[^0-9a-z]+")


def bigrams(text: str) -> Counter:
    """Word bigrams of a normalised text; one word is one gram, none is empty."""
    words = _NOT_WORD.sub(" ", text.lower()).split()
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([(w,) for w in words])


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def runs(grams: list[tuple], at: list[int], template: Counter, threshold: float) -> Iterator[tuple[float, int, int]]:
    """``dice, start, end`` of the best run from each start that reaches the threshold; ``at`` has the places of the template's bigrams."""
    size = template.total()
    longest = size * (2 - threshold) / threshold + 1e-9
    least = ceil(threshold * size / (2 - threshold) - 1e-9)  # bigrams that a run must share
    for k, start in enumerate(at):
        if k + least > len(at):
            return
        if at[k + least - 1] - start + 1 > longest:
            continue
        left, common, top = dict(template), 0, (0.0, start, start)
        for end in at[k:]:
            if end - start + 1 > longest:
                break
            if left[grams[end]]:
                left[grams[end]] -= 1
                common += 1
                top = max(top, (2 * common / (size + end - start + 1), start, end), key=lambda x: x[0])
        if top[0] >= threshold:
            yield top


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, n_matches``, one row per input row.

    The best match over the whole text, its lines and its runs of words (the first
    template on ties), and how many of these segments reach the threshold. Of runs that overlap
    the best counts; a run inside a matching line, and a matching line inside a run
    that counts, don't count again. A null or empty
    text, or one without a match, has a null license, dice 0 and no matches.
    Repeated rows are scanned each on its own; an empty table gives none; bytes that
    are not UTF-8 count as other signs. Other columns are ignored.
    """
    known = sorted(((g.total(), i, name, g) for i, (name, g) in enumerate((n, bigrams(t)) for n, ts in (templates or TEMPLATES).items() for t in ts)), key=lambda x: x[:2])
    totals = [k[0] for k in known]
    vocabulary = {x for k in known for x in k[3]}

    def best(segment: str) -> tuple[float, int, str | None]:
        own = bigrams(segment)
        n = own.total()
        low, high = bisect_left(totals, n * threshold / (2 - threshold) - 1e-9), bisect_right(totals, n * (2 - threshold) / threshold + 1e-9)
        if not n or low >= high or vocabulary.isdisjoint(own):
            return 0.0, 0, None
        return max(((dice(own, g), -i, name) for _, i, name, g in known[low:high]), key=lambda x: x[:2])

    home: dict[tuple, list[int]] = {}
    for k, (*_, g) in enumerate(known):
        for x in g:
            home.setdefault(x, []).append(k)

    def wrapped(lines: list[str], matched: list[bool]) -> tuple[list[tuple[float, int, str]], list[bool]]:
        """Matching runs of words that no matching line holds, and which lines match and are in none of these."""
        words, spans = [], []
        for line in lines:
            start = len(words)
            words += _NOT_WORD.sub(" ", line.lower()).split()
            spans.append((start, len(words)))
        grams = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for i, x in enumerate(grams):
            for k in home.get(x, ()):
                places.setdefault(k, []).append(i)
        found = [(d, -known[k][1], start, end + 2, known[k][2]) for k, at in places.items() for d, start, end in runs(grams, at, known[k][3], threshold)]
        held = [x for x, m in zip(spans, matched, strict=True) if m]
        used: list[tuple[int, int]] = []
        out = []
        for d, i, start, end, name in sorted(found, key=lambda x: (-x[0], x[2] - x[3], -x[1], x[2])):
            if all(end <= u or start >= v for u, v in used) and not any(u <= start and end <= v for u, v in held):
                used.append((start, end))
                out.append((d, i, name))
        return out, [m and not any(u <= x and y <= v for u, v in used) for (x, y), m in zip(spans, matched, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            rows = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                lines = [x for x in text.split("\n") if x]
                segments = lines if len(lines) == 1 and lines[0] == text else [*lines, text]
                every = [m if m[2] and m[0] >= threshold else None for m in map(best, segments)]
                more, counted = wrapped(lines, [m is not None for m in every[: len(lines)]]) if lines else ([], [])
                found = [m for m in every if m] + more
                top = max(found, key=lambda m: m[:2], default=(0.0, 0, None))
                n_matches = sum(counted) + sum(m is not None for m in every[len(lines) :]) + len(more)
                rows.append((top[2], top[0], n_matches))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "license", "dice", "n_matches"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, dice double, n_matches long")

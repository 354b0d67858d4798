"""License scans: Dice coefficient over word bigrams, with size bounds.

Texts and templates are normalised alike: ASCII lower-case, punctuation to
blanks, words apart by blanks.  Units are each line of a text, the whole text,
and every window of words, across line breaks.  A unit with ``a`` distinct bigrams can reach ``2 * both / (a + b) >= t``
with a template of ``b`` only if ``t / (2 - t) <= a / b <= (2 - t) / t``; those
bounds come first, and only units that pass them for some template are compared.
The comparison is in integers, so no rounding decides.

Windows need not be tried all: a text must share as many bigrams with the
template as its smallest unit has, the best window begins with a shared bigram
that it has once, and it ends before its other bigrams are more than
``(2 - 2 * t) / t`` of the template's.

A window's later begins can at best share the bigrams that are still to come, so
the search ends where those can't beat what is found.

The templates are a parameter of fixed size, sent to the tasks once: short notices
(``TEMPLATES``) and the full public texts in ``license_texts``.  Documents are read
once and never shuffled.

Defined results: texts that are null, empty or have no unit of two words match
nothing (``license`` null, ``score`` 0, no ``licenses``).  Of equal scores the
first name in alphabetical order is ``license``.  ``line`` is the first line
with that score, from 0 (of a window, the line it begins in), or -1 for the whole
text.  Rows are judged alone, so
repeats and empty tables need no care; very long texts are read whole; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches
from .textvec import U, buffers, chunks, distinct, grams, words

#: Least Dice coefficient, in hundredths.
THRESHOLD = 80

# Public license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "LicenseRef-Reserved": ["All rights reserved."],
}

#: Full texts of public licenses, a file for each, by SPDX name.
FULL_TEXTS = Path(__file__).parent / "license_texts"


def default_templates() -> dict[str, list[str]]:
    """The notices and the full texts, by name."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for path in sorted(FULL_TEXTS.glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


class Templates:
    def __init__(self, templates: dict[str, list[str]] | None = None, threshold: int = THRESHOLD):
        self.threshold = threshold
        pairs = [(name, t) for name, ts in sorted((templates or default_templates()).items()) for t in ts]
        self.names = [name for name, _ in pairs]
        sets = [self._bigrams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in pairs]
        self.sizes = np.array([len(s) for s in sets])
        self.gram = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.of = self.gram[order], of[order]
        self.sets = [set(s.tolist()) for s in sets]
        # Sizes that some template allows.
        self.least = -(-threshold * self.sizes // (200 - threshold))
        self.most = (200 - threshold) * self.sizes // threshold

    @staticmethod
    def _bigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distinct(*grams(words(_FOLD[data], offs), 2, whole_if_short=False))

    def units(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(unit, template, hundredths of a percent) of all units at or above the threshold."""
        h, unit = self._bigrams(data, offs)
        n = np.bincount(unit, minlength=len(offs) - 1)
        fits = np.zeros(int(max(self.most.max(), n.max(initial=0))) + 1, bool)
        for lo, hi in zip(self.least, self.most, strict=True):
            fits[lo : hi + 1] = True
        use = fits[n][unit]
        h, unit = h[use], unit[use]
        lo, hi = np.searchsorted(self.gram, h, "left"), np.searchsorted(self.gram, h, "right")
        times = hi - lo
        if not times.sum():
            return []
        at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        cell, both = np.unique(np.repeat(unit, times) * len(self.names) + self.of[at], return_counts=True)
        u, t = cell // len(self.names), cell % len(self.names)
        a, b = n[u], self.sizes[t]
        ok = (a >= self.least[t]) & (a <= self.most[t]) & (200 * both >= self.threshold * (a + b))
        score = 20000 * both // np.maximum(a + b, 1)
        return list(zip(u[ok].tolist(), t[ok].tolist(), score[ok].tolist(), strict=True))

    def windows(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, template, hundredths of a percent, byte of its first word) of the best window of words, if at or above the threshold."""
        w = words(_FOLD[data], offs)
        h, row = grams(w, 2, whole_if_short=False)
        lo, hi = np.searchsorted(self.gram, h, "left"), np.searchsorted(self.gram, h, "right")
        hit = np.flatnonzero(lo < hi)
        lo, times = lo[hit], (hi - lo)[hit]
        at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        # An entry of the templates is one bigram of one template.
        entry = np.unique(np.repeat(row[hit], times) * len(self.gram) + at)
        cell, both = np.unique(entry // max(len(self.gram), 1) * len(self.names) + self.of[entry % max(len(self.gram), 1)], return_counts=True)
        cell = cell[both >= self.least[cell % len(self.names)]]
        first, out = np.searchsorted(row, np.arange(len(offs))), []
        have, own, after = -1, [], []
        for r, t in zip((cell // len(self.names)).tolist(), (cell % len(self.names)).tolist(), strict=True):
            if r != have:
                have, own = r, h[first[r] : first[r + 1]].tolist()
                after, last = [len(own)] * len(own), {}
                for i in range(len(own) - 1, -1, -1):
                    after[i] = last.get(own[i], len(own))
                    last[own[i]] = i
            score, begin = self._best(own, after, t)
            if begin >= 0:
                out.append((r, t, score, int(w.start[w.first[r] + begin])))
        return out

    def _best(self, own: list[int], after: list[int], t: int) -> tuple[int, int]:
        """Score and begin of the first best window; -1 without one."""
        wanted, size, best, begin = self.sets[t], int(self.sizes[t]), 0, -1
        most = (200 - 2 * self.threshold) * size // self.threshold
        # Distinct bigrams of the template from each place on.
        ahead, met = [0] * len(own), set()
        for i in range(len(own) - 1, -1, -1):
            if own[i] in wanted:
                met.add(own[i])
            ahead[i] = len(met)
        for i, g in enumerate(own):
            if 200 * ahead[i] < self.threshold * (ahead[i] + size) or 20000 * ahead[i] // (ahead[i] + size) <= best:
                break
            if g not in wanted:
                continue
            seen, both, other = set(), 0, 0
            # A window that has its first bigram again is no better than without its first word.
            for j in range(i, after[i]):
                x = own[j]
                if x in seen:
                    continue
                seen.add(x)
                if x in wanted:
                    both += 1
                    total = both + other + size
                    if 200 * both >= self.threshold * total and 20000 * both // total > best:
                        best, begin = 20000 * both // total, i
                    if both == size:
                        break
                else:
                    other += 1
                    if other > most:
                        break
            if best == 10000:
                break
        return best, begin

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[dict]:
        """For each row: its best license, score and line, and all licenses found."""
        rows = len(offs) - 1
        breaks = np.flatnonzero(data == 0x0A) + 1
        lines = np.unique(np.concatenate([offs, breaks]))
        # Rows without bytes share their offset with the next; they have no lines and keep the default.
        begin = np.searchsorted(lines, offs[:-1])
        found: list[list[tuple[int, str, int]]] = [[] for _ in range(rows)]
        starts = lines[:-1]
        for u, t, s in self.units(data, lines) if len(lines) > 1 else []:
            r = int(np.searchsorted(offs, starts[u], "right")) - 1
            found[r].append((-s, self.names[t], u - int(begin[r])))
        for r, t, s in self.units(data, offs) if len(data) else []:
            found[r].append((-s, self.names[t], -1))
        for r, t, s, byte in self.windows(data, offs) if len(data) else []:
            found[r].append((-s, self.names[t], int(np.searchsorted(lines, byte, "right")) - 1 - int(begin[r])))
        out = []
        for f in found:
            first = min(f, key=lambda x: (x[0], x[1], x[2] < 0, x[2])) if f else None
            out.append({"license": first[1] if first else None, "score": -first[0] / 10000 if first else 0.0, "line": first[2] if first else None, "licenses": sorted({x[1] for x in f})})
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, line, licenses) of every row (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for lo, hi in chunks(offs):
                got = own.scan(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                cols = [pa.array([g[c] for g in got], k) for c, k in (("license", pa.string()), ("score", pa.float64()), ("line", pa.int32()), ("licenses", pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols], ["doc_id", "license", "score", "line", "licenses"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, license string, score double, line int, licenses array<string>")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

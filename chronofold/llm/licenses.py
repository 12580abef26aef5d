"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits in lower case (bytes beyond ASCII count as letters). A template of L 5-word shingles
is looked for in windows of W >= 2.5 L shingles that overlap by half, so any copy of it lies whole in one window. A
window that holds 0.8 of a template has a Jaccard similarity of 0.15 or more with it, and agrees on one of the ``BANDS``
single-row bands with probability over 0.9999. Retrieved templates are verified by the exact share of their distinct
shingles in the window. Texts without a single template shingle are passed over; they cannot match. A template of under
five words is one shingle of all its words, looked for among the shingles of that width.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import LOWER, U, chunks, random_words, range_hashes, shingle_hashes, word_bounds

BANDS, CONTAINED = 64, 0.8
_A, _B = random_words(21, BANDS) | U(1), random_words(22, BANDS)
WIDTH = 5
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

# License statements as they are commonly worded.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-statement": "This work is licensed under the GNU Lesser General Public License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved by the authors.",
}
#: Lines that do not name a license. The query looks for them too; scan() does where they are given.
LINES = {"all-rights-reserved-line": "All rights reserved."}


def templates_from(folder: str) -> dict[str, str]:
    """Further templates: the text files of a folder by name, such as the licenses that a system keeps. Read by the driver."""
    out = {}
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out[name] = f.read()
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    s, e, row = word_bounds(np.where(NOT_WORD[data], np.uint8(32), data), offsets)
    return range_hashes(data, s, e), row


class Index:
    """Templates of one shingle width by window size: distinct shingles and band values."""

    def __init__(self, templates: dict[str, np.ndarray], width: int):
        self.names, self.width = sorted(templates), width
        self.sets, self.bands, self.window = [], [], []
        for n in self.names:
            words = templates[n]
            s = np.unique(shingle_hashes(words, np.zeros(len(words), np.int64), 1, width)[0])
            self.sets.append(s)
            self.bands.append((s[:, None] * _A + _B).min(0))
            self.window.append(2 << int(np.ceil(np.log2(1.25 * len(s) + 1))))
        self.every = np.unique(np.concatenate(self.sets))

    def scan(self, h: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) in the shingles of one text."""
        found = {}
        for w in sorted(set(self.window)):
            half = w // 2
            starts = np.arange(0, len(h), half)
            low = np.minimum.reduceat(h[:, None] * _A + _B, starts, axis=0)
            low[:-1] = np.minimum(low[:-1], low[1:])  # each window and the next half
            for t in [i for i, x in enumerate(self.window) if x == w]:
                for k in np.flatnonzero((low == self.bands[t]).any(1)):
                    a, b = starts[k], min(len(h), starts[k] + w)
                    at = a + np.flatnonzero(np.isin(h[a:b], self.sets[t]))
                    share = len(np.unique(h[at])) / len(self.sets[t])
                    if share >= CONTAINED:
                        found[self.names[t], int(at[0]), int(at[-1]) + self.width] = share
        # a copy is in two windows: spans of one template that overlap are one, at the best containment
        out: list[tuple[str, int, int, float]] = []
        for (t, a, b), share in sorted(found.items()):
            if out and out[-1][0] == t and a < out[-1][2]:
                out[-1] = (t, out[-1][1], max(b, out[-1][2]), max(share, out[-1][3]))
            else:
                out.append((t, a, b, share))
        return out


@lru_cache(4)
def _indexes(items: tuple) -> list[Index]:
    by: dict[int, dict[str, np.ndarray]] = {}
    for name, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = _words(raw, np.array([0, len(raw)]))[0]
        by.setdefault(min(WIDTH, len(words)), {})[name] = words
    return [Index(x, k) for k, x in sorted(by.items()) if k]


def _scan(items: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(items)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = []
            for lo, hi, data, offsets in chunks(batch.column("text")):
                words, own = _words(data, offsets)
                for index in indexes:
                    h, r = shingle_hashes(words, own, hi - lo, index.width)
                    hit = index.every[np.minimum(np.searchsorted(index.every, h), len(index.every) - 1)] == h
                    for row in np.unique(r[hit]):
                        a, b = np.searchsorted(r, [row, row + 1])
                        out += [(ids[lo + row], *x) for x in index.scan(h[a:b])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "license", "word_start", "word_end", "containment"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per license found: doc_id, license, word_start, word_end (words of letters and digits), containment.

    ``docs`` has doc_id and text; other columns are ignored. Null and empty texts and texts without a license give no rows;
    repeated rows give their rows again; a null doc_id stays null; an empty table gives no rows. ``templates`` may be any texts: see
    license_texts and templates_from.
    """
    items = tuple(sorted((templates or TEMPLATES).items()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(items), "doc_id long, license string, word_start long, word_end long, containment double")

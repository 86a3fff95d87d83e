"""License scans: MinHash retrieval of templates over overlapping text windows, then exact shingle containment.

A document's word shingles are cut, from its first one, into blocks of 2**k shingles, and two neighbouring blocks make
a window, so that windows overlap by half. Templates are looked up among windows of the smallest k that fits them. A
band is one minimum, and a window's minimum is the lesser one of its blocks'. A document that holds MIN_CONTAINMENT of
a template in a stretch of twice its shingles has the template's least shingle there with that chance, and it is the
least of its block too with a chance over 1/3, as a block has at most twice the template's shingles: so BANDS bands miss
the document with a chance under (3/4)**BANDS = 1e-8. A shared minimum is a shared shingle, so nearly every retrieved
template is there, and the exact check is rarely in vain. All of it looks at one document, whatever rows share a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from meterlake.llm import words as W

BANDS = 64
MIN_CONTAINMENT = 0.75
SHINGLE = 5
#: Fixed texts: common short notices and the first sentences of public licences.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-licensed", "This project is licensed under the MIT License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)
IS_WORD = np.ones(256, bool)
IS_WORD[[c for c in range(128) if not chr(c).isalnum() and chr(c) not in ".-"]] = False


def plain(column: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and ASCII marks, but for inner dots and hyphens, made spaces."""
    bounds, data = W.text_bytes(column)
    low, high = int(bounds[0]), int(bounds[-1])
    data = np.where(IS_WORD[data[low:high]], W.LOWER[data[low:high]], np.uint8(32))
    # dots and hyphens stay only between other characters of a word
    dot = (data == 46) | (data == 45)
    solid = ~dot & (data != 32)
    inner = dot.copy()
    inner[1:] &= solid[:-1]
    inner[:-1] &= solid[1:]
    ends = bounds[(bounds > low) & (bounds < high)] - low  # rows meet here
    inner[:1] = inner[-1:] = inner[ends] = inner[ends - 1] = False
    data = np.where(dot & ~inner, np.uint8(32), data)
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((bounds - low).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


class Templates:
    """Templates by shingle size and window size, with their minima and shingles.

    A template of fewer words than SHINGLE is one shingle of all its words, and windows of that shingle size are looked
    up for it.
    """

    def __init__(self, templates, bands: int):
        self.names = [name for name, _ in templates]
        self.odd = np.random.default_rng(11).integers(0, 2**63, (bands, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shingles: list[np.ndarray] = []
        #: shingle size: level (windows are two blocks of 2**level shingles; at level 0 one shingle): templates
        self.levels: dict[int, dict[int, list[int]]] = {}
        for k, (_, text) in enumerate(templates):
            (words,) = W.split(plain(pa.array([text])))
            size = min(len(words.doc), SHINGLE)
            self.shingles.append(np.unique(W.windows(words, size)[1]))
            level = int(np.ceil(np.log2(len(self.shingles[k]))))
            self.levels.setdefault(size, {}).setdefault(level, []).append(k)
        #: (band, template) of each shingle size and level
        self.minima = {(size, level): np.array([[(self.shingles[k] * a + b).min() for k in own] for a, b in self.odd]) for size, of in self.levels.items() for level, own in of.items()}

    def candidates(self, size: int, value: np.ndarray, begins: np.ndarray) -> set[tuple[int, int]]:
        """(document, template): pairs with a window that shares a minimum with the template. ``begins``: the place of
        each document's first shingle; every document has one."""
        levels = self.levels[size]
        # of each level: the document of each block, and where the pairs of blocks of the level before begin
        counts, of, pairs = np.diff(begins, append=len(value)), [], [begins[:0]]
        of.append(np.repeat(np.arange(len(counts)), counts))
        for _ in range(max(levels)):
            first, counts = np.cumsum(counts) - counts, -(-counts // 2)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            of.append(np.repeat(np.arange(len(counts)), counts))
            pairs.append(np.repeat(first, counts) + 2 * place)
        found: set[tuple[int, int]] = set()
        for band, (a, b) in enumerate(self.odd):
            least = value * a + b
            for level in range(max(levels) + 1):
                if level:
                    least = np.minimum.reduceat(least, pairs[level])
                # windows of one shingle agree in all bands or none
                if level in levels and (level or not band):
                    own = self.minima[size, level][band]
                    hit = np.flatnonzero(np.isin(least, own))
                    at, which = np.nonzero(least[hit][:, None] == own[None, :])
                    found |= {(int(of[level][hit[h]]), levels[level][t]) for h, t in zip(at, which, strict=True)}
        return found


def best_window(at: np.ndarray, value: np.ndarray, width: int) -> tuple[int, int]:
    """(distinct values, first place) of the stretch of ``width`` places that has most of the values at places ``at``;
    the first of equal ones."""
    inside: dict[int, int] = {}
    best, low = (0, 0), 0
    places, values = at.tolist(), value.tolist()
    for place, v in zip(places, values, strict=True):
        inside[v] = inside.get(v, 0) + 1
        while place - places[low] >= width:
            inside[values[low]] -= 1
            if not inside[values[low]]:
                del inside[values[low]]
            low += 1
        if len(inside) > best[0]:
            best = len(inside), places[low]
    return best


def _scan(templates: Templates, least: float):
    def compute(column):
        out = []
        for part in W.split(plain(column)):
            found = []
            for size in templates.levels:
                first, value = W.windows(part, size)
                if not len(value):
                    continue
                doc = part.doc[first]
                begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                ends = np.append(begins[1:], len(value))
                for d, t in templates.candidates(size, value, begins):
                    own, shingles = value[begins[d] : ends[d]], templates.shingles[t]
                    at = np.flatnonzero(np.isin(own, shingles))
                    shared, place = best_window(at, own[at], 2 * len(shingles))
                    if shared >= least * len(shingles):
                        found.append((part.row + int(doc[begins[d]]), t, shared / len(shingles), place))
            out += [(row, templates.names[t], share, place) for row, t, share, place in sorted(found)]
        return out

    return compute


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = MIN_CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, first_word: one row for each row and template that it holds.

    ``containment``: the largest share, ``least`` at least, of the template's distinct five-word shingles in a stretch
    of twice as many shingles of the text; ``first_word``: index of the first shared word of the first such stretch,
    over words of letters, digits, inner dots and hyphens. A template of fewer words is one shingle. A notice that
    other words are spread over, so that no such stretch holds that share, is not found. A-Z and other marks don't
    count. Null, empty and unlicensed texts give no row; rows that repeat an id give theirs each; an empty table gives
    an empty one. Templates are a parameter of fixed size and travel with the task.
    """
    known = Templates(templates, bands)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("license string, containment double, first_word bigint")])

    def run(batches):
        scan = _scan(known, least)
        for batch in batches:
            found = scan(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)

"""Licence scans: a trained paragraph classifier, confirmed against templates.

Texts are cut into units: runs of words up to a line end, a word that ends a sentence, or
``LONGEST`` words. A multinomial logistic regression over hashed word unigrams and bigrams gives each
unit's licence family or ``unknown``. It is trained here on the templates, with words dropped, swapped
for words of the corpus and cut at both ends, against units of a bounded sample of the corpus
(``SAMPLE`` rows, taken by a hash of the row's text) that share few words with any template. A
temperature fitted on examples left out of training calibrates the probabilities, the unknown class's among them;
a unit is reported if a family has at least ``PROBABILITY``.

A prediction is confirmed if the unit holds enough of one of its family's templates, or lies inside
one: containment of word bigrams. Only units that could reach the probability are scored in full: a
table of each feature's largest weight against ``unknown`` gives a bound that the others can't pass.

Results in special cases: null or empty text has no units; a text without licence words has no
findings; rows that repeat are scanned each; an empty table trains on templates alone; a very
long text is scanned in pieces that end at a line or, where a line is longer than a piece, at a space;
further columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import bytehash
from ragweave.llm.common import discard, materialize, row_blocks, text_views

# Short notices of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "bsd": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This software is confidential and proprietary; unauthorized copying is prohibited.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
    ),
}

UNKNOWN = "unknown"
SAMPLE, LONGEST, PROBABILITY, CONTAINED, BITS = 2000, 48, 0.5, 0.6, 16
#: Varied copies of each template, and rounds of gradient descent.
COPIES, ROUNDS, RATE, DECAY = 60, 200, 0.5, 1e-4
BLOCK = 1 << 20
_STRIP = np.zeros(256, bool)
_STRIP[[*b"\"'()[]{}.,;:!?*#-_"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each unit, row of each unit, first and last + 1 byte of each unit."""
    low = bytehash.LOWER[data]
    a, b = bytehash.word_spans(low, offsets)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    lines = np.concatenate([[0], np.cumsum(_LINE[data])])
    row = np.searchsorted(offsets, a, "right") - 1
    new = np.ones(len(a), bool)
    new[1:] = (row[1:] != row[:-1]) | (lines[a[1:]] != lines[b[:-1]]) | _STOP[data[b[:-1] - 1]]
    first = np.flatnonzero(new)
    since = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    new |= since % LONGEST == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    x, y = a.copy(), b.copy()
    for _ in range(3):
        x += (x < y - 1) & _STRIP[low[x]]
        y -= (y > x + 1) & _STRIP[low[y - 1]]
    return bytehash.Prefix(low).windows(x, y), first, row[first], np.stack([a[first], b[last]], 1)


def pieces(data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end at a line end, else at a space, else at the next space."""
    at = 0
    while at < len(data):
        end = at + most
        if end < len(data):
            for breaks in (_LINE, bytehash.SPACE):
                if len(found := np.flatnonzero(breaks[data[at:end]])):
                    end = at + int(found[-1]) + 1
                    break
            else:
                end = bytehash.word_end(data, end, len(data))
        yield at, min(end, len(data))
        at = end


def features(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigram and bigram of each word (a unit's last word has the bigram of an end)."""
    following = np.zeros(len(words), np.uint64)
    following[:-1] = words[1:]
    if len(first):
        following[np.append(first[1:], len(words)) - 1] = np.uint64(1)
    shift = np.uint64(64 - BITS)
    return (words >> shift).astype(np.int64), (bytehash.mix(words * np.uint64(31) + following) >> shift).astype(np.int64)


def _of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text as one unit, and its bigram hashes."""
    data, offsets = text_views(pa.array([text]))
    words = units(data, offsets)[0]
    return words, np.unique(bytehash.mix(words[:-1] * np.uint64(31) + words[1:]))


@dataclass
class Model:
    families: list[str]  # the last is unknown
    weights: np.ndarray  # (1 << BITS, families)
    bias: np.ndarray
    temperature: float

    def bound(self) -> tuple[np.ndarray, float]:
        """Largest weight of each feature against unknown, and the sum that a report needs."""
        gain = np.maximum((self.weights[:, :-1] - self.weights[:, -1:]).max(1), 0)
        need = -(self.bias[:-1] - self.bias[-1]).max() + self.temperature * np.log(PROBABILITY / (1 - PROBABILITY) + 1e-12) - 1e-3
        return gain, float(need)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of each family, for units given as feature indexes."""
        z = np.stack([self.weights[r].sum(0) for r in rows]) + self.bias
        z = (z - z.max(1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def _varied(template: str, noise: list[str], chance: random.Random) -> str:
    words = template.split()
    if len(words) > 6 and chance.random() < 0.3:
        a = chance.randrange(len(words) // 3)
        words = words[a : len(words) - chance.randrange(len(words) // 3)]
    words = [chance.choice(noise) if chance.random() < 0.04 else w for w in words if chance.random() > 0.03] or words
    before, after = ([chance.choice(noise) for _ in range(chance.randrange(12) if chance.random() < 0.3 else 0)] for _ in range(2))
    return " ".join(before + words + after)


def fit(samples: list[str], seed: int = 7) -> Model:
    """Train on the templates and on sample units of the corpus."""
    chance = random.Random(seed)
    known = {w.lower().strip("\"'()[]{}.,;:!?*#-_") for ts in TEMPLATES.values() for t in ts for w in t.split()}
    families = [*sorted(TEMPLATES), UNKNOWN]
    plain: list[str] = []
    for text in samples:
        words = text.split()
        if words and sum(w.lower().strip("\"'()[]{}.,;:!?*#-_") in known for w in words) < 0.5 * len(words):
            plain.append(text)
    chance.shuffle(plain)
    plain = plain[: 2 * SAMPLE]
    noise = [w for t in plain[:500] for w in t.split()] or ["text", "page", "note"]
    some = "the and of to license licensed under version work released software public general rights terms copyright free".split()
    plain += [" ".join(chance.choice(noise if chance.random() < 0.6 else some) for _ in range(chance.randint(3, 24))) for _ in range(SAMPLE // 2)]
    examples = [(_varied(t, noise, chance), families.index(f)) for f, ts in TEMPLATES.items() for t in ts for _ in range(COPIES)] + [(t, len(families) - 1) for t in plain]
    chance.shuffle(examples)
    rows = []
    for text, _ in examples:
        words, _ = _of(text)
        rows.append(np.concatenate(features(words, np.array([0]))) if len(words) else np.zeros(1, np.int64))
    labels = np.array([y for _, y in examples])
    cut = len(rows) * 4 // 5
    used, columns = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    taught = int(starts[cut]) if cut < len(rows) else len(columns)
    order = np.argsort(columns[:taught], kind="stable")
    of_row = np.repeat(np.arange(len(rows)), sizes)[:taught][order]
    own, edges = np.unique(columns[:taught][order], return_index=True)
    w, b = np.zeros((len(used), len(families))), np.zeros(len(families))
    target = np.eye(len(families))[labels]

    def logits() -> np.ndarray:
        return np.add.reduceat(w[columns], starts, axis=0) + b

    slope_w, slope_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(ROUNDS):
        z = logits()
        e = np.exp(z - z.max(1, keepdims=True))
        gap = (e / e.sum(1, keepdims=True) - target) / np.maximum(sizes, 1)[:, None]
        gap[cut:] = 0
        grad = np.zeros_like(w)
        grad[own] = np.add.reduceat(gap[of_row], edges, axis=0)
        grad, grad_b = grad + DECAY * w, gap.sum(0)
        slope_w, slope_b = 0.9 * slope_w + 0.1 * grad, 0.9 * slope_b + 0.1 * grad_b
        w -= RATE * slope_w
        b -= RATE * 0.1 * slope_b
    z, y = logits()[cut:], labels[cut:]
    loss = []
    grid = np.geomspace(0.2, 5, 33)
    for t in grid:
        s = z / t
        loss.append(-(s[np.arange(len(y)), y] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1)).mean() if len(y) else 0)
    weights = np.zeros((1 << BITS, len(families)), np.float32)
    weights[used] = w
    return Model(families, weights, b, float(grid[int(np.argmin(loss))]))


def sample_units(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[str]:
    """About ``4 * sample`` units of about ``sample`` rows, all parts of a text alike, by hashes.

    Rows and units are counted first and taken by a share of their hashes, so what the driver gets doesn't
    grow with the input or its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_views(batch.column(0))
            for a, b in row_blocks(offsets, BLOCK):
                part = data[offsets[a] : offsets[b]]
                words, first, _, place = units(part, offsets[a : b + 1] - offsets[a])
                order = bytehash.mix(np.add.reduceat(words, first)) if len(first) else words
                texts = [part[x:y].tobytes().decode(errors="ignore") for x, y in place]
                yield pa.RecordBatch.from_arrays([pa.array(order.view(np.int64)), pa.array(texts, pa.string())], ["key", "unit"])

    n = docs.count()
    share = min(1.0, sample / max(1, n))
    taken = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < share * (1 << 20)).select(text_col)
    found = materialize(taken.mapInArrow(run, "key long, unit string").dropDuplicates(["key"]), "license-units")
    share = min(1.0, 4 * sample / max(1, found.count()))
    rows = found.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).collect()
    discard(found)
    return [r["unit"] for r in sorted(rows, key=lambda r: r["key"])]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of units of ``docs``."""
    return fit(sample_units(docs, text_col, sample))


SCANS = "doc_id long, n_units long, findings array<struct<unit: long, first: long, stop: long, family: string, probability: double, contained: double, confirmed: boolean>>"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units and findings of each document; first and stop are byte positions of a unit."""
    gain, need = model.bound()
    gain = gain.astype(np.float32)
    shapes = {f: [_of(t)[1] for t in ts] for f, ts in TEMPLATES.items()}

    def contained(pairs: np.ndarray, family: str) -> float:
        best = 0.0
        for shape in shapes[family]:
            common = len(np.intersect1d(pairs, shape, assume_unique=True))
            best = max(best, common / max(1, len(shape)), common / max(1, len(pairs)) if len(pairs) >= 4 else 0.0)
        return best

    def findings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        words, first, row, place = units(data, offsets)
        if not len(words):
            return np.zeros(len(offsets) - 1, np.int64), []
        one, two = features(words, first)
        hope = np.add.reduceat(gain[one] + gain[two], first)
        last = np.append(first[1:], len(words))
        begin = np.searchsorted(row, np.arange(len(offsets) - 1))
        count = np.diff(np.append(begin, len(row)))
        at = np.flatnonzero(hope >= need)
        out = []
        for part in (at[i : i + 4096] for i in range(0, len(at), 4096)):
            p = model.probabilities([np.concatenate([one[first[u] : last[u]], two[first[u] : last[u]]]) for u in part])
            for u, q in zip(part, p):
                f = int(np.argmax(q[:-1]))
                if q[f] >= PROBABILITY:
                    own = words[first[u] : last[u]]
                    share = contained(np.unique(bytehash.mix(own[:-1] * np.uint64(31) + own[1:])), model.families[f])
                    r = int(row[u])
                    out.append((r, int(u - begin[r]), int(place[u, 0] - offsets[r]), int(place[u, 1] - offsets[r]), model.families[f], float(q[f]), share, share >= CONTAINED))
        return count, out

    def of_long(data: np.ndarray) -> tuple[int, list[tuple]]:
        """As ``findings`` for one long row, piece by piece."""
        count, out = 0, []
        for a, b in pieces(data):
            n, found = findings(data[a:b], np.array([0, b - a]))
            out += [(0, u + count, x + a, y + a, *rest) for _, u, x, y, *rest in found]
            count += int(n[0])
        return count, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("unit", pa.int64()), ("first", pa.int64()), ("stop", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("contained", pa.float64()), ("confirmed", pa.bool_())]))
        names = [x.name for x in kind.value_type]
        for batch in batches:
            data, offsets = text_views(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for a, b in row_blocks(offsets, BLOCK):
                part = data[offsets[a] : offsets[b]]
                if b - a == 1 and len(part) > BLOCK:
                    n, found = of_long(part)
                    count = np.array([n])
                else:
                    count, found = findings(part, offsets[a : b + 1] - offsets[a])
                lists: list[list[dict]] = [[] for _ in range(b - a)]
                for r, *rest in found:
                    lists[r].append(dict(zip(names, rest)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(count, pa.int64()), pa.array(lists, kind)], ["doc_id", "n_units", "findings"])

    return docs.select(id_col, text_col).mapInArrow(run, SCANS)


def summary(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units, n_predicted, n_confirmed, families (confirmed, sorted, by comma), top_probability."""
    found = scan(docs, model, id_col, text_col)
    sure = F.filter("findings", lambda x: x["confirmed"])
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    top = F.coalesce(F.array_max(F.transform("findings", lambda x: x["probability"])), F.lit(0.0))
    return found.select("doc_id", "n_units", F.size("findings").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"), names.alias("families"), F.round(top, 6).alias("top_probability"))

"""License scans: a paragraph classifier over word n-grams, with template comparison to confirm it.

Multinomial logistic regression over the 1- and 2-grams of words tells licence families from other text ("unknown"). It is trained on short
notices of each family varied at random, on the names of licences in sentences that grant them, and on paragraphs of the documents. Its
probabilities are calibrated with a temperature on notices and sentences that the fit didn't see: a third of them at a time is kept out whole.

A family is reported if its probability is CERTAIN or more and a template of the family has most of its 2-grams in the paragraph. A new wording,
like no template, needs a surer classifier and a name: it is reported if the probability of any licence is SURE or more, a name of the family stands there,
and the family is the likeliest of all, with NAMED of that probability or more.
A paragraph is a line, or lines in a row that a notice is wrapped over.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io, _text

CERTAIN = 0.5
SURE = 0.8
NAMED = 0.3
CONFIRMED = 0.6  # of a template's 2-grams
FOLDS = 3
OTHER_WEIGHT = 6.0
SAMPLE_DOCS = 400  # documents whose paragraphs show the classifier other text, about
SAMPLE_LINES = 1000
SAMPLE_CHARS = (10, 2000)  # shorter and longer paragraphs aren't learned from; all are judged

#: Short notices of licence families; those of one family are alternatives.
NOTICES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Released under CC0 1.0 Universal."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or as soon as they will be approved by the European Commission", "SPDX-License-Identifier: EUPL-1.2"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "Released under the GPL.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable", "SPDX-License-Identifier: Zlib"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential.", "Copyright 2020. All rights reserved."],
}
#: Names of the families' licences, as words.
NAMES = {
    "agpl": ["agpl", "agplv3", "gnu affero general public license", "affero gpl"],
    "apache": ["apache license", "apache 2 0", "apache software license"],
    "boost": ["boost software license", "boost license"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "bsd style license", "simplified bsd license"],
    "cc-by": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution license"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike"],
    "cc0": ["cc0"],
    "epl": ["eclipse public license", "epl 2 0"],
    "eupl": ["eupl", "european union public license"],
    "gpl": ["gpl", "gplv2", "gplv3", "gnu gpl", "gnu general public license"],
    "isc": ["isc license"],
    "lgpl": ["lgpl", "lgplv2", "lgplv3", "gnu lesser general public license", "lesser gpl"],
    "mit": ["mit license", "license mit", "expat license"],
    "mpl": ["mpl", "mozilla public license"],
    "unlicense": ["unlicense"],
    "zlib": ["zlib license"],
}
#: Sentences that grant a licence, for training.
GRANTS = [
    "distributed under the terms of the {}", "this code is licensed under {}", "licensed {}", "available under the {} version 2 or later", "{} licensed", "license {}",
    "you may use and share this under {}", "see the file for the {} that covers this project", "released under a {}", "covered by the {} a copy of which is included",
    "this file is governed by the {}", "you can redistribute it under the terms of {} version 3", "the source is published under {}", "subject to the {}",
]
#: Sentences that only speak of one, for training.
MENTIONS = [
    "{} is not used here, nor is any other licence",
    "this work is not licensed under the {} licence",
    "it was never released under {} and will not be",
    "no code under the {} may be used in this project",
    "the judges talked about the {} for hours", "a history of the {} was written", "why does anyone prefer the {} asked the reporter", "students compare the {} with other texts",
    "a lecture on the {} and its critics", "she read about the {} in the paper", "the {} was invented long ago", "some people dislike the {}", "what does the {} say about patents",
    "the debate over the {} went on", "they looked at the {} again and found nothing", "the parties argued about the {} in front of a judge", "nobody there had heard of the {}",
    "the book tells how the {} came about", "she spoke at the meeting on the {}",
]
#: Text that speaks of licences and is none.
OTHER = [
    "the driver lost a license last year", "a license fee is due every month", "version 2.0 of the program is out", "the public was told of the general terms",
    "she is licensed to teach at school", "the work is under way", "released under pressure from the public", "he works at MIT and likes it", "the apache tribe lived here",
    "all rights and duties of the members", "free of charge for children", "a copy of the file is in the library", "creative people share common ground", "under the bridge",
    "the court ruled that the GPL was never read by the parties", "a talk about the MIT license and its history was held", "why does anyone prefer the BSD license asked the reporter",
    "the eclipse was seen by the public at noon", "mozilla and apache are names of projects", "students compare the GPL with other texts in class", "the commons were divided on attribution",
    "permission to enter the building was refused", "the boost to sales was short", "distribution of the leaflets was slow", "he asked what the apache license says about patents",
]
FAMILIES = ("unknown", *sorted(NOTICES))


def _hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return _text.hashes(raw, np.array([0]), np.array([len(raw)]))[0]


_SAME = {_hash("licence"): _hash("license"), _hash("licenced"): _hash("licensed")}


def _grams(raw: np.ndarray, offsets: np.ndarray):
    """Word hashes (of one spelling), their 2-gram hashes (a place each, the last's unused), bytes where words begin, and where rows do."""
    low = _text.LOWER[raw]
    starts, ends, first = _text.words(low, offsets, _text.NOT_ALNUM)
    h = _text.hashes(low, starts, ends)
    for a, b in _SAME.items():
        h[h == a] = b
    return h, _text.grams(h, 2), starts, first


def _words(t: str) -> np.ndarray:
    raw = np.frombuffer(t.encode(), np.uint8)
    return _grams(raw, np.array([0, len(raw)]))[0]


def _pairs(words: np.ndarray) -> np.ndarray:
    return np.unique(_text.grams(words, 2))


def _features(words: np.ndarray) -> np.ndarray:
    """The distinct 1- and 2-grams."""
    return np.unique(np.concatenate((words, _text.grams(words, 2))))


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return i, table[i] == x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _shares(y: np.ndarray) -> np.ndarray:
    return np.where(y == 0, OTHER_WEIGHT, 1.0) / np.maximum(1, np.bincount(y, minlength=len(FAMILIES)))[y]


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Weights (n, families) of a multinomial logistic regression on rows of feature numbers, each family with the same weight in all. The rows are
    sparse: sums run over the features that are there. Other text counts OTHER_WEIGHT times a family."""
    at = np.cumsum([0, *(len(r) for r in rows)])[:-1]
    column = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(column, kind="stable")
    own, begin = np.unique(column[order], return_index=True)
    w, seen = np.zeros((n, len(FAMILIES)), np.float32), np.full((len(own), len(FAMILIES)), 1e-6, np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    weight = _shares(y).astype(np.float32)[:, None]
    for _ in range(rounds):
        d = weight * (_softmax(np.add.reduceat(w[column], at)) - target)
        g = np.add.reduceat(d[row[order]], begin) + 1e-4 * w[own]
        seen += g * g
        w[own] -= 0.5 * g / np.sqrt(seen)
    return w


class Classifier:
    """paragraphs: other text. without: notices, by their text, that it is not to know."""

    def __init__(self, paragraphs: list[str], seed: int = 0, rounds: int = 120, without: tuple[str, ...] = ()):
        r = random.Random(seed)
        notices = {k: [t for t in ts if t not in without] for k, ts in NOTICES.items()}
        texts, y, part = [], [], []  # part: what is kept out together

        def around(words: list[str]) -> str:
            other = r.choice(paragraphs).split() if paragraphs and r.random() < 0.4 else []
            k = r.randint(0, 6)
            return " ".join(other[:k] + words + other[k : 2 * k])

        def vary(t: str) -> str:
            words = t.split()
            return around([w for w in words if r.random() > 0.05] if len(words) > 6 else words)

        for k, family in enumerate(FAMILIES[1:], 1):
            for n, t in enumerate(notices[family]):
                texts += [t, *(vary(t) for _ in range(8))]
                y += [k] * 9
                part += [n % FOLDS] * 9
            for n, t in enumerate(GRANTS):
                for name in NAMES.get(family, ()):
                    texts.append(around(t.format(name).split()))
                    y.append(k)
                    part.append(n % FOLDS)
        for n, t in enumerate(OTHER * 6 + paragraphs):
            texts.append(t if n < len(OTHER) or n >= 6 * len(OTHER) else around(t.split()))
            y.append(0)
            part.append(n % len(OTHER) % FOLDS if n < 6 * len(OTHER) else n % FOLDS)
        for n, t in enumerate(MENTIONS):
            for name in sorted(x for names in NAMES.values() for x in names):
                texts.append(around(t.format(name).split()))
                y.append(0)
                part.append(n % FOLDS)
        sets, y, part = [_features(_words(t)) for t in texts], np.array(y), np.array(part)
        grams, n = np.unique(np.concatenate(sets), return_counts=True)
        self.grams = grams[n > 1]
        rows = [self._row(s) for s in sets]
        size = len(self.grams) + 17
        heats, loss = np.geomspace(0.2, 5, 40), np.zeros(40)
        for fold in range(FOLDS):
            fit, out = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
            w = _logistic([rows[i] for i in fit], y[fit], size, rounds)
            z = np.stack([w[rows[i]].sum(0) for i in out])
            share = _shares(y[out])
            loss += [-(share * np.log(_softmax(z / h)[np.arange(len(z)), y[out]] + 1e-12)).sum() for h in heats]
        self.heat = float(heats[int(np.argmin(loss))])
        self.weights = _logistic(rows, y, size, rounds) / self.heat
        words = [(k, _words(t)) for k, family in enumerate(FAMILIES[1:], 1) for t in notices[family]]
        self.templates = [(k, _pairs(w)) for k, w in words]
        self.names = {k: [_words(t) for t in NAMES.get(family, ())] for k, family in enumerate(FAMILIES)}
        # a line without any of these is no notice by itself; lines joined need a template's 2-grams
        self.telling = np.unique(np.concatenate([p for _, p in self.templates]))
        self.cues = np.unique(np.concatenate([n[:1] for ns in self.names.values() for n in ns]))
        self.longest = max(len(w) for _, w in words)
        self.least = min(int(np.ceil(CONFIRMED * len(p))) for _, p in self.templates)

    def _row(self, grams: np.ndarray) -> np.ndarray:
        """Feature numbers: the known n-grams, how many are not known (as a power of two), and a constant."""
        i, ok = _place(self.grams, grams)
        return np.concatenate((i[ok], [len(self.grams) + min(15, int((~ok).sum()).bit_length()), len(self.grams) + 16]))

    def judge(self, words: np.ndarray, by_name: bool = True) -> tuple[int, float]:
        """(family, probability) of a paragraph of word hashes; 0 if unknown or not confirmed."""
        p = _softmax(self.weights[self._row(_features(words))].sum(0)[None])[0]
        k = int(p.argmax())
        if k and p[k] >= CERTAIN:
            pairs = _pairs(words)
            if any(f == k and np.isin(t, pairs).mean() >= CONFIRMED for f, t in self.templates):
                return k, float(p[k])
        if by_name and 1 - p[0] >= SURE:
            named = [f for f, names in self.names.items() if any(self._stands(n, words) for n in names)]
            k = max(named, key=lambda f: p[f], default=0)
            if k and p[k] == p[1:].max() and p[k] >= NAMED * (1 - p[0]):
                return k, float(p[k])
        return 0, float(p[0])

    @staticmethod
    def _stands(name: np.ndarray, words: np.ndarray) -> bool:
        at = np.flatnonzero(words[: len(words) - len(name) + 1] == name[0]) if len(words) >= len(name) else ()
        return any(np.array_equal(words[a : a + len(name)], name) for a in at)


def trained(docs: DataFrame) -> Classifier:
    """On NOTICES and at most SAMPLE_LINES paragraphs of about SAMPLE_DOCS documents without the word "licen" in them. Documents and paragraphs are
    drawn by hashes of their text, so that neither the order of rows nor their partitions show."""
    n = max(1, docs.count())
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 2 * SAMPLE_DOCS / n)) + 1
    lines = docs.where(drawn).select(F.explode(F.split("text", "\n")).alias("t")).where(F.length("t").between(*SAMPLE_CHARS) & ~F.lower("t").like("%licen%"))
    lines = lines.distinct().orderBy(F.xxhash64("t"), "t").limit(SAMPLE_LINES)
    return Classifier(sorted(r.t for r in lines.collect()))


_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _judged(model: Classifier, h: np.ndarray, cues: np.ndarray, hits: np.ndarray, at: np.ndarray, to: np.ndarray, goes_on: np.ndarray) -> dict[int, tuple[int, float]]:
    """(family, probability) of the notices by first line. cues, hits: places of words that begin a name, and of telling 2-grams; at, to: the words
    of each line; goes_on: whether the next line belongs to the same paragraph.

    A notice stands in a line, or is wrapped over lines of which those between the first and the last are all its own, so that they have fewer
    words than the longest template. Lines that are notices by themselves aren't joined to those before; of the wrapped readings from one
    line on, the likeliest counts, and its lines begin no other.
    """
    lines = np.unique(np.searchsorted(at, hits, "right") - 1).tolist()
    alone = {}
    for a in np.unique(np.searchsorted(at, np.concatenate((cues, hits)), "right") - 1).tolist():
        if to[a] - at[a] > 1:
            family, p = model.judge(h[at[a] : to[a]])
            if family:
                alone[a] = family, p
    out, free = dict(alone), 0
    for a in lines:
        if a < free:
            continue
        best, end = alone.get(a, (0, 0.0)), a
        b = a
        while b < len(goes_on) and goes_on[b] and b + 1 not in alone and to[b] - to[a] < model.longest:
            b += 1
            if np.searchsorted(hits, to[b] - 1) - np.searchsorted(hits, at[a]) >= model.least:
                family, p = model.judge(h[at[a] : to[b]], by_name=False)
                if family and p > best[1] and (a not in alone or family != alone[a][0]):
                    best, end = (family, p), b
        if best[0]:
            out[a], free = best, end + 1
    return out


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for i, j, raw, offsets in _io.slices(b.column(k)):
                ls, le, lf = _text.words(raw, offsets, _NEWLINE)
                row = _text.row_of(lf)
                found: list[dict[str, float]] = [{} for _ in range(j - i)]
                spans: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
                # words never cross a line, so lines' words are those of the rows
                h, g, starts, _ = _grams(raw, offsets)
                hits, cues = np.flatnonzero(_place(model.telling, g)[1]), np.flatnonzero(_place(model.cues, h)[1])
                at, to = np.searchsorted(starts, ls), np.searchsorted(starts, le)
                # a line without words, or an empty one, ends a paragraph; so does the row
                goes_on = (row[1:] == row[:-1]) & (ls[1:] == le[:-1] + 1) & (to[1:] > at[1:])
                for line, (family, p) in sorted(_judged(model, h, cues, hits, at, to, goes_on).items()):
                    r = int(row[line])
                    name = FAMILIES[family]
                    found[r][name] = max(p, found[r].get(name, 0.0))
                    spans[r].append((line - int(lf[r]), family))
                cols = [pa.array(np.diff(lf)), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(sorted(f)) for f in found]), pa.array([min(f.values(), default=None) for f in found], pa.float64())]
                cols.append(pa.array([",".join(f"{n}:{FAMILIES[f]}" for n, f in s) for s in spans]))
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in range(k)), *cols], [*map(str, range(k)), *map(str, range(100, 105))])

    return run


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """docs' columns but the text, with n_paragraphs (lines with any character), n_licenses (licence notices), families
    (distinct, ascending, comma-joined), confidence (the least certain family's probability; null without any) and places
    (paragraph:family, in order; of a wrapped notice, its first line).

    Null and empty texts have no paragraphs. Repeated rows each get their own result. Columns with the name of a result give way to it.
    """
    spark = docs.sparkSession
    _io.ready(spark)
    sent = spark.sparkContext.broadcast(model or trained(docs))
    results = ("n_paragraphs", "n_licenses", "families", "confidence", "places")
    d = _io.pack(docs, ["text"], results).select("_others", "text")
    out = d.mapInArrow(_scan(sent, 1), _io.schema(d, ["_others"], "n_paragraphs long, n_licenses long, families string, confidence double, places string"))
    return out.select(*_io.unpack(out, docs.columns, [], ("text", *results)), *results)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines; long ones in overlapping windows) are bags of word unigrams and bigrams.  A
multinomial logistic regression over licence families and an ``unknown`` class is trained on
variants of the templates and on at most ``BACKGROUND`` paragraphs of the corpus; a temperature
fitted on held-out rows calibrates its probabilities.  A family that is predicted is confirmed
when the paragraph holds most of one of the family's templates, or is an excerpt of one.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import table
from tallsketch.session import ship_package

#: Background lines to train on, at most: of the distinct lines that hold no template those with the
#: smallest hashes; of a long one, one window.
BACKGROUND = 4000
#: Variants made of each template.
VARIANTS = 40
#: Probability that a family needs; words of a window and the step of windows.
MIN_PROBABILITY, WINDOW, STEP = 0.5, 120, 60
#: Shares of bigrams that confirm: of the template in the paragraph, of the paragraph in the template.
HOLDS, EXCERPT = 0.6, 0.8

#: Notices by which licences are granted, as their publishers word them.
TEMPLATES = {
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Released under the BSD 3-Clause License."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0 Universal."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU General Public License along with this program."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Released under the ISC License."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
            "Licensed under the Mozilla Public License 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
UNKNOWN = "unknown"
#: Sentences with licence words that grant nothing.
ORDINARY = [
    "You need a driving licence and the permission of the owner.", "All software should be tested before it is distributed.",
    "The terms of the agreement were published in the general report.", "He works under the new version of the law.",
    "The public may use the library free of charge.", "This work is by the author of the first version.",
    "A copy of the file is in the source directory.", "The above conditions are met in all cases.",
    "The program is free and open to any person.", "She was released without warranty or notice.",
]
WRAPPERS = ["", "", "Copyright (c) 2015 A. Writer.", "All files here:", "Note:", "This file is part of the collection.", "See below."]

WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def paragraphs(text: str | None):
    """(character offset, words) of each line with words; long lines in overlapping windows."""
    at = 0
    for line in (text or "").split("\n"):
        if len(line) > 12 * WINDOW or line.count(" ") >= WINDOW:
            found = [(m.start(), m.group()) for m in WORD.finditer(line.lower())]
            for k in range(0, max(1, len(found) - WINDOW + STEP), STEP):
                if part := found[k : k + WINDOW]:
                    yield at + part[0][0], [w for _, w in part]
        elif w := words(line):
            yield at, w
        at += len(line) + 1


@dataclass
class Classifier:
    families: list[str]               # the last is UNKNOWN
    grams: dict[str, int]             # single words
    pairs: dict[tuple[int, int], int]  # word numbers
    weights: np.ndarray               # (features, families)
    bias: np.ndarray
    heat: float = 1.0

    def features(self, w: list[str]) -> list[int]:
        """Distinct known unigrams and bigrams."""
        ids = [self.grams.get(x) for x in w]
        out = {i for i in ids if i is not None}
        pairs = self.pairs
        out.update(p for a, b in zip(ids, ids[1:]) if a is not None and b is not None and (p := pairs.get((a, b))) is not None)
        return sorted(out)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        logits = np.array([self.bias + self.weights[r].sum(axis=0) for r in rows]) / self.heat
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def similarity(self, family: str, w: list[str]) -> tuple[float, bool]:
        """The best share of a template's bigrams that the paragraph holds, and whether the
        comparison confirms the family."""
        have, best, ok = set(zip(w, w[1:])), 0.0, False
        for grams in _template_bigrams(family):
            both = len(have & grams)
            best = max(best, both / len(grams))
            ok |= both >= HOLDS * len(grams) or (len(have) >= 8 and both >= EXCERPT * len(have))
        return best, ok


_BIGRAMS: dict[str, list[set]] = {}


def _template_bigrams(family: str) -> list[set]:
    if family not in _BIGRAMS:
        _BIGRAMS[family] = [set(zip(w, w[1:])) for w in map(words, TEMPLATES[family])]
    return _BIGRAMS[family]


def variants() -> tuple[list[list[str]], list[str]]:
    rng, rows, labels = random.Random(11), [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for k in range(VARIANTS):
                w = words(f"{rng.choice(WRAPPERS)} {text} {rng.choice(WRAPPERS)}") if k else words(text)
                drop = 0.0 if k < VARIANTS // 2 else 0.1
                rows.append([x for x in w if rng.random() >= drop])
                labels.append(family)
    for text in ORDINARY:
        for _ in range(VARIANTS):
            rows.append([x for x in words(text) if rng.random() >= 0.1])
            labels.append(UNKNOWN)
    return rows, labels


def vocabulary(rows: list[list[str]]) -> tuple[list[str], dict[str, int], dict[tuple[int, int], int]]:
    """(families, single words, pairs of word numbers) of the training rows."""
    vocab = {g: i for i, g in enumerate(sorted({w for r in rows for w in r}))}
    pairs = {p: len(vocab) + i for i, p in enumerate(sorted({(vocab[a], vocab[b]) for r in rows for a, b in zip(r, r[1:])}))}
    return [*TEMPLATES, UNKNOWN], vocab, pairs


def train(docs: DataFrame, text: str = "text", background: int = BACKGROUND) -> Classifier:
    """Train on template variants and a bounded sample of the corpus' distinct lines without
    templates.  An empty corpus trains on the variants alone."""
    rows, labels = variants()
    families, vocab, pairs = vocabulary(rows)
    model = Classifier(families, vocab, pairs, np.zeros((len(vocab) + len(pairs), len(families))), np.zeros(len(families)))
    sample = background_features(docs, model, text, background)
    labels += [UNKNOWN] * len(sample)
    x = [model.features(r) for r in rows] + sample
    y = np.array([families.index(f) for f in labels])
    held = np.array([k % 4 == 3 for k in range(len(x))])
    _descend(model, [r for r, h in zip(x, held) if not h], y[~held])
    calm = [r for r, h in zip(x, held) if h]

    def loss(heat: float) -> float:
        model.heat = heat
        return -float(np.log(model.probabilities(calm)[np.arange(len(calm)), y[held]] + 1e-12).mean())

    model.heat = min(np.geomspace(0.25, 4, 17), key=loss)
    return model


def background_features(docs: DataFrame, model: Classifier, text: str, size: int) -> list[list[int]]:
    """The features of at most ``size`` distinct lines that hold no template, by the smallest hashes.

    Only lines below a hash threshold that about twice as many pass reach Python and the driver; the
    threshold grows until enough lines are left.  A repeated line counts once.  A line of several
    windows stands by the window that its hash deals out."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).filter("length(line) > 20")
    lines = lines.select("line", F.xxhash64("line").alias("h"))

    def run(batches):
        m = shared.value
        for b in batches:
            h, out = [], []
            for k, line in zip(b.column("h").to_pylist(), b.column("line")):
                parts = [w for _, w in paragraphs(line.as_py())]
                if not any(m.similarity(f, w)[1] for w in parts for f in TEMPLATES):
                    h.append(k)
                    out.append(m.features(parts[k % len(parts)]) if parts else [])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["h", "ids"])

    total = lines.agg(F.approx_count_distinct("h")).first()[0]
    share, got = 0.0, []
    while share < 1 and len(got) < size:
        share = min(1.0, 4 * share or 2.0 * size / max(total, 1))
        few = lines.filter(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else lines
        got = few.distinct().mapInArrow(run, "h long, ids array<int>").collect()  # about 2 * size rows of known features
    return [r["ids"] for r in sorted(got)[:size]]


def _descend(model: Classifier, x: list[list[int]], y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> None:
    """Gradient descent with per-weight step sizes on the mean log loss; rows are sparse."""
    lengths = np.array([len(r) for r in x])
    col = np.fromiter((i for r in x for i in r), np.int64, lengths.sum())
    row = np.repeat(np.arange(len(x)), lengths)
    order = np.argsort(col, kind="stable")
    used, starts = np.unique(col[order], return_index=True)
    goal = np.eye(len(model.families))[y]
    moment, moment_b = np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for _ in range(steps):
        logits = np.tile(model.bias, (len(x), 1))
        full = lengths > 0
        logits[full] += np.add.reduceat(model.weights[col], begin[full], axis=0)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - goal) / len(x)
        grad = ridge / len(x) * model.weights
        grad[used] += np.add.reduceat(g[row[order]], starts, axis=0)
        moment += grad**2
        model.weights -= 0.5 * grad / np.sqrt(moment)
        moment_b += g.sum(axis=0) ** 2
        model.bias -= 0.5 * g.sum(axis=0) / np.sqrt(moment_b)


def scan(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, found array<struct<at, family, probability, similarity, confirmed>>)
    per document: the paragraphs in which a family is predicted.

    One pass without a shuffle.  Null and empty texts have no paragraphs; repeated rows and null
    keys are scanned like any other; other columns are not read."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("at", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
                      ("similarity", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches):
        m = shared.value
        none = m.bias.argmax() == len(m.families) - 1
        for b in batches:
            counts, out = [], []
            for t in b.column(1):
                n, hold = 0, []
                for at, w in paragraphs(t.as_py()):
                    n += 1
                    f = m.features(w)
                    if f or not none:
                        hold.append((at, w, f))
                counts.append(n)
                got = []
                if hold:
                    p = m.probabilities([f for _, _, f in hold])
                    top = p[:, :-1].argmax(axis=1)
                    for k in np.flatnonzero(p[np.arange(len(p)), top] >= MIN_PROBABILITY):
                        family = m.families[top[k]]
                        alike, ok = m.similarity(family, hold[k][1])
                        got.append({"at": hold[k][0], "family": family, "probability": float(p[k, top[k]]),
                                    "similarity": alike, "confirmed": ok})
                out.append(got)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.list_(item))],
                                             names=[key, "n_paragraphs", "found"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, (
        f"`{key}` {kind}, n_paragraphs long, found array<struct<at: long, family: string, probability: double, "
        "similarity: double, confirmed: boolean>>"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sure = F.filter("found", lambda x: x["confirmed"])
    return scan(docs, train(docs)).select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))).alias("predicted"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))).alias("families"),
        F.array_max(F.transform("found", lambda x: x["probability"])).alias("probability"))


QUERIES = {"op1_license_scan": op1_license_scan}

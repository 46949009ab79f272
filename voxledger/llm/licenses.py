"""Operator 4: licence scans with a paragraph classifier.

A paragraph is a line of text, or a notice that was wrapped over any number of neighbouring lines. Multinomial logistic
regression over hashed word and word-pair features gives each paragraph a probability for every licence family and
for `unknown`. It is trained here on variants of the family templates (words dropped, prose around them, parts of
long ones), and, as unknown, on prose of the corpus (at most `sample_paragraphs` paragraphs of `sample_docs`
documents: documented bounds) and on licence-like sentences whose family words have been replaced. A temperature
calibrates it: it is fitted on variants of every other template of each family, and prose, that a model of the rest
has not seen. A paragraph counts as a licence if some family has MIN_PROBABILITY or more and a template of that
family confirms it: CONFIRM or more of the template's word pairs are in the paragraph.

Lines are classified one by one. A line in which a family has SEED or more, and which isn't confirmed with a whole
template, is where wrapped notices are looked for: for each template that shares a word pair with it or its
neighbours, a run grows from the line, by the line above or below that adds more of the template's pairs (above on
ties), until neither adds any, or is blank or confirmed with a whole template. Of the lines and runs that are
confirmed, those with the largest share of a template come first, then the shorter and the earlier ones; each that
overlaps none taken before is reported, at its first line. All paragraphs of all documents are classified, over
whole texts. Scoring is row by row; nothing is shuffled.

Null and empty texts have no paragraphs. Repeated rows are scanned one by one and alike. An empty corpus still
trains, on templates and word-like noise, and gives no rows. Columns but doc_id and text, whatever their names, are
not read. Texts are classified some 500,000 words at a time, but never cut within a run of lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from .common import read_table

BUCKETS = 1 << 16
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 4000
MIN_PROBABILITY = 0.5
CONFIRM = 0.6
#: A notice that is wrapped over several lines is found from one that has a family of this probability.
SEED = 0.1
UNKNOWN = "unknown"

#: Notices by which licence families are declared.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL v2 or later.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Distributed under the terms of the GNU LGPL."],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission.", "Copyright reserved; redistribution is prohibited without written permission."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This text is in the public domain."],
}
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]

#: A-Z lowered; ASCII bytes but letters and digits become spaces; line feeds stay.
WORDS = bytes(b if b == 10 else b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
#: Combines the hashes of two neighbours; spread over the buckets by its upper bits.
_PAIR = np.uint32(0x9E3779B1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = zlib.crc32(word)
        return h


def _spread(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def paragraph_features(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of paragraphs one after another, and how many each has: its words and word pairs."""
    lengths = np.array([len(w) for w in words], np.int64)
    get = _Hashes().__getitem__
    flat = np.fromiter((get(w) for p in words for w in p), np.uint32, int(lengths.sum()))
    nxt = np.r_[flat[1:], np.zeros(min(1, len(flat)), np.uint32)]
    pair = _spread(flat * _PAIR + nxt)
    ends = np.cumsum(lengths)
    pair[ends[lengths > 0] - 1] = _spread(flat[ends[lengths > 0] - 1] ^ np.uint32(0xFFFFFFFF))  # the last word closes the paragraph
    return np.stack([_spread(flat), pair], axis=1).reshape(-1), 2 * lengths


@dataclass
class LicenseModel:
    weights: np.ndarray  # buckets x families
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, words: list[list[bytes]]) -> np.ndarray:
        """A row of family probabilities for each paragraph; paragraphs must have words."""
        features, lengths = paragraph_features(words)
        starts = np.cumsum(lengths) - lengths
        z = np.add.reduceat(self.weights[features], starts, axis=0) / np.sqrt(lengths)[:, None] + self.bias
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = {f: [_pairs(t.encode().translate(WORDS).split()) for t in ts] for f, ts in TEMPLATES.items()}


#: The pairs of each template, and the numbers of the templates that have a pair.
_PAIRS_OF = [p for ps in _TEMPLATE_PAIRS.values() for p in ps]
_TEMPLATES_WITH = {pair: [t for t, p in enumerate(_PAIRS_OF) if pair in p] for ps in _PAIRS_OF for pair in ps}


def containment(family: str, words: list[bytes]) -> float:
    """The largest share of a family template's word pairs that the paragraph has."""
    own = _pairs(words)
    return max(len(p & own) / len(p) for p in _TEMPLATE_PAIRS[family])


def _parity(template: int) -> int:
    return template % 2


def training_set(prose: list[list[bytes]], seed: int = 7, per_template: int = 90) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Paragraphs, family numbers and halves: variants of templates, prose, and notices of no known family.
    Every other template of a family, and every other piece of prose, is in half 1."""
    rng = np.random.default_rng(seed)
    prose = [p for p in prose if p] or [[b"lorem", b"text", b"of", b"no", b"licence"]]
    words, family, half = [], [], []
    common = re.compile(rb"(?i)license|licensed|under|the|released|this|work|is|a|an|version|of|terms|in|to")

    def add(paragraph: list[bytes], of: int, part: int) -> None:
        words.append(paragraph)
        family.append(of)
        half.append(part)

    for f, ts in TEMPLATES.items():
        for number, t in enumerate(ts):
            base, part = t.encode().translate(WORDS).split(), _parity(number)
            for i in range(per_template):
                keep = [w for w in base if rng.random() > 0.06] or base
                if len(keep) > 11 and i % 4 == 3:  # a line of a wrapped notice
                    n = int(rng.integers(len(keep) * 2 // 5, len(keep)))
                    at = int(rng.integers(len(keep) - n + 1))
                    keep = keep[at : at + n]
                around = prose[int(rng.integers(len(prose)))]
                cut = int(rng.integers(0, 9)) if i % 3 else 0
                add(around[:cut] + keep + around[cut : cut + int(rng.integers(0, 5)) * (i % 2)], FAMILIES.index(f), part)
                if i % 3 == 0:  # the same notice with its telling words replaced
                    pool = prose[int(rng.integers(len(prose)))]
                    other = [w if common.fullmatch(w) else pool[int(rng.integers(len(pool)))] for w in base]
                    if other != base:
                        add(other, 0, part)
    for i, p in enumerate(prose):
        add(p, 0, i % 2)
    return words, np.array(family), np.array(half)


def fit(words: list[list[bytes]], family: np.ndarray, epochs: int = 15, l2: float = 1e-5, seed: int = 7) -> LicenseModel:
    """Adagrad on mini-batches."""
    rng = np.random.default_rng(seed)
    k = len(FAMILIES)
    features, lengths = paragraph_features(words)
    starts = np.cumsum(lengths) - lengths
    w, b = np.zeros((BUCKETS, k)), np.zeros(k)
    gw, gb = np.full((BUCKETS, k), 1e-6), np.full(k, 1e-6)
    train = np.flatnonzero(lengths > 0)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
            cols = np.concatenate([features[starts[r] : starts[r] + lengths[r]] for r in rows])
            of = np.repeat(np.arange(len(rows)), lengths[rows])
            scale = 1 / np.sqrt(lengths[rows])
            z = np.zeros((len(rows), k))
            np.add.at(z, of, w[cols])
            g = softmax(z * scale[:, None] + b)
            g[np.arange(len(rows)), family[rows]] -= 1
            used, back = np.unique(cols, return_inverse=True)
            step = np.zeros((len(used), k))
            np.add.at(step, back, (g * scale[:, None])[of])
            step = step / len(rows) + l2 * w[used]
            gw[used] += step**2
            w[used] -= 0.5 * step / np.sqrt(gw[used])
            gb += g.mean(axis=0) ** 2
            b -= 0.5 * g.mean(axis=0) / np.sqrt(gb)
    return LicenseModel(w.astype(np.float32), b)


def temperature(model: LicenseModel, words: list[list[bytes]], family: np.ndarray) -> float:
    """The temperature under which the model's probabilities of unseen paragraphs have the least log loss."""
    logits = np.log(model.probabilities(words) + 1e-12)
    grid = np.linspace(0.5, 2, 16)
    loss = [-np.log(softmax(logits / t)[np.arange(len(words)), family] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_calibrated(words: list[list[bytes]], family: np.ndarray, half: np.ndarray) -> LicenseModel:
    """Fit on all paragraphs, with the mean temperature of two models that have seen one half each."""
    found = []
    for part in (0, 1):
        seen, unseen = np.flatnonzero(half == part), np.flatnonzero(half != part)
        model = fit([words[i] for i in seen], family[seen])
        found.append(temperature(model, [words[i] for i in unseen], family[unseen]))
    model = fit(words, family)
    model.temperature = sum(found) / len(found)
    return model


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> LicenseModel:
    """Prose is at most `sample_paragraphs` paragraphs (least hashes) of at most `sample_docs` documents (least
    hashes of doc_id); those that a template nearly matches aren't prose."""
    chosen = docs.select(F.col("doc_id").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs).distinct()
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    lines = own.select(F.explode(F.split("text", "\n", -1)).alias("line")).where(F.trim("line") != "")
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(sample_paragraphs).collect()
    prose = [r["line"].encode().translate(WORDS).split() for r in rows]
    return fit_calibrated(*training_set([p for p in prose if p and max(containment(f, p) for f in TEMPLATES) < 0.3]))


FOUND = T.StructType(
    [
        T.StructField("n_paragraphs", T.LongType()),
        T.StructField("licenses", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("match", T.DoubleType()), T.StructField("lines", T.LongType())]))),
    ]
)
_LICENSE = pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64()), ("lines", pa.int64())])
_FOUND = pa.struct([("n_paragraphs", pa.int64()), ("licenses", pa.list_(_LICENSE))])


def confirmed(words: list[list[bytes]], p: np.ndarray) -> dict[int, dict]:
    """Of each paragraph that is a licence: its family, probability and share of the template."""
    best = 1 + np.argmax(p[:, 1:], axis=1)
    out = {}
    for i in np.flatnonzero(p[np.arange(len(p)), best] >= MIN_PROBABILITY).tolist():
        if (match := containment(FAMILIES[best[i]], words[i])) >= CONFIRM:
            out[i] = {"family": FAMILIES[best[i]], "probability": float(p[i, best[i]]), "match": match}
    return out


def _grown(words: list[list[bytes]], joins: Callable[[int], bool], seed: int, known: dict[int, set]) -> set[tuple[int, int]]:
    """(first line, lines) of the runs that grow from a line, one for each template that it or a neighbour shares a pair with.
    joins(k): may line k be in a run with line k + 1?"""

    def pairs(k: int) -> set:
        """The template pairs in line k, and across its end if the next line joins."""
        if k not in known:
            own = _pairs(words[k] + words[k + 1][:1] if joins(k) else words[k])
            known[k] = {p for p in own if p in _TEMPLATES_WITH}
        return known[k]

    near = pairs(seed) | (pairs(seed - 1) if joins(seed - 1) else set()) | (pairs(seed + 1) if joins(seed) else set())
    runs = set()
    for t in {t for p in near for t in _TEMPLATES_WITH[p]}:
        template, a, b = _PAIRS_OF[t], seed, seed
        have = template & _pairs(words[seed])
        while True:
            # pairs(k) holds those across the end of k, so a line below counts with the line before it
            up = len(template & pairs(a - 1) - have) if joins(a - 1) else 0
            down = len(template & (pairs(b) | _pairs(words[b + 1])) - have) if joins(b) else 0
            if not up and not down:
                break
            if up >= down:
                a -= 1
                have |= template & pairs(a)
            else:
                have |= template & (pairs(b) | _pairs(words[b + 1]))
                b += 1
        if b > a:
            runs.add((a, b - a + 1))
    return runs


def _notices(words: list[list[bytes]], where: list[tuple[int, int]], p: np.ndarray, model: LicenseModel) -> list[tuple[int, dict]]:
    """Confirmed notices, (first paragraph, licence), of one line or of several."""
    alone = confirmed(words, p)
    whole = {i for i, x in alone.items() if x["match"] == 1}

    def joins(k: int) -> bool:
        return 0 <= k < len(words) - 1 and where[k + 1] == (where[k][0], where[k][1] + 1) and k not in whole and k + 1 not in whole

    known: dict[int, set] = {}
    seeds = np.flatnonzero(p[:, 1:].max(axis=1) >= SEED).tolist()
    runs = sorted(set().union(*(_grown(words, joins, i, known) for i in seeds if i not in whole)))
    hits = {(i, 1): x for i, x in alone.items()}
    if runs:
        joined = [[w for k in range(a, a + n) for w in words[k]] for a, n in runs]
        hits |= {runs[i]: x for i, x in confirmed(joined, model.probabilities(joined)).items()}
    taken: set[int] = set()
    out = []
    for (a, n), x in sorted(hits.items(), key=lambda h: (-h[1]["match"], h[0][1], h[0][0])):
        if not taken.intersection(range(a, a + n)):
            taken.update(range(a, a + n))
            out.append((a, x | {"lines": n}))
    return out


def scan(texts: list[bytes | None], model: LicenseModel) -> list[dict]:
    """Lines with words, and the confirmed licences with their first lines, of each text."""
    out, words, where = [], [], []

    def flush() -> None:
        if words:
            p = model.probabilities(words)
            for i, x in _notices(words, where, p, model):
                doc, line = where[i]
                out[doc]["licenses"].append({"line": line} | x)
        words.clear()
        where.clear()

    size = 0
    for doc, text in enumerate(texts):
        out.append({"n_paragraphs": 0, "licenses": []})
        for line, p in enumerate((text or b"").translate(WORDS).split(b"\n")):
            if own := p.split():
                out[doc]["n_paragraphs"] += 1
                words.append(own)
                where.append((doc, line))
                size += len(own)
            elif size > 500_000:  # never between the lines of a run
                flush()
                size = 0
        if size > 500_000:
            flush()
            size = 0
    flush()
    for x in out:
        x["licenses"].sort(key=lambda y: y["line"])
    return out


def _scan_column(spark: SparkSession, text: Column, model: LicenseModel) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf(FOUND)
    def run(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in data:
            yield pa.array(scan(x.to_pylist(), sent.value), _FOUND)

    return run(text.cast("binary"))


def scan_documents(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_paragraphs and the licences (line, family, probability, match) of every row."""
    return docs.select("doc_id", _scan_column(docs.sparkSession, F.col("text"), model).alias("f")).select("doc_id", "f.n_paragraphs", "f.licenses")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan_documents(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(families, ",").alias("families"), F.round(F.array_max(F.transform("licenses", lambda x: x["probability"])), 4).alias("top_probability"))

"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines with a word) become sets of hashed word n-grams. A sparse multinomial logistic regression, trained
with numpy on variations of templates and on paragraphs that name no licence, gives a family with a probability; the
unknown class takes what stays under a threshold calibrated on held-out variations. A prediction counts only if the
paragraph also holds enough of one of its family's templates. Statements that run over several lines are found by
joining the lines between blank ones: where enough of a template stands together across a line's end, the words from
its first to its last n-gram are classified as a paragraph is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.textvec import U64, Words, chunks, mix

#: Statements by which texts and source files name their licence, by family. '#' stands for a number.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "spdx-license-identifier: agpl-3.0-only",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license",
        "released under the apache 2.0 license",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind",
        "spdx-license-identifier: apache-2.0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "licensed under the bsd 3-clause license",
        "released under the bsd license",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "spdx-license-identifier: bsd-3-clause",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under the creative commons attribution license",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under the creative commons attribution non-commercial license",
    ),
    "cc-by-sa": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "text is available under the creative commons attribution-sharealike license",
    ),
    "cc0": (
        "dedicated to the public domain under cc0 1.0 universal",
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "released under the cc0 1.0 public domain dedication",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
        "released under the gnu gpl version 2 or any later version",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx-license-identifier: gpl-3.0-or-later",
    ),
    "isc": (
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "licensed under the isc license",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier: lgpl-2.1-or-later",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx-license-identifier: mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license, v. 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
    "proprietary": (
        "all rights reserved; unauthorized copying of this file via any medium is strictly prohibited; proprietary and confidential",
        "this software is proprietary and may not be copied, used or distributed without the written permission of its owner",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose",
    ),
}
#: Sentences near the subject that name no licence.
NEUTRAL = (
    "see the license file for details",
    "the license of the driver was renewed by the office",
    "copyright notices may be found in the documentation",
    "this work was published under a pen name",
    "the software was released in the spring with many changes",
    "the public was free to use the general hall without permission",
    "all copies were sold under the terms of the contract",
    "the team distributed the files and modified the source",
    "version 2.0 of the program was released under pressure",
    "subject to the conditions of the agreement the owner may use the property",
    "a dog license is required by law in the state",
    "the author has worked on the creative side of commons for years",
)


@dataclass(frozen=True)
class LicenseConfig:
    """variations: training texts per template. background: most corpus rows whose paragraphs serve as the unknown class, the
    documented bound of the sample; paragraphs: most paragraphs of each of them. confirm: least share of a template's n-grams."""

    bits: int = 20
    grams: int = 3
    variations: int = 60
    background: int = 400
    paragraphs: int = 20
    steps: int = 300
    rate: float = 0.1
    l2: float = 1e-4
    missed: float = 0.02
    confirm: float = 0.65
    seed: int = 11


@dataclass(frozen=True)
class LicenseModel:
    """families[0] is the unknown class. ids: hashed n-grams with weights (ids, families), sorted. templates: of each
    family the n-grams of its templates."""

    families: tuple[str, ...]
    ids: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    templates: tuple[tuple[np.ndarray, ...], ...]
    cfg: LicenseConfig


#: Bytes that make a word more than the marker of a comment: letters, digits and all beyond ASCII.
_SAYS = np.zeros(256, dtype=bool)
_SAYS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Paragraphs:
    """Lines with a word in a slice of texts: row, byte span in data and hashed n-grams by paragraph."""

    def __init__(self, texts: pa.Array, cfg: LicenseConfig):
        w = Words(texts)
        self.words = w
        start, end = w.start.copy(), w.end.copy()
        drop = np.zeros(256, dtype=bool)
        drop[[ord(c) for c in ".,;:!?\"'()[]<>*#/"]] = True
        for _ in range(2):
            end -= (end - start > 1) & drop[w.data[end - 1]] if len(end) else 0
            start += (end - start > 1) & drop[w.data[start]] if len(start) else 0
        lines = np.cumsum(np.concatenate(([0], w.data == 10)))
        rows = w.rows()
        own = rows * (int(lines[-1]) + 1) + lines[w.start]
        new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        self.first = np.append(np.flatnonzero(new), len(own))
        self.row = rows[self.first[:-1]]
        self.begin = w.start[self.first[:-1]]
        self.end = w.end[self.first[1:] - 1] if len(own) else np.zeros(0, np.int64)
        self.number = np.cumsum(new) - 1
        self.hash = w.span_hash(start, end)
        self.gram, first, _ = _grams(self.hash, self.number, cfg)
        self.owner = self.number[first]
        self.line, self.word_row = lines[w.start], rows
        said = np.cumsum(np.concatenate(([0], _SAYS[w.data])))
        self.says = said[end] > said[start]

    def __len__(self) -> int:
        return len(self.row)

    def sets(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (paragraph, n-gram) pairs; wanted: a mask of n-grams to keep."""
        gram, owner = self.gram, self.owner
        if wanted is not None:
            keep = wanted[gram]
            gram, owner = gram[keep], owner[keep]
        bits = int(gram.max(initial=0)).bit_length()
        both = np.unique(owner << bits | gram)
        return both >> bits, both & ((1 << bits) - 1)


def _grams(h: np.ndarray, number: np.ndarray, cfg: LicenseConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words that have one number: the n-gram, its first word and how many more it has."""
    shift = U64(64 - cfg.bits)
    grams, first, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    gram = np.zeros(len(h), dtype=U64)
    for k in range(cfg.grams):
        n = len(h) - k
        if n <= 0:
            break
        gram = mix(gram[:n] * U64(0x9E3779B97F4A7C15) + h[k:])
        whole = np.flatnonzero(number[:n] == number[k:])
        grams.append((gram[whole] >> shift).astype(np.int64))
        first.append(whole)
        more.append(np.full(len(whole), k))
    return np.concatenate(grams), np.concatenate(first), np.concatenate(more)


def _vary(template: str, rng: np.random.Generator) -> str:
    words = template.split()
    if len(words) > 5 and rng.random() < 0.5:
        words.pop(int(rng.integers(len(words))))
    if rng.random() < 0.3:
        words = ["copyright", f"{1990 + int(rng.integers(40))}", *words]
    if rng.random() < 0.3:
        words = [*words, "see", "license", "for", "details"]
    if rng.random() < 0.3:
        at = int(rng.integers(len(words) + 1))
        words[at:at] = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))]
    if len(words) > 12 and rng.random() < 0.3:
        cut = int(rng.integers(8, len(words)))
        words = words[:cut]
    return " ".join(words)


def train(background: list[str], cfg: LicenseConfig | None = None) -> LicenseModel:
    """Fit on variations of TEMPLATES, NEUTRAL and its shuffles, and background paragraphs; deterministic for equal input."""
    cfg = cfg or LicenseConfig()
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    families = ("unknown", *TEMPLATES)
    texts, labels = [], []
    for k, name in enumerate(families[1:], 1):
        for template in TEMPLATES[name]:
            for _ in range(cfg.variations):
                texts.append(_vary(template, rng))
                labels.append(k)
            # Words of a licence in any order name none.
            for _ in range(cfg.variations // 6):
                texts.append(" ".join(rng.permutation(template.split())))
                labels.append(0)
    for line in NEUTRAL:
        for _ in range(cfg.variations // 3):
            texts.append(_vary(line, rng))
            labels.append(0)
    texts += background
    labels += [0] * len(background)
    y = np.array(labels)
    seen = Paragraphs(pa.array(["".join(c if c >= " " else " " for c in t) or "-" for t in texts]), cfg)
    owner, gram = seen.sets()
    licensed = np.unique(gram[y[seen.row[owner]] > 0])
    keep = np.isin(gram, licensed)
    owner, gram = owner[keep], np.searchsorted(licensed, gram[keep])
    y = y[seen.row]
    held = rng.random(len(y)) < 0.2
    w, b = np.zeros((len(licensed), len(families))), np.zeros(len(families))
    size = np.maximum(np.bincount(owner, minlength=len(y)), 1) ** 0.5
    target = np.eye(len(families))[y]
    order = np.argsort(gram, kind="stable")
    columns, at = np.unique(gram[order], return_index=True)
    edges = np.searchsorted(owner, np.arange(len(y)))

    def scores() -> np.ndarray:
        out = np.zeros((len(y), len(families)))
        full = np.flatnonzero(np.bincount(owner, minlength=len(y)))
        out[full] = np.add.reduceat(w[gram], edges[full], axis=0) / size[full, None]
        z = out + b
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    share = np.where(held, 0.0, 1.0)[:, None] / max((~held).sum(), 1)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, cfg.steps + 1):
        d = (scores() - target) * share
        per = (d / size[:, None])[owner[order]]
        gw = np.zeros_like(w)
        gw[columns] = np.add.reduceat(per, at, axis=0)
        gw += cfg.l2 * w
        gb = d.sum(0)
        for g, p, m, v in ((gw, w, mw, vw), (gb, b, mb, vb)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # The threshold at which no more than `missed` of held-out licensed texts fall to the unknown class.
    best = scores()[held & (y > 0)][:, 1:].max(1, initial=0.0)
    threshold = float(min(0.9, max(0.6, np.quantile(best, cfg.missed)))) if len(best) else 0.6
    templates = []
    for name in families[1:]:
        p = Paragraphs(pa.array(list(TEMPLATES[name])), cfg)
        o, g = p.sets()
        templates.append(tuple(np.searchsorted(licensed, g[(o == i) & np.isin(g, licensed)]) for i in range(len(p))))
    return LicenseModel(families, licensed, w.astype(np.float32), b.astype(np.float32), threshold, tuple(templates), cfg)


def _chances(owner: np.ndarray, column: np.ndarray, model: LicenseModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, the places of their first pairs, and the probabilities of their families; owner is sorted."""
    some, at, count = np.unique(owner, return_index=True, return_counts=True)
    z = np.add.reduceat(model.weights[column], at, axis=0) / np.sqrt(count)[:, None] + model.bias
    z = np.exp(z - z.max(1, keepdims=True))
    return some, np.append(at, len(owner)), z / z.sum(1, keepdims=True)


def classify(p: Paragraphs, model: LicenseModel, wanted: np.ndarray) -> Iterator[tuple[int, int, int, str, float]]:
    """(row, byte start, byte end, family, probability) of the licensed ones of paragraphs and of statements over several."""
    owner, gram = p.sets(wanted)
    if not len(owner):
        return
    column = np.searchsorted(model.ids, gram)
    some, at, z = _chances(owner, column, model)
    best = z.argmax(1)
    named: set[tuple[int, int]] = set()
    for k in np.flatnonzero((best > 0) & (z[np.arange(len(best)), best] >= model.threshold)).tolist():
        own = column[at[k] : at[k + 1]]
        found = max(np.isin(t, own).mean() if len(t) else 0.0 for t in model.templates[best[k] - 1])
        if found >= model.cfg.confirm:
            named.add((int(some[k]), int(best[k])))
            yield _span(p, some[k], some[k], model.families[best[k]], z[k, best[k]])
    for first, last, family, chance in wrapped(p, model, wanted):
        # Where a line alone names the family, the lines around it add nothing.
        if not any((n, family) in named for n in range(first, last + 1)):
            yield _span(p, first, last, model.families[family], chance)


def _span(p: Paragraphs, first: int, last: int, family: str, chance: float) -> tuple[int, int, int, str, float]:
    row = int(p.row[first])
    return row, int(p.begin[first] - p.words.offs[row]), int(p.end[last] - p.words.offs[row]), family, float(chance)


def _windows(first: np.ndarray, end: np.ndarray, column: np.ndarray, need: int) -> Iterator[tuple[int, int]]:
    """For each place where it changes, the shortest stretch of words up to there with `need` distinct n-grams."""
    latest: dict[int, int] = {}
    order = np.lexsort((first, end))
    for a, b, c in zip(first[order].tolist(), end[order].tolist(), column[order].tolist(), strict=True):
        latest[c] = max(a, latest.get(c, -1))
        if len(latest) >= need:
            yield sorted(latest.values())[-need], b


def wrapped(p: Paragraphs, model: LicenseModel, wanted: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first paragraph, last paragraph, family number, probability) of statements that run over several lines.

    Lines are joined up to a blank one; words without a letter or digit (comment markers) are left out, so a line of them
    is blank. A stretch counts if it holds cfg.confirm of a template's n-grams in at most twice the template's words.
    """
    kept = np.flatnonzero(p.says)
    if not len(kept):
        return []
    line, row = p.line[kept], p.word_row[kept]
    new = np.concatenate(([True], (np.diff(line) > 1) | (np.diff(row) > 0)))
    block = np.cumsum(new) - 1
    edges = np.append(np.flatnonzero(new), len(kept))
    several = (line[edges[1:] - 1] > line[edges[:-1]])[block]
    kept, line, block = kept[several], line[several], block[several]
    gram, first, more = _grams(p.hash[kept], block, model.cfg)
    keep = wanted[gram]
    column, first, end = np.searchsorted(model.ids, gram[keep]), first[keep], (first + more)[keep] + 1
    owner = block[first]
    order = np.lexsort((column, owner))
    column, first, end, owner = column[order], first[order], end[order], owner[order]
    if not len(owner):
        return []
    holds, sizes, words, family = _incidence(model)
    some = np.concatenate(([True], (np.diff(owner) > 0) | (np.diff(column) > 0))) & holds.any(1)[column]
    pairs = np.flatnonzero(some)
    if not len(pairs):
        return []
    blocks, at = np.unique(owner[pairs], return_index=True)
    need = np.maximum(np.ceil(model.cfg.confirm * sizes - 1e-9), 1).astype(np.int64)
    counts = np.add.reduceat(holds[column[pairs]], at, axis=0, dtype=np.uint16)
    stretches: dict[tuple[int, int], list[list[int]]] = {}
    for k, t in zip(*np.nonzero(counts >= need), strict=True):
        low, high = np.searchsorted(owner, [blocks[k], blocks[k] + 1])
        own = low + np.flatnonzero(holds[column[low:high], t])
        spans = stretches.setdefault((int(blocks[k]), int(t)), [])
        for a, b in _windows(first[own], end[own], column[own], int(need[t])):
            if b - a <= 2 * words[t] and line[a] < line[b - 1]:
                if spans and a < spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
    found: dict[int, list[tuple[int, int, float]]] = {}
    for (k, t), spans in stretches.items():
        low, high = np.searchsorted(owner, [k, k + 1])
        for a, b in spans:
            inside = np.unique(column[low:high][(first[low:high] >= a) & (end[low:high] <= b)])
            _, _, z = _chances(np.zeros(len(inside), np.int64), inside, model)
            if z[0].argmax() == family[t] and z[0].max() >= model.threshold:
                found.setdefault(int(family[t]), []).append((int(p.number[kept[a]]), int(p.number[kept[b - 1]]), float(z[0].max())))
    out: list[tuple[int, int, int, float]] = []
    for f, spans in found.items():
        joined: list[tuple[int, int, float]] = []
        for a, b, chance in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), max(chance, joined[-1][2]))
            else:
                joined.append((a, b, chance))
        out += [(a, b, f, chance) for a, b, chance in joined]
    return out


def _incidence(model: LicenseModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which template holds which n-gram, and of each template the distinct n-grams, the words and the family's number."""
    all_of = [(t, len(text.split()), k) for k, name in enumerate(model.families[1:], 1) for t, text in zip(model.templates[k - 1], TEMPLATES[name], strict=True)]
    holds = np.zeros((len(model.ids), len(all_of)), dtype=np.uint8)
    for k, (t, _, _) in enumerate(all_of):
        holds[t, k] = 1
    sizes, words, family = (np.array(x) for x in zip(*((len(t), n, f) for t, n, f in all_of), strict=True))
    return holds, sizes, words, family


def background(documents: DataFrame, cfg: LicenseConfig | None = None) -> list[str]:
    """Paragraphs of up to cfg.background rows, in the order of the ids' hash; those that speak of licences are left out."""
    cfg = cfg or LicenseConfig()
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.background)
    # At most cfg.background ids, a proven bound.
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), 1, cfg.paragraphs)
    lines = rows.select("doc_id", F.explode(lines).alias("line")).select("doc_id", F.substring("line", 1, 400).alias("line"))
    plain = lines.filter(~F.lower("line").rlike("licen[cs]e|copyright|redistribut|warrant|public domain|spdx"))
    return [r["line"] for r in plain.orderBy("doc_id", "line").limit(cfg.background * cfg.paragraphs).collect()]


SCAN = "doc_id long, n_paragraphs long, families string, spans string, least_probability double"


def scan_licenses(documents: DataFrame, model: LicenseModel | None = None, cfg: LicenseConfig | None = None) -> DataFrame:
    """One row for every row of documents (doc_id, text): the families that it names, sorted, and their spans.

    spans: family:start:end in code points, by start, over whole lines; n_paragraphs counts the lines with a word. Null and blank texts have no paragraphs and name nothing; then families and
    spans are empty and least_probability is null. Repeated rows are scanned each. Whole texts are read.
    """
    cfg = cfg or LicenseConfig()
    model = model or train(background(documents, cfg), cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << model.cfg.bits, dtype=bool)
        wanted[model.ids] = True
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                n = len(texts)
                lines = Paragraphs(texts, model.cfg)
                counts = np.bincount(lines.row, minlength=n)
                spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
                least: list[float | None] = [None] * n
                for row, start, end, family, chance in classify(lines, model, wanted):
                    data = texts[row].as_py().encode()
                    start, end = len(data[:start].decode()), len(data[:end].decode())
                    spans[row].append((start, end, family))
                    least[row] = min(chance, least[row] if least[row] is not None else 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n),
                        pa.array(counts),
                        pa.array([",".join(sorted({f for _, _, f in x})) for x in spans]),
                        pa.array([",".join(f"{f}:{a}:{b}" for a, b, f in sorted(x)) for x in spans]),
                        pa.array(least, pa.float64()),
                    ],
                    names=[x.split()[0] for x in SCAN.split(", ")],
                )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCAN)

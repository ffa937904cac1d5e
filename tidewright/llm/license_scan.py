"""License scans: a trained paragraph classifier.

Every paragraph (line) is classified by multinomial logistic regression over sparse word 1- to 2-grams into licence
families or unknown. It is trained here, on the templates below with words left out, put in and replaced, and as unknown on the first line (its first
FIRST characters) of a bounded sample of the documents, without lines that hold most of a template's words. A temperature and the least probability that counts as known are calibrated on
held-back training paragraphs. A prediction stands only if it matches a template of its family: the share of
the template's words, in order, that the paragraph has.

Statements wrapped over lines are found in runs of adjacent lines where the classifier gives a line, or TOGETHER adjacent ones, a chance of HINT or more to state a licence: those that have the template's words in order, to the same share,
within twice the template's number of words, foreign words between them included. Lines without a word (blank ones, bare comment marks) part
runs; comment marks before a line's text are not words of it. The words from the first to the last of the template's are classified and must
be of its family. A run is reported at its first line, in place of what a line of it alone would state with fewer words of a template;
of runs that overlap, the one with most words of a template.

Nulls and odd rows: a null or empty text has no paragraph and so no finding; a null doc_id is reported as null; repeated rows and
repeated paragraphs are reported each; a word split by a hyphen at a line's end is also read whole; a text without line breaks is one paragraph, however long; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Words, segment_sums
from .common import kept, only

#: How public licences are stated.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License, see the LICENSE file for details.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0 Universal.", "The author has dedicated the work to the public domain by waiving all rights under the CC0 dedication."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Zlib": ["Licensed under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "All rights reserved": ["Copyright (c) 2020. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}
FAMILIES = ["unknown", *TEMPLATES]
VARIANTS, NEGATIVES, FIRST, STEPS, MATCH, HINT, TOGETHER = 60, 4000, 300, 200, 0.7, 0.1, 4
#: Comment marks that are words; others hold no word.
_MARK = re.compile(r"^\s*(?:@?rem|dnl)(?=\s|$)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.\-+/][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return [w for x in _WORD.findall(text.lower()) for w in (x, *(p for p in re.split(r"[.\-+/]", x) if p != x))]


def grams(words: list[str]) -> list[str]:
    return [*dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Classifier:
    def __init__(self, negatives: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        loose = [w for t in negatives[:200] for w in t.split()][:4000] or ["text"]
        texts, y = [], []
        for k, family in enumerate(FAMILIES[1:], 1):
            for template in TEMPLATES[family]:
                words = template.split()
                for v in range(VARIANTS):
                    w = list(words)
                    for _ in range(0 if v < VARIANTS // 4 else rng.integers(1, 2 + len(w) // 8)):
                        i, how = int(rng.integers(len(w))), rng.integers(3)
                        if how == 0 and len(w) > len(words) - max(1, len(words) // 8):
                            del w[i]
                        else:
                            w.insert(i, str(rng.choice(loose)))
                    texts.append(" ".join([*rng.choice(loose, rng.integers(0, 5)), *w] if v % 3 == 2 else w))
                    y.append(k)
        # What states no licence: paragraphs of the corpus, and the templates' own words out of order.
        plain = list(negatives)
        stock = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
        plain += [" ".join(rng.choice(stock, rng.integers(2, 9))) for _ in range(1500)]
        texts += plain
        y = np.array(y + [0] * len(plain))
        each = [grams(tokens(t)) for t in texts]
        count: dict[str, int] = {}
        for g, k in zip(each, y.tolist(), strict=True):
            for x in g if k else ():
                count[x] = count.get(x, 0) + 1
        self.vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in count.items() if c >= 3))}
        held = rng.random(len(y)) < 0.2
        rows = [np.array([self.vocabulary[x] for x in g if x in self.vocabulary], np.int64) for g in each]
        self.weights, self.bias, self.temperature, self.least = np.zeros((len(self.vocabulary) + 1, len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, 0.5
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        fitted = ~held
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        x[owner, flat] = 1
        norm = np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
        x /= norm
        target = np.eye(len(FAMILIES))[y]
        w, b = np.zeros((x.shape[1], len(FAMILIES))), np.zeros(len(FAMILIES))
        own = 1 / np.bincount(y[fitted], minlength=len(FAMILIES)).clip(1)[y[fitted], None]
        own /= own.mean()
        for _ in range(STEPS):
            d = (_softmax(x[fitted] @ w + b) - target[fitted]) * own / fitted.sum()
            w -= 40 * (x[fitted].T @ d + 1e-6 * w)
            b -= 10 * d.sum(axis=0)
        self.weights, self.bias = w, b
        scores = x[held] @ w + b
        losses = {t: -np.log(_softmax(scores / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3)} if held.any() else {1.0: 0}
        self.temperature = min(losses, key=losses.get)
        if held.any():  # the least probability at which hardly any unknown paragraph passes
            p = _softmax(scores / self.temperature)[:, 1:].max(axis=1)
            wrong = p[y[held] == 0]
            self.least = float(np.clip(np.quantile(wrong, 0.999) if len(wrong) else 0.5, 0.5, 0.95))
        self.templates = {f: [tokens(t) for t in ts] for f, ts in TEMPLATES.items()}
        self._tables()

    def _tables(self) -> None:
        """The vocabulary as numbers: of words, and of pairs of them, in order of their numbers."""
        spelled = sorted({w for g in self.vocabulary for w in g.split(" ")})
        self.numbers = {w: i for i, w in enumerate(spelled)}
        n = len(spelled)
        self.single = np.full(n + 1, -1)
        pairs = []
        for g, i in self.vocabulary.items():
            if " " in g:
                x, y = g.split(" ")
                pairs.append((self.numbers[x] * n + self.numbers[y], i))
            else:
                self.single[self.numbers[g]] = i
        self.pairs, self.paired = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.empty(0, np.int64),) * 2

    def chances(self, words: Words, groups: tuple[np.ndarray, ...] = ()) -> list[np.ndarray]:
        """Of each text of words, all at once, the probability of each family, as predict() has it; then the same of each of
        groups: for each text the number of the group that it is in, next to the group's others."""
        known = kept("licences").setdefault(id(self), {})
        coded = []
        for w in words.distinct.to_pylist():
            c = known.get(w)
            if c is None:
                if len(known) > 200_000:
                    known.clear()
                c = known[w] = [self.numbers.get(t, -1) for t in tokens(w)]
            coded.append(c)
        size = np.array([len(c) for c in coded], np.int64)
        stock, begin = np.array([x for c in coded for x in c], np.int64), np.cumsum(size) - size
        many = size[words.codes]
        ends = np.cumsum(many)
        stream = stock[np.repeat(begin[words.codes] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)] if len(stock) else np.empty(0, np.int64)
        owner = np.repeat(words.owner(), many)
        return [self._chances(stream, owner, len(words.at) - 1), *(self._chances(stream, g[owner], int(g.max(initial=-1)) + 1) for g in groups)]

    def _chances(self, stream: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        n, features = len(self.numbers), len(self.vocabulary) + 1
        one = self.single[stream]
        both = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0) & (owner[:-1] == owner[1:]))
        two = np.full(len(both), -1)
        if len(self.pairs):
            code = stream[both] * n + stream[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            two = np.where(self.pairs[at] == code, self.paired[at], -1)
        held = np.unique(np.concatenate([(owner * features + one)[(one >= 0) & (stream >= 0)], (owner[both] * features + two)[two >= 0]]))
        text, feature = held // features, held % features
        count = np.bincount(text, minlength=texts)
        at = np.searchsorted(text, np.arange(len(count) + 1))
        total = np.zeros((len(count), len(FAMILIES)))
        for k in range(len(FAMILIES)):  # a column at a time bounds memory
            total[:, k] = segment_sums(self.weights[feature, k], at)
        out = _softmax((total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.temperature)
        out[count == 0] = np.eye(len(FAMILIES))[0]
        return out

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_words(tokens(text))

    def predict_words(self, words: list[str]) -> tuple[str, float]:
        at = [i for g in grams(words) if (i := self.vocabulary.get(g)) is not None]
        if not at:
            return "unknown", 1.0
        p = _softmax(((self.weights[at].sum(axis=0) / np.sqrt(len(at)) + self.bias) / self.temperature)[None])[0]
        k = int(p.argmax())
        return (FAMILIES[k], float(p[k])) if k and p[k] >= self.least else ("unknown", float(p[0]))

    def match(self, family: str, text: str) -> float:
        """The largest share of a template's words that the text has in order."""
        return self.match_words(family, tokens(text))[0]

    def match_words(self, family: str, words: list[str]) -> tuple[float, int]:
        """The largest share of a template's words that the words have in order, and how many that are."""
        best = (0.0, 0)
        for t in self.templates[family]:
            have = set(t)
            own = [w for w in words if w in have]
            line = [0] * (len(t) + 1)  # longest common subsequence
            for w in own:
                last = 0
                for j, x in enumerate(t, 1):
                    kept = line[j]
                    line[j] = last + 1 if w == x else max(line[j], line[j - 1])
                    last = kept
            best = max(best, (line[-1] / len(t), line[-1]))
        return best


    def runs(self, words: list[str], line: list[int]) -> list[tuple[int, float, int, int, str, float]]:
        """(words matched, share, first, last, family, probability) of the statements over several lines that do not overlap, best first."""
        have: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            have.setdefault(w, []).append(p)
        found = []
        for family, templates in self.templates.items():
            for t in templates:
                n, least = len(t), int(np.ceil(MATCH * len(t) - 1e-9))
                count: dict[str, int] = {}
                for w in t:
                    count[w] = count.get(w, 0) + 1
                if sum(min(c, len(have.get(w, ()))) for w, c in count.items()) < least:
                    continue
                at = {w: np.array([x == w for x in t])[:, None] for w in count}
                # start[j, l]: the latest first word from which l words of the template's first j are there, in order.
                start = np.full((n + 1, n + 1), -1)
                for p in sorted(p for w in count for p in have.get(w, ())):
                    start[:, 0] = p
                    more = np.where(at[words[p]], start[:-1, :-1], -1)
                    np.maximum(start[1:, 1:], more, out=start[1:, 1:])
                    np.maximum.accumulate(start, axis=0, out=start)
                    for m in range(n, least - 1, -1):
                        first = int(start[n, m])
                        if first >= 0 and p - first < 2 * n and line[first] < line[p]:
                            found.append((m, m / n, first, p, family))
                            break
        out: list[tuple[int, float, int, int, str, float]] = []
        seen: dict[tuple[int, int], tuple[str, float]] = {}
        for m, share, first, last, family in sorted(found, key=lambda f: (-f[0], -f[1], f[3] - f[2], f[2:])):
            if any(first <= o[3] and last >= o[2] for o in out):
                continue
            if (first, last) not in seen:
                seen[first, last] = self.predict_words(words[first : last + 1])
            if seen[first, last][0] == family:
                out.append((m, share, first, last, family, seen[first, last][1]))
        return out


def classify(model: Classifier, texts: pa.Array) -> Iterator[tuple[int, int, str, float, float, str]]:
    """(row, number of the paragraph, family, probability, template share, paragraph) of each confirmed licence statement."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat, at = lines.flatten(), lines.offsets.to_numpy() - lines.offsets[0].as_py()
    # Lines alone, and with their neighbours: TOGETHER lines of a text at a time, and the same half of that further on.
    inside = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    groups = []
    for shift in (0, TOGETHER // 2):
        k = (inside + shift) // TOGETHER
        groups.append(np.cumsum((inside == 0) | np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]) - 1)
    chance, *joint = model.chances(Words(flat), tuple(groups))
    hint = 1 - chance[:, 0] >= HINT
    for g, p in zip(groups, joint, strict=True):
        hint |= (1 - p[:, 0] >= HINT)[g]
    marked = np.flatnonzero(hint)
    if not len(marked):
        return
    best = chance[marked].argmax(axis=1)
    sure = set(marked[(best > 0) & (chance[marked, best] >= model.least)].tolist())
    rows = np.searchsorted(at, marked, "right") - 1
    read: dict[int, list[str]] = {}

    def words_at(p: int) -> list[str]:
        if p not in read:
            read[p] = tokens(_MARK.sub("", flat[p].as_py()))
        return read[p]

    reach = 2 * max(len(t) for ts in model.templates.values() for t in ts)
    for row in np.unique(rows).tolist():
        own = [p for p in marked[rows == row].tolist() if words_at(p)]  # lines without words part runs
        single: dict[int, tuple[str, float, float, int]] = {}
        for p in own:
            if p not in sure:
                continue
            text = flat[p].as_py()
            family, probability = model.predict(text)
            if family != "unknown" and (share := model.match(family, text)) >= MATCH:
                single[p] = (family, probability, share, model.match_words(family, tokens(text))[1])
        out = [(p, family, probability, share, p) for p, (family, probability, share, _) in single.items()]
        near: list[list[int]] = []  # stretches of lines in which a run may hold a marked line
        for p in own:
            first = last = p
            room = reach
            while first > at[row] and room > 0 and words_at(first - 1):
                first -= 1
                room -= len(words_at(first))
            room = reach
            while last + 1 < at[row + 1] and room > 0 and words_at(last + 1):
                last += 1
                room -= len(words_at(last))
            if near and first <= near[-1][1]:
                near[-1][1] = max(near[-1][1], last)
            else:
                near.append([first, last])
        telling = set(own)
        for first, last in near:
            if first == last:
                continue
            spread = [(p, w) for p in range(first, last + 1) for w in (words_at(p) if p == last else _joined(flat[p].as_py(), words_at(p), words_at(p + 1)))]
            line, all_ = [p for p, _ in spread], [w for _, w in spread]
            for m, share, a, b, family, probability in model.runs(all_, line):
                over = range(line[a], line[b] + 1)
                if not telling.intersection(over):
                    continue
                # What lines of it state alone stays if the rest of the line still states it, or if it is no less of a template.
                rest = {p: [w for k, w in enumerate(all_) if line[k] == p and not a <= k <= b] for p in over if p in single}
                gone = [p for p, ws in rest.items() if model.match_words(single[p][0], ws)[0] < MATCH]
                if any(single[p][3] >= m for p in gone):
                    continue
                out = [o for o in out if not (o[0] == o[4] and o[0] in gone)]
                out.append((line[a], family, probability, share, line[b]))
        for p, family, probability, share, last in sorted(out):
            yield row, int(p - at[row]), family, probability, share, "\n".join(flat[k].as_py() for k in range(p, last + 1))


def _joined(text: str, words: list[str], after: list[str]) -> list[str]:
    """A line's words; one that a hyphen at its end splits is there whole, too, with and without the hyphen."""
    if not re.search(r"[^\W_]-\s*$", text):
        return words
    part = _WORD.findall(text.lower())[-1]
    at = len(words) - len(tokens(part))
    return [*words[:at], f"{part}-{after[0]}", part + after[0], *words[at:]]


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Classifier:
    """Fitted on the templates and the first line, FIRST characters of it at most, of at most negatives documents, those of the least hashes of doc_id and text."""
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(3))
    first = F.substring(F.substring_index(F.col("text").cast("string"), "\n", 1), 1, FIRST)
    rows = docs.select(h.alias("h"), first.alias("t")).where("trim(t) != ''").orderBy("h", "t").limit(negatives).toArrow()
    stated = [set(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    return Classifier([t for t in rows.column("t").to_pylist() if not any(len(own & s) > 0.5 * len(s) for own in [set(tokens(t))] for s in stated)])


def find_licenses(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, paragraph (from 0), family, probability, template_share, statement."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("licences")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = list(classify(model, part.column(1)))
                take = pa.array([f[0] for f in found], pa.int64())
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds, 1))], ["doc_id", "paragraph", "family", "probability", "template_share", "statement"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, paragraph long, family string, probability double, template_share double, statement string")

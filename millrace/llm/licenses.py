"""Licence scan: a trained paragraph classifier confirmed by template comparison.

Every line of a document is a paragraph. Its features are the word 1- to 3-grams that occur in the
notices (any other n-gram has weight zero), and a multinomial logistic regression over them
gives the probability of each licence family, of `unknown` (a licence of another family) and of `none`. It is trained in
numpy on altered copies of the families' templates, of notices of other licences as `unknown`, and on SAMPLE_LINES paragraphs, chosen
by a hash, of a bounded sample of documents (SAMPLE_ROWS of at most SAMPLE_CHARS characters) as `none`. Every HELD-th
of the other notices is kept from the training: on its copies, and on copies of templates that were kept back, the
temperature and the threshold are calibrated, so that a licence that the model has never seen is
not taken for one that it knows (one that is a single unknown word away from a known notice still may be). A paragraph that is likelier a licence than not counts as its family only if the family's
probability reaches the threshold and is over that of `unknown`, and a template's word pairs are contained in it to CONFIRM
or more; otherwise it is `unknown`.

Notices are often wrapped. So within a block of consecutive lines that have words, every run of words that
goes over a line's end, holds CONFIRM of a template's word pairs and is at most STRETCH times as long as the
template is classified and confirmed like a paragraph, however the block is wrapped and however long it is.
The lines of a confirmed run are licence paragraphs of its family.

Defined cases: null and empty texts have no paragraphs and the family `none`; a null id is returned as such and
teaches nothing; an empty table gives no rows; texts of any length are read whole; repeated rows get equal results, and a
repeated id teaches by one of its rows; of families that tie the first by name's order in TEMPLATES counts; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Shipped, lean, sample_ids, table, texts_of

#: Common short notices of each family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain.",
    ],
}

#: Notices of licences that are no family here. They teach what a licence looks like that is not known.
OTHERS = [
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: LGPL-2.1-or-later",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "SPDX-License-Identifier: ISC",
    "This software is provided 'as-is', without any express or implied warranty.",
    "SPDX-License-Identifier: Zlib",
    "This is free and unencumbered software released into the public domain.",
    "SPDX-License-Identifier: Unlicense",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "SPDX-License-Identifier: CDDL-1.0",
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "SPDX-License-Identifier: EUPL-1.2",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-ND 4.0.",
    "You may use this file only under the terms of the commercial licence agreement with the vendor.",
    "Use of this software is subject to the licence terms of its owner; redistribution is not permitted.",
]

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LINES = 400, 5000, 2000
COPIES, EPOCHS, RATE, DECAY = 60, 60, 0.5, 1e-3
#: Every HELD-th copy and every HELD-th other notice is for calibration.
CONFIRM, STRETCH, HELD = 0.8, 2, 5
NONE, UNKNOWN = "none", "unknown"

_WORDS = re.compile(r"[^\W_]+(?:\.\d+)*").findall


def words_of(paragraph: str) -> list[str]:
    return _WORDS(paragraph.lower())


class LicenceModel:
    """Words of the templates are numbered from 1, others are 0; an n-gram is a number in base V."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        templates = templates or TEMPLATES
        self.families = [*templates, UNKNOWN, NONE]
        texts = [(f, words_of(t)) for f, ts in templates.items() for t in ts]
        self.others = [words_of(t) for t in OTHERS]
        taught = [ws for i, ws in enumerate(self.others) if i % HELD]
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for ws in [*(t for _, t in texts), *taught] for w in ws}))}
        self.V = len(self.word) + 1
        grams = set()
        for ws in [*(t for _, t in texts), *taught]:
            ids = self.ids(ws)
            for n in (1, 2, 3):
                grams.update(self.coded(ids, n)[0].tolist())
        self.grams = np.array(sorted(grams), dtype=np.int64)
        self.weights = np.zeros((len(self.grams), len(self.families)))
        self.bias = np.zeros(len(self.families))
        self.threshold, self.temperature = 0.5, 1.0
        self.templates = texts
        self.pairs = [(self.families.index(f), set(zip(ws, ws[1:], strict=False))) for f, ws in texts]
        coded = [np.unique(self.coded(self.ids(ws), 2)[0]) for _, ws in texts]
        self.pair_codes = np.unique(np.concatenate(coded))
        self.has_pair = np.array([np.isin(self.pair_codes, c) for c in coded])

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.word.get
        return np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def coded(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of known words, and where they start."""
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, known = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
        for k in range(n):
            part = ids[k : len(ids) - n + 1 + k]
            code = code * self.V + part
            known &= part > 0
        at = np.flatnonzero(known)
        return code[at] + n * self.V**3, at

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the model's n-grams in ids, and where they start."""
        found = [self.coded(ids, n) for n in (1, 2, 3)]
        code, at = np.concatenate([c for c, _ in found]), np.concatenate([a for _, a in found])
        place = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = self.grams[place] == code
        return place[hit], at[hit]

    def fit(self, negatives: list[str], seed: int = 2) -> LicenceModel:
        rng = np.random.default_rng(seed)
        filler = [w for t in negatives for w in words_of(t)] or ["x"]
        unknown, none = len(self.families) - 2, len(self.families) - 1
        rows, y, held = [], [], []
        notices = [(self.families.index(f), ws, False) for f, ws in self.templates]
        notices += [(unknown, ws, i % HELD == 0) for i, ws in enumerate(self.others)]
        for family, ws, kept_back in notices:
            for c in range(COPIES):
                copy = [w for w in ws if c == 0 or rng.random() > 0.1] or ws
                if family == unknown and self.contained(copy)[1] == 1:
                    continue  # what made it another licence has been left out
                pad = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 8)) if c else 0)]
                rows.append(copy + pad if rng.random() < 0.5 else pad + copy)
                y.append(family)
                held.append(kept_back or (family != unknown and c % HELD == HELD - 1))
        for i, t in enumerate(negatives):
            ws = words_of(t)
            if self.contained(ws)[1] < 0.5:
                rows.append(ws)
                y.append(none)
                held.append(i % HELD == HELD - 1)
        y, held = np.array(y), np.array(held)
        X = [np.unique(self.features(self.ids(r))[0]) for r in rows]
        train, held = np.flatnonzero(~held), np.flatnonzero(held)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in rng.permutation(train).tolist():
                delta = self.probabilities(self.weights[X[i]].sum(axis=0) + self.bias)
                delta[y[i]] -= 1
                self.weights[X[i]] -= rate * (delta / max(1, len(X[i])) ** 0.5 + DECAY * self.weights[X[i]])
                self.bias -= 0.1 * rate * delta
        z = np.array([self.weights[X[i]].sum(axis=0) + self.bias for i in held])
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
        loss = [-np.log(self.probabilities(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = self.probabilities(z / self.temperature)
        best, sure = p[:, :unknown].argmax(axis=1), p[:, :unknown].max(axis=1)
        # what the template comparison or `unknown` settles is settled at any threshold
        open_to = np.array([self.confirmed(rows[i], f) >= CONFIRM for i, f in zip(held, best, strict=True)]) & (sure > p[:, unknown])
        known_held = open_to & (y[held] < unknown) & (best == y[held])
        sure = np.where(open_to, sure, 0)
        known = sure[known_held]
        strange = sure[y[held] == unknown]
        # the least sum of the share of known notices that are missed and of strange ones that are taken for known ones
        at = np.linspace(0.05, 0.95, 91)
        wrong = [(known < t).mean() + (strange >= t).mean() if len(known) and len(strange) else 0.0 for t in at]
        self.threshold = float(at[int(np.argmin(wrong))])
        # a template as it stands is always known
        own = [(f, *self.judged(self.ids(ws))) for f, ws in self.templates]
        self.threshold = min([self.threshold, *(p - 1e-9 for f, best, p, other, _ in own if self.families[best] == f and p > other)])
        return self

    @staticmethod
    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def contained(self, words: list[str]) -> tuple[int, float]:
        """The family whose template has most of its word pairs in the paragraph, and that share."""
        own = set(zip(words, words[1:], strict=False))
        return max(((f, len(p & own) / len(p)) for f, p in self.pairs if p), key=lambda x: x[1], default=(-1, 0.0))

    def confirmed(self, words: list[str], family: int) -> float:
        own = set(zip(words, words[1:], strict=False))
        return max((len(p & own) / len(p) for f, p in self.pairs if p and f == family), default=0.0)

    def runs(self, ids: np.ndarray, line: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
        """Words [from, to) of one block and several lines that hold CONFIRM of a template's word pairs.

        ids, line, block: of each word of a document.
        """
        code, at = self.coded(ids, 2)
        place = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        hit = (self.pair_codes[place] == code) & (block[at] == block[at + 1])
        place, at = place[hit], at[hit]
        here = self.has_pair[:, np.unique(place)].sum(axis=1)
        size = self.has_pair.sum(axis=1)
        out = set()
        for t in np.flatnonzero((size > 0) & (here >= CONFIRM * size)).tolist():
            mine = self.has_pair[t][place]
            pair, pos = place[mine].tolist(), at[mine].tolist()
            where, longest = block[at[mine]].tolist(), STRETCH * len(self.templates[t][1])
            held: dict[int, int] = {}
            left = right = 0
            while right < len(pair):
                held[pair[right]] = held.get(pair[right], 0) + 1
                while where[left] != where[right] or pos[right] + 2 - pos[left] > longest or held[pair[left]] > 1:
                    held[pair[left]] -= 1
                    if not held[pair[left]]:
                        del held[pair[left]]
                    left += 1
                right += 1
                if len(held) < CONFIRM * size[t]:
                    continue
                while right < len(pair) and where[right] == where[left] and pos[right] + 2 - pos[left] <= longest and pair[right] not in held:
                    held[pair[right]] = 1
                    right += 1
                if line[pos[left]] != line[pos[right - 1] + 1]:
                    out.add((pos[left], pos[right - 1] + 2))
                held, left = {}, right
        return sorted(out)

    def scan(self, text: str | None) -> tuple[str, float, int, int, str]:
        """Best family, its probability, paragraphs, licence paragraphs, all families found."""
        split = [words_of(line) for line in (text or "").split("\n")]
        lines = [ws for ws in split if ws]
        best, families, found = (NONE, 0.0), set(), set()
        if not lines:
            return NONE, 0.0, 0, 0, ""
        flat: list[str] = []
        for ws in lines:
            flat += ws
            flat.append("")  # ends a paragraph; no word of any template
        ends = np.cumsum([len(ws) + 1 for ws in lines])
        ids = self.ids(flat)
        feature, at = self.features(ids)
        of = np.searchsorted(ends, at, side="right")
        key = np.unique(of * len(self.grams) + feature)
        of, feature = key // len(self.grams), key % len(self.grams)
        z = np.zeros((len(lines), len(self.families)))
        np.add.at(z, of, self.weights[feature])
        p = self.probabilities((z + self.bias) / self.temperature)
        wordless = np.array([not ws for ws in split])
        line = np.repeat(np.arange(len(lines)), [len(ws) for ws in lines])
        block = np.cumsum(wordless)[~wordless][line]
        plain = np.delete(ids, ends - 1)
        for start, end in self.runs(plain, line, block):
            family, prob, other, none = self.judged(plain[start:end])
            words = [w for ws in lines[line[start] : line[end - 1] + 1] for w in ws]
            words = words[start - int(np.searchsorted(line, line[start])) :][: end - start]
            if none < 0.5 and prob >= self.threshold and prob > other and self.confirmed(words, family) >= CONFIRM:
                families.add(self.families[family])
                found.update(range(line[start], line[end - 1] + 1))
                best = max(best, (self.families[family], prob), key=lambda x: x[1])
        for i in np.flatnonzero(p[:, -1] < 0.5).tolist():
            family = int(p[i, :-2].argmax())
            prob = float(p[i, family])
            sure = prob >= self.threshold and prob > p[i, -2] and self.confirmed(lines[i], family) >= CONFIRM
            prob = prob if sure else float(p[i, -2])
            if not sure and i in found:
                continue  # part of a notice
            found.add(i)
            name = self.families[family] if sure else UNKNOWN
            families.add(name)
            if (sure, prob) > (best[0] not in (NONE, UNKNOWN), best[1]):
                best = (name, prob)
        return best[0], best[1], len(lines), len(found), ",".join(sorted(families))

    def judged(self, ids: np.ndarray) -> tuple[int, float, float, float]:
        """The likeliest family of words, its probability, that of unknown and that of none."""
        z = self.weights[np.unique(self.features(ids)[0])].sum(axis=0)
        p = self.probabilities((z + self.bias) / self.temperature)
        return int(p[:-2].argmax()), float(p[:-2].max()), float(p[-2]), float(p[-1])


def fit(documents: DataFrame) -> LicenceModel:
    ids = sample_ids(documents.select("doc_id").where(F.col("doc_id").isNotNull()), SAMPLE_ROWS)
    rows = texts_of(documents, ids, SAMPLE_CHARS)
    lines = {(zlib.crc32(line.encode("utf-8", "replace")), line) for r in rows for line in r.text.split("\n") if line.strip()}
    return LicenceModel().fit([line for _, line in sorted(lines)[:SAMPLE_LINES]])


def scan_documents(documents: DataFrame, model: LicenceModel) -> DataFrame:
    """doc_id, license_family, license_score, n_paragraphs, n_license_paragraphs, families."""
    shared = Shipped(documents.sparkSession, model)  # bounded by the templates

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
        scan = shared.get().scan
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", "license_family", "license_score", "n_paragraphs", "n_license_paragraphs", "families"]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run),
        "doc_id long, license_family string, license_score double, n_paragraphs long, n_license_paragraphs long, families string",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scan_documents(documents, fit(documents))

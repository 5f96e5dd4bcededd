"""License scans: a trained paragraph classifier over word n-grams, confirmed by template comparison."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.textkit import LOWER, U64, mix, text_slices, word_bounds, word_hashes

#: Words of one paragraph that are judged together; longer paragraphs are judged in overlapping windows.
WINDOW, STRIDE = 120, 60
#: Words between places of template 3-grams that still belong to one notice, and 3-grams that confirm a part of a long template.
GAP, PART = 3, 6

#: Notices of licence families, as commonly published. Several templates of a family are alternatives.
TEMPLATES = {
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu affero general public license along with this program if not see https www.gnu.org licenses",
        "licensed under the gnu affero general public license version 3",
        "spdx-license-identifier agpl-3.0-or-later",
    ],
    "apache": [
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2.0",
        "spdx-license-identifier apache-2.0",
    ],
    "artistic": [
        "this package is free software you may use modify and redistribute it under the terms of the artistic license 2.0",
        "you may redistribute it and or modify it under the same terms as perl itself",
        "spdx-license-identifier artistic-2.0",
    ],
    "boost": [
        "distributed under the boost software license version 1.0 see accompanying file license_1_0.txt or copy at http www.boost.org license_1_0.txt",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        "spdx-license-identifier bsl-1.0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is licensed under the bsd 3-clause license",
        "licensed under the bsd 2-clause license",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "spdx-license-identifier bsd-3-clause",
        "spdx-license-identifier bsd-2-clause",
    ],
    "cc": [
        "this work is licensed under a creative commons attribution 4.0 international license to view a copy of this license visit http creativecommons.org licenses by 4.0",
        "licensed under cc by-nc 4.0",
        "licensed under cc by-sa 4.0 you are free to share and adapt under the terms of attribution and share alike",
        "this text is available under the creative commons attribution sharealike license",
        "spdx-license-identifier cc-by-4.0",
    ],
    "cc0": [
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
        "spdx-license-identifier cc0-1.0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution and is available at https www.eclipse.org legal epl-2.0",
        "licensed under the eclipse public license",
        "spdx-license-identifier epl-2.0",
    ],
    "eupl": [
        "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl",
        "licensed under the european union public licence",
        "spdx-license-identifier eupl-1.2",
    ],
    "gfdl": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.3 or any later version published by the free software foundation with no invariant sections no front-cover texts and no back-cover texts",
        "spdx-license-identifier gfdl-1.3-or-later",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see http www.gnu.org licenses",
        "this work is licensed under the gnu general public license version 3",
        "spdx-license-identifier gpl-3.0-or-later",
        "spdx-license-identifier gpl-2.0-only",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "released under the isc license",
        "spdx-license-identifier isc",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "you should have received a copy of the gnu lesser general public license along with this library if not see http www.gnu.org licenses",
        "licensed under the gnu lesser general public license version 3",
        "spdx-license-identifier lgpl-3.0-or-later",
        "spdx-license-identifier lgpl-2.1-only",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "released under the mit license",
        "spdx-license-identifier mit",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v. 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
    ],
    "odbl": [
        "this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license",
        "spdx-license-identifier odbl-1.0",
    ],
    "ofl": [
        "this font software is licensed under the sil open font license version 1.1 this license is copied below and is also available with a faq at https openfontlicense.org",
        "spdx-license-identifier ofl-1.1",
    ],
    "reserved": [
        "copyright all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
        "all rights reserved",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
        "spdx-license-identifier unlicense",
    ],
    "zlib": [
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "spdx-license-identifier zlib",
    ],
}
FAMILIES = (*sorted(TEMPLATES), "unknown")


def word_grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, first word of each line, start places) of whole texts.

    Words are lower-cased runs of letters, digits, and . - between them, so punctuation and case do not matter.
    """
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    inner = keep.copy()
    inner[[45, 46]] = True
    for at, end, data, offsets in text_slices(column):
        low = LOWER[data]
        near = np.zeros(len(low) + 2, bool)
        near[1:-1] = keep[low]
        # . and - count only between two kept characters.
        good = near[1:-1] | (inner[low] & near[:-2] & near[2:])
        edges = np.concatenate([offsets[:-1], offsets[1:] - 1])
        edges = edges[(edges >= 0) & (edges < len(low))]
        good[edges] = near[edges + 1]
        words = np.where(good, low, np.uint8(32))
        starts, ends, rows = word_bounds(words, offsets)
        hashes = word_hashes(words, starts, ends)
        lines = np.cumsum(low == 10)
        bounds = np.searchsorted(rows, np.arange(end - at + 1))
        for r in range(end - at):
            s = slice(bounds[r], bounds[r + 1])
            yield at + r, hashes[s], lines[starts[s]] if len(low) else starts[s], starts[s] - offsets[r]


def _grams(words: np.ndarray) -> np.ndarray:
    """Distinct word 1- and 2-grams."""
    pairs = mix(words[:-1] * U64(3) + words[1:]) if len(words) > 1 else words[:0]
    return np.unique(np.concatenate([words, pairs]))


def features(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the vocabulary's n-grams in the words, and at the last place the share of all others.

    Values are roots of shares, so every paragraph has length 1.
    """
    own = _grams(words)
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    known = at[vocabulary[at] == own]
    n = max(len(own), 1)
    values = np.full(len(known) + 1, 1 / np.sqrt(n))
    values[-1] = np.sqrt((len(own) - len(known)) / n)
    return np.append(known, len(vocabulary)), values


def paragraphs(words: np.ndarray, lines: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of a text's lines as word ranges; lines over WINDOW words as overlapping windows."""
    if not len(words):
        return []
    cuts = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1], True])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = a
        while b - at > WINDOW:
            out.append((at, at + WINDOW))
            at += STRIDE
        out.append((at, b))
    return out


@dataclass(frozen=True)
class LicenseModel:
    """Multinomial logistic regression over sparse features; a prediction under its threshold is unknown."""

    vocabulary: np.ndarray  # sorted n-grams of the templates
    weights: np.ndarray  # features x families
    bias: np.ndarray
    threshold: float
    grams: tuple[np.ndarray, ...]  # sorted 3-gram hashes of each family's templates

    def probabilities(self, paragraphs: list[np.ndarray]) -> np.ndarray:
        score = np.stack([v @ self.weights[p] for p, v in (features(w, self.vocabulary) for w in paragraphs)]) + self.bias
        e = np.exp(score - score.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _template_words() -> list[tuple[int, np.ndarray]]:
    flat = [(k, t) for k, f in enumerate(FAMILIES[:-1]) for t in TEMPLATES[f]]
    return [(flat[r][0], w) for r, w, _, _ in word_grams(pa.array([t for _, t in flat]))]


def _three_grams(words: np.ndarray) -> np.ndarray:
    if len(words) < 3:
        return np.unique(words)
    return np.unique(mix(words[:-2] * U64(5) + words[1:-1] * U64(3) + words[2:]))


@cache
def _notice_grams() -> tuple[tuple[tuple[int, np.ndarray], ...], tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """(family, 3-grams) of every template, 3-grams of each family, of all, and first words of templates under three words."""
    flat = _template_words()
    long = [(k, _three_grams(w)) for k, w in flat if len(w) >= 3]
    families = tuple(np.unique(np.concatenate([g for k, g in long if k == f] or [np.zeros(0, U64)])) for f in range(len(FAMILIES) - 1))
    tags = np.unique(np.array([w[0] for _, w in flat if len(w) < 3], U64))
    return tuple((k, _three_grams(w)) for k, w in flat), families, np.unique(np.concatenate([g for _, g in long])), tags


def notices(words: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the word runs of a whole text that one family's template 3-grams cover, over line ends too.

    Up to GAP other words may lie within a run. The word after the first of a two-word template (a tag) belongs to its run.
    """
    _, families, every, tags = _notice_grams()
    out = {(int(k), min(int(k) + 2, len(words))) for k in np.flatnonzero(np.isin(words, tags))}
    grams = mix(words[:-2] * U64(5) + words[1:-1] * U64(3) + words[2:]) if len(words) > 2 else words[:0]
    places = np.minimum(np.searchsorted(every, grams), len(every) - 1)
    hits = np.flatnonzero(every[places] == grams)
    for known in families if len(hits) else ():
        own = hits[np.isin(grams[hits], known)]
        if len(own):
            cut = np.flatnonzero(np.diff(own) > 3 + GAP)
            out |= set(zip(own[np.r_[0, cut + 1]].tolist(), (own[np.r_[cut, len(own) - 1]] + 3).tolist(), strict=True))
    return sorted(out)


def _holds_template(grams: np.ndarray, family: int) -> bool:
    """Half of the 3-grams of one of the family's templates, or PART of them."""
    shared = [(int(np.isin(own, grams).sum()), len(own)) for k, own in _notice_grams()[0] if k == family]
    return any(2 * n >= of or n >= PART for n, of in shared)


def fit(others: list[np.ndarray], epochs: int = 30, rate: float = 0.5, false_rate: float = 1e-3) -> LicenseModel:
    """A model from the templates, varied, and from ``others``, word hashes of ordinary paragraphs, as class unknown.

    Template samples are random cuts with words dropped and replaced by ordinary ones. The threshold is calibrated on
    a held-out third of the ordinary paragraphs: at most ``false_rate`` of them pass it, and it is at least 0.6.
    """
    rng = np.random.default_rng(5)
    held, used = others[::3], [o for k, o in enumerate(others) if k % 3] or [np.zeros(0, U64)]
    pool = np.concatenate(used) if sum(map(len, used)) else np.arange(1, 50, dtype=U64)
    unknown = len(FAMILIES) - 1
    vocabulary = np.unique(np.concatenate([_grams(w) for _, w in _template_words()]))
    samples, y = [], []
    for family, words in _template_words():
        for _ in range(40):
            n = len(words)
            a = rng.integers(0, max(1, n // 3)) if rng.random() < 0.6 else 0
            part = words[a : a + rng.integers(max(1, (n - a) // 2), n - a + 1)].copy()
            part = part[rng.random(len(part)) > 0.05] if len(part) > 5 else part
            noise = rng.choice(pool, rng.integers(0, len(part) + 1))
            part = np.concatenate([noise[: len(noise) // 2], part, noise[len(noise) // 2 :]])
            samples.append(features(part, vocabulary))
            y.append(family)
    for o in used:
        samples.append(features(o, vocabulary))
        y.append(unknown)
    y = np.array(y)
    shape = (len(vocabulary) + 1, len(FAMILIES))
    w, g, bias = np.zeros(shape), np.full(shape, 1e-3), np.zeros(len(FAMILIES))
    balance = np.sqrt(len(y) / (len(FAMILIES) * np.maximum(np.bincount(y, minlength=len(FAMILIES)), 1)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 128):
            batch = order[lo : lo + 128]
            cols, vals = (np.concatenate([samples[k][j] for k in batch]) for j in (0, 1))
            rows = np.repeat(np.arange(len(batch)), [len(samples[k][0]) for k in batch])
            score = np.zeros((len(batch), len(FAMILIES)))
            np.add.at(score, rows, w[cols] * vals[:, None])
            score += bias
            e = np.exp(score - score.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= balance[y[batch]][:, None] / len(batch)
            grad = 1e-5 * w
            np.add.at(grad, cols, vals[:, None] * p[rows])
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
            bias -= 0.05 * p.sum(0)
    by_family = [[_three_grams(x) for k, x in _template_words() if k == f] for f in range(unknown)]
    grams = tuple(np.unique(np.concatenate(x)) for x in by_family)
    model = LicenseModel(vocabulary, w, bias, 0.0, grams)
    top = np.sort(model.probabilities(held)[:, :unknown].max(1)) if held else np.zeros(1)
    threshold = max(0.6, float(top[min(len(top) - 1, int(np.ceil((1 - false_rate) * len(top))))]))
    return LicenseModel(vocabulary, w, bias, min(threshold, 0.95), grams)


def train(docs: DataFrame, max_rows: int = 2_000, per_document: int = 4) -> LicenseModel:
    """A model whose ordinary paragraphs come from at most max_rows documents, in the order of a hash of doc_id.

    Paragraphs that share a 3-gram with a template are left out. Per document, at most per_document evenly spaced ones.
    """
    total = docs.count()
    known = np.unique(np.concatenate([_three_grams(w) for _, w in _template_words()]))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, words, lines, _ in word_grams(batch.column(0)):
                ranges = [r for r in paragraphs(words, lines) if not np.isin(_three_grams(words[r[0] : r[1]]), known).any()]
                out += [words[a:b].tobytes() for a, b in ranges[:: max(1, len(ranges) // per_document)][:per_document]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["words"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(total, 1))))
    rows = picked.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(sample, "words binary").collect()
    return fit([np.frombuffer(w, U64) for w in sorted(bytes(r[0]) for r in rows)])


def scan_licenses(docs: DataFrame, model: LicenseModel, least_overlap: int = 2) -> DataFrame:
    """docs plus licenses: array of struct(paragraph, start, family, probability, overlap, confirmed).

    Every line of a whole text is a paragraph, long ones in windows of 120 words. An entry is made where the best
    family's probability passes the model's threshold. It is confirmed if the paragraph shares at least least_overlap
    word 3-grams with the family's templates, or half of its own; overlap is their number. start is the byte place of its first word.
    Within paragraphs and across lines, the runs of notices() are judged by themselves, so that no surrounding text
    dilutes them; these are confirmed only if they also hold half of a template's 3-grams, or six. A confirmed paragraph
    stands for the runs of its family in it; unconfirmed entries that overlap a confirmed one are left out.
    Null and empty texts have none. Repeated rows have equal entries; of families as likely the first in the alphabet is
    taken. A very long text is judged whole, window by window. Other columns pass through; a column named licenses is
    replaced.
    """
    docs = docs.drop("licenses")
    kind = "array<struct<paragraph:int,start:long,family:string,probability:double,overlap:int,confirmed:boolean>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"licenses {kind}"])
    at, names = docs.columns.index("text"), [*docs.columns, "licenses"]
    sent = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.weights, model.bias, model.threshold, model.grams))
    arrow = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.int32()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LicenseModel(*sent.value)
        unknown = len(FAMILIES) - 1
        for batch in batches:
            found: list[list[dict]] = []
            for _, words, lines, starts in word_grams(batch.column(at)):
                own: list[tuple[int, int, dict]] = []
                ranges = paragraphs(words, lines)
                wide = len(ranges)
                firsts = np.array([a for a, _ in ranges])
                ranges += sorted(set(notices(words)) - set(ranges))
                if ranges:
                    p = known.probabilities([words[a:b] for a, b in ranges])
                    best = p[:, :unknown].argmax(1)
                    for k in np.flatnonzero((p[np.arange(len(p)), best] >= known.threshold) & (p.argmax(1) != unknown)):
                        (a, b), family = ranges[k], FAMILIES[best[k]]
                        grams = _three_grams(words[a:b])
                        overlap = int(np.isin(grams, known.grams[best[k]]).sum())
                        sure = overlap >= least_overlap or 2 * overlap >= len(grams)
                        paragraph = int(k)
                        if k >= wide:
                            sure = sure and _holds_template(grams, best[k])
                            paragraph = int(np.searchsorted(firsts, a, "right")) - 1
                            if any(x < b and a < y and e["confirmed"] and e["family"] == family for x, y, e in own):
                                continue
                        own.append((a, b, {"paragraph": paragraph, "start": int(starts[a]), "family": family, "probability": float(p[k, best[k]]), "overlap": overlap, "confirmed": sure}))
                    certain = [(a, b) for a, b, e in own if e["confirmed"]]
                    own = [x for x in own if x[2]["confirmed"] or not any(a < x[1] and x[0] < b for a, b in certain)]
                    own.sort(key=lambda x: x[:2])
                found.append([e for _, _, e in own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=names)

    return docs.mapInArrow(run, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, n_confirmed, families (distinct confirmed ones, joined by commas) of every document."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = scan_licenses(docs, train(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.size(sure).cast("long").alias("n_confirmed"), families.alias("families"), "licenses")

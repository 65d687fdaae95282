"""Licence scans: a trained paragraph classifier confirmed by template comparison.

Paragraphs are runs of lines that aren't blank. Each line is judged by itself, then the
whole paragraph; one of more than `window` words is judged in overlapping windows. Sparse
features (word one- and two-grams) go through a multinomial logistic regression fitted with
follow-the-regularised-leader on made examples: cut, garbled and embedded templates of each family,
and for the unknown class made-up sentences of ordinary and legal words and a bounded sample of the
corpus's own lines. A temperature, fitted on held-back examples, calibrates the probabilities, with
the unknown class among them. A prediction stands if the best template of its family shares enough
word pairs with the paragraph.

Scale: a map over whole texts. A paragraph is passed over where no template could confirm a window of it,
and only windows that a template confirms are classified.

Defined cases: null and empty texts have no findings; repeated rows report each; equal scores take the
first family in order; adjacent windows of a line report the family once, with the span of all;
empty tables give none.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import ensure_workers_import, kept_and_text, pick

#: Usual notices of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    "Apache-2.0": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "Artistic-2.0": (
        "licensed under the artistic license 2.0",
        "this package is distributed under the terms of the artistic license 2.0",
    ),
    "BSD": (
        "licensed under the bsd license",
        "released under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "BSL-1.0": (
        "distributed under the boost software license version 1.0",
        "licensed under the boost software license 1.0",
    ),
    "CC-BY": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "CC-BY-NC": (
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ),
    "CC-BY-SA": (
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ),
    "CC0": (
        "licensed under cc0 1.0",
        "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1.0 universal public domain dedication",
    ),
    "EPL": (
        "licensed under the eclipse public license 2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
        "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1.0",
    ),
    "EUPL": (
        "licensed under the eupl",
        "licensed under the european union public licence version 1.2",
        "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl",
    ),
    "GPL": (
        "licensed under the gnu gpl v3",
        "licensed under the gpl version 2",
        "this program is distributed under the terms of the gnu gpl",
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "ISC": (
        "licensed under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "LGPL": (
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    "MIT": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ),
    "MPL-2.0": (
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file",
    ),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "WTFPL": (
        "licensed under the wtfpl",
        "do what the fuck you want to public license version 2",
    ),
    "Zlib": (
        "licensed under the zlib license",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
}
#: Identifiers of these families in machine-readable tags.
SPDX: dict[str, str] = {
    "AGPL": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later", "Apache-2.0": "Apache-2.0", "Artistic-2.0": "Artistic-2.0", "BSD": "BSD-2-Clause BSD-3-Clause", "BSL-1.0": "BSL-1.0",
    "CC-BY": "CC-BY-4.0 CC-BY-3.0", "CC-BY-NC": "CC-BY-NC-4.0", "CC-BY-SA": "CC-BY-SA-4.0 CC-BY-SA-3.0", "CC0": "CC0-1.0", "EPL": "EPL-1.0 EPL-2.0", "EUPL": "EUPL-1.2", "GPL": "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later",
    "ISC": "ISC", "LGPL": "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "WTFPL": "WTFPL", "Zlib": "Zlib",
}
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += tuple(" ".join(_WORD.findall(f"spdx license identifier {i}".lower())) for i in _ids.split())
#: The word pairs of each template, the templates of each pair, and the family of each template.
FAMILY_OF = [f for f, ts in TEMPLATES.items() for _ in ts]
TEMPLATE_PAIRS = [set(zip(t.split(), t.split()[1:], strict=False)) for ts in TEMPLATES.values() for t in ts]
TEMPLATES_OF: dict[tuple[str, str], list[int]] = {}
for _t, _pairs in enumerate(TEMPLATE_PAIRS):
    for _pair in sorted(_pairs):
        TEMPLATES_OF.setdefault(_pair, []).append(_t)
#: What notices tend to hold; training looks for such lines as hard examples.
ANCHORS = ("licens", "licenc", "copyright", "warrant", "redistribut", "public domain", "hereby granted")
#: Words for made-up sentences of the unknown class.
ORDINARY = "the of and to in a is that it for was on as with be by at this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state people those too mr how little good world make very year still see own work men day get here between both life being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part school thought went say general once upon".split()
LEGAL = "license licensed licence terms conditions agreement rights reserved copyright granted permission software work distributed version public notice holder party driver fishing marriage plate fee software warranty general free use copy source".split()

def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def pairs_shared(words: list[str], template: list[str]) -> float:
    """Word pairs that both have, as a share of the shorter one's (a paragraph counts as 8 at least, so
    a few shared words of a long template prove nothing; of up to three pairs all are needed)."""
    have = set(zip(words, words[1:], strict=False))
    want = set(zip(template, template[1:], strict=False))
    if len(want) <= 3 and not want <= have:
        return 0.0
    return len(have & want) / max(1, min(len(want), max(8, len(have))))


@dataclass
class LicenseModel:
    families: list[str]  # the last is the unknown class
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    window: int

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [i for g in grams(words) if (i := self.vocabulary.get(g)) is not None]
        z = (self.weights[at].sum(0) / np.sqrt(max(1, len(at))) if at else 0) + self.bias + self._strange(words)
        z = z / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def _strange(self, words: list[str]) -> np.ndarray:
        known = sum(w in self.vocabulary for w in words)
        return self.weights[-1] * (1 - known / max(1, len(words)))

    def find(self, text: str | None, least: float, shared: float) -> list[tuple[int, str, float, float, int, int]]:
        """(line, family, score, similarity, start, end) of each finding; code points, end exclusive."""
        out, at, n, text = [], 0, 0, text or ""
        lines: list[tuple[int, int, str]] = []  # (number, place, line) of the paragraph's lines
        for n, line in enumerate([*text.split("\n"), ""]):
            if line.strip():
                lines.append((n, at, line))
            elif lines:
                out += self._paragraph(lines, text, least, shared)
                lines = []
            at += len(line) + 1
        return out

    def _paragraph(self, lines: list[tuple[int, int, str]], text: str, least: float, shared: float) -> list:
        """The findings of each line, then those of windows over the whole paragraph, cut to the pairs they
        share with their template: they widen a finding of their family that they overlap, or are new."""
        first, last = lines[0], lines[-1]
        whole = text[first[1] : last[1] + len(last[2])]
        if not _confirmable(_WORD.findall(whole.lower()), shared, 8):
            return []
        words = [(w, s + first[1], e + first[1]) for w, s, e in words_of(whole)]
        if len(lines) == 1:
            return self._windows(first[0], words, least, shared)
        starts, out = [s for _, s, _ in words], []
        for n, at, line in lines:
            out += self._windows(n, words[bisect_left(starts, at) : bisect_left(starts, at + len(line))], least, shared)
        for _, family, p, same, start, end in self._windows(first[0], words, least, shared, cut=True):
            for f in [f for f in out if f[1] == family and f[4] < end and start < f[5]]:
                out.remove(f)
                p, same, start, end = max(p, f[2]), max(same, f[3]), min(start, f[4]), max(end, f[5])
            out.append((max(n for n, at, _ in lines if at <= start), family, p, same, start, end))
        return sorted(out)

    def _windows(self, n: int, words: list[tuple[str, int, int]], least: float, shared: float, cut: bool = False) -> list:
        """Findings by family; with cut, one for each window, cut to the pairs that the template has. Only
        windows that some template confirms are classified."""
        plain = [w for w, _, _ in words]
        if not _confirmable(plain, shared, 8):
            return []
        found: dict[str, tuple] = {}
        each = []
        # whole lines first; long ones in windows of two widths, so a notice fills a fair share of one
        spans = {(0, len(words))} if len(words) <= self.window else set()
        for width in (self.window // 4, self.window):
            if len(words) > width:
                spans |= {(i, min(len(words), i + width)) for i in range(0, len(words) - width // 2, width // 2)}
        for lo, hi in sorted(spans):
            part = plain[lo:hi]
            families = _confirmable(part, shared)
            if not families:
                continue
            p = self.probabilities(part)
            best = int(p.argmax())
            if best == len(self.families) - 1 or p[best] < least or self.families[best] not in families:
                continue
            family = self.families[best]
            same, template = max((pairs_shared(part, t.split()), t) for t in TEMPLATES[family])
            if cut:
                want = set(zip(template.split(), template.split()[1:], strict=False))
                hits = [i for i in range(lo, hi - 1) if (words[i][0], words[i + 1][0]) in want]
                each.append((n, family, float(p[best]), same, words[hits[0]][1], words[hits[-1] + 1][2]))
                continue
            old = found.get(family)
            span = (words[lo][1], words[hi - 1][2])
            if old is None:
                found[family] = (n, family, float(p[best]), same, *span)
            else:
                found[family] = (n, family, max(old[2], float(p[best])), max(old[3], same), min(old[4], span[0]), max(old[5], span[1]))
        return each if cut else [found[f] for f in sorted(found)]


def _confirmable(words: list[str], shared: float, size: int | None = None) -> set[str]:
    """Families with a template that shares enough word pairs with the words; with size, that might do so
    with some window of them, of at least that many pairs."""
    pairs = set(zip(words, words[1:], strict=False))
    count: dict[int, int] = {}
    for pair in pairs & TEMPLATES_OF.keys():
        for t in TEMPLATES_OF[pair]:
            count[t] = count.get(t, 0) + 1
    size = max(8, len(pairs)) if size is None else size
    out = set()
    for t, c in count.items():
        n = len(TEMPLATE_PAIRS[t])
        if c + 1e-9 >= (n if n <= 3 else shared * min(n, size)):
            out.add(FAMILY_OF[t])
    return out


def _examples(rng: np.random.Generator, per_template: int) -> Iterator[tuple[str, list[str]]]:
    def noise(n: int) -> list[str]:
        return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) if rng.random() < 0.5 else str(rng.choice(ORDINARY)) for _ in range(n)]

    for family, templates in TEMPLATES.items():
        for t in templates:
            for _ in range(per_template):
                w = t.split()
                if len(w) > 12 and rng.random() < 0.5:  # a part of a long notice
                    n = int(rng.integers(8, len(w) + 1))
                    lo = int(rng.integers(0, len(w) - n + 1))
                    w = w[lo : lo + n]
                drop = rng.random() * 0.1
                w = [x for x in w if rng.random() >= drop]
                yield family, [*noise(int(rng.integers(0, 8))), *w, *noise(int(rng.integers(0, 8)))]
    count = per_template * sum(map(len, TEMPLATES.values()))
    for _ in range(count):
        share = rng.random() * 0.6
        yield "unknown", [str(rng.choice(LEGAL)) if rng.random() < share else noise(1)[0] for _ in range(int(rng.integers(3, 30)))]


def _corpus_lines(texts: DataFrame, most: int, window: int) -> list[list[str]]:
    """Words of up to `most` different lines, one of a text at a place that its hash gives, and of as many
    that hold an anchor; chosen by their hashes over all texts, without those near a template."""
    lines = F.split("text", "\n")
    hard = F.filter(lines, lambda x: F.lower(x).rlike("|".join(ANCHORS)))
    every = max(1, texts.count() // (4 * most))
    out = []
    for name, of in (("any", lines), ("hard", hard)):
        chosen = F.try_element_at(of, (F.pmod(F.xxhash64("text", F.lit(name)), F.greatest(F.size(of), F.lit(1)).cast("long")) + 1).cast("int"))
        line = texts.where("text IS NOT NULL").select(chosen.alias("line")).where((F.length("line") > 0) & (F.pmod(F.xxhash64("line"), F.lit(every)) == 0 if name == "any" else F.col("line").isNotNull()))
        for r in line.select(F.substring("line", 1, 4000).alias("line")).distinct().orderBy(F.xxhash64("line"), "line").limit(most).collect():
            words = [w for w, _, _ in words_of(r["line"])][:window]
            if max(pairs_shared(words, t.split()) for ts in TEMPLATES.values() for t in ts) < 0.3:
                out.append(words)
    return out


def train(docs: DataFrame | None = None, per_template: int = 30, corpus_lines: int = 2000, window: int = 48, seed: int = 5, alpha: float = 0.3, l1: float = 0.02, l2: float = 1e-3, epochs: int = 4, text_col: str = "text") -> LicenseModel:
    """Fit on made examples and at most 2 * corpus_lines lines of docs that aren't like any template."""
    rng = np.random.default_rng(seed)
    data = list(_examples(rng, per_template))
    if docs is not None:
        data += [("unknown", w) for w in _corpus_lines(pick(docs, text_col).select(F.col(text_col).cast("string").alias("text")), corpus_lines, window)]
    families = [*sorted(TEMPLATES), "unknown"]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(grams(t.split()) for ts in TEMPLATES.values() for t in ts), LEGAL)))}
    k, n = len(families), len(vocabulary)
    z, nn = np.zeros((n + 2, k)), np.zeros((n + 2, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((1 + np.sqrt(nn[at])) / alpha + l2)
        w[np.abs(zz) <= l1] = 0
        return w

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = [i for g in sorted(grams(words)) if (i := vocabulary.get(g)) is not None]
        odd = 1 - sum(w in vocabulary for w in words) / max(1, len(words))
        return np.array([*at, n, n + 1]), np.array([*[1 / np.sqrt(max(1, len(at)))] * len(at), odd, 1.0])

    order = rng.permutation(len(data))
    coded = [(families.index(data[i][0]), *encode(data[i][1])) for i in order]
    held, fit = coded[: len(coded) // 5], coded[len(coded) // 5 :]
    for _ in range(epochs):
        for y, at, x in fit:
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(nn[at] + g * g) - np.sqrt(nn[at])) / alpha * w
            nn[at] += g * g
    w = weights(np.arange(n + 2))
    scores, truth = np.array([x @ w[at] for _, at, x in held]), np.array([y for y, _, _ in held])

    def loss(t: float) -> float:
        s = scores / t - (scores / t).max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    return LicenseModel(families, vocabulary, w[: n + 1], w[n + 1], float(min(np.geomspace(0.2, 5, 60), key=loss)), window)


def scan(docs: DataFrame, model: LicenseModel, least: float = 0.5, shared: float = 0.6, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each finding: columns of `keep` (default: the id), line, family, score, similarity, start, end."""
    keep = [id_col] if keep is None else keep
    ensure_workers_import(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = kept_and_text(docs, keep, text_col)
    schema = rows.drop("__text").schema.add("line", "long").add("family", "string").add("score", "double").add("similarity", "double").add("start", "long").add("end", "long")
    types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for f in m.find(text.as_py(), least, shared):
                    row.append(i)
                    found.append(f)
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([f[k] for f in found], t) for k, t in enumerate(types)]], names=[*batch.schema.names[:-1], "line", "family", "score", "similarity", "start", "end"])

    return rows.mapInArrow(run, schema)

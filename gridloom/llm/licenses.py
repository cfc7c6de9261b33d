"""License scans: a trained classifier of paragraphs, checked against the families' templates.

A paragraph (a line of a text) is the set of its word n-grams. A softmax regression with an L1 penalty, trained on
the driver on paragraphs made from the templates below, leaves some hundreds of n-grams with weights; it runs on the
tables as SQL expressions. Among the negatives are the templates with their license's name changed, so that a license
the model doesn't know is unknown however its notice is worded. Probabilities are calibrated by a temperature fitted
on templates that the scored model wasn't trained on, and a paragraph whose best family stays below MIN_PROBABILITY
is unknown. A family is confirmed where enough of the paragraph's word pairs stand in one template of it.

Most lines can't be known, which a word list tells: without any word of it, all other weights together don't reach
the least known score (see `_anchors`). So lines without such words need no scores.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

MIN_PROBABILITY, MIN_TEMPLATE_SHARE, MAX_NGRAM = 0.6, 0.6, 3
#: What the families' notices commonly say; the license's name is in brackets.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the [MIT] License.",
        "Licensed under the [MIT] license.",
        "This project is licensed under the terms of the [MIT] license.",
        "Distributed under the [MIT] License, see the file LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "SPDX-License-Identifier: [MIT]",
    ),
    "apache": (
        "Licensed under the [Apache] License, Version 2.0.",
        "Licensed under the [Apache] License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the [Apache] 2.0 license.",
        "You may obtain a copy of the License at http://www.[apache].org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: [Apache]-2.0",
    ),
    "gpl": (
        "This work is licensed under the [GNU General] Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General] Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the [GNU General] Public License, version 2 or later.",
        "You should have received a copy of the [GNU General] Public License along with this program.",
        "Released under the [GPL], version 3.",
        "SPDX-License-Identifier: [GPL]-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the [GNU Lesser General] Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General] Public License.",
        "Released under the [LGPL], version 2.1.",
        "SPDX-License-Identifier: [LGPL]-2.1-or-later",
    ),
    "bsd": (
        "Licensed under the [BSD] 3-Clause License.",
        "Released under the [BSD] license.",
        "Use of this source code is governed by a [BSD] style license that can be found in the file LICENSE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: [BSD]-3-Clause",
    ),
    "mpl": (
        "Licensed under the [Mozilla] Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the [Mozilla] Public License, v. 2.0.",
        "Released under the [MPL], version 2.0.",
        "SPDX-License-Identifier: [MPL]-2.0",
    ),
    "cc_by": (
        "Licensed under [CC BY] 4.0.",
        "Text and figures are available under [CC BY] 4.0 unless stated otherwise.",
        "This work is licensed under a [Creative Commons Attribution] 4.0 International License.",
        "Published under the [Creative Commons Attribution] license.",
        "SPDX-License-Identifier: [CC-BY]-4.0",
    ),
    "cc_by_sa": (
        "Licensed under [CC BY-SA] 4.0.",
        "Text and figures are available under [CC BY-SA] 4.0 unless stated otherwise.",
        "This work is licensed under a [Creative Commons Attribution-ShareAlike] 4.0 International License.",
        "Published under the [Creative Commons Attribution-ShareAlike] license.",
        "SPDX-License-Identifier: [CC-BY-SA]-4.0",
    ),
    "cc_by_nc": (
        "Licensed under [CC BY-NC] 4.0.",
        "Text and figures are available under [CC BY-NC] 4.0 unless stated otherwise.",
        "This work is licensed under a [Creative Commons Attribution-NonCommercial] 4.0 International License.",
        "Published under the [Creative Commons Attribution-NonCommercial] license.",
        "SPDX-License-Identifier: [CC-BY-NC]-4.0",
    ),
    "cc0": (
        "Released under [CC0] 1.0 Universal, no rights reserved.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain.",
        "SPDX-License-Identifier: [CC0]-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) by the owner. All rights reserved.",
        "Copyright the publisher, all rights reserved worldwide.",
        "All rights reserved, including the right of reproduction in whole or in part.",
        "All rights reserved by the author of this work.",
        "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: What is no license, though it shares words with one.
NEGATIVES: tuple[str, ...] = (
    "The work of the general public was released in version two of the report.",
    "He lost his driving license and had to use public transport.",
    "A copy of the terms is on file with the foundation under the law.",
    "This program is for any person without restriction on the use of the library.",
    "The software was modified and the source published in binary form.",
    "You may use this to obtain a copy of the program at any time.",
    "The table was reserved for all the guests of the house.",
    "The rights of all people were heard before the court.",
    "Permission to enter was granted free of charge to any person with a copy of the letter.",
    "The Apache helicopter and the MIT laboratory were in the news.",
    "The creative team and the commons room were open to the public.",
    "Version 3 of the work is under review by the general manager.",
    "The following conditions are met with or without modification of the plan.",
    "She is licensed to practise under the laws of the state.",
    "It is subject to the terms of the public contract, version 2.0.",
    "To the extent possible the domain is dedicated to this work.",
    "The license of the shop was granted by the public office for this year.",
    "See the file for a copy of the license.",
    "Permission to use this work for any purpose is granted by the owner.",
    "The author of this publication may be reached by letter.",
    "Er kam mit dem Zug und ging mit ihr nach Hause.",
    "Mit der Zeit kam sie mit allen gut aus.",
    "Elle a vu sa maison et sa ville par la route.",
)
#: Words that tell nothing by themselves; an n-gram of nothing else, or of numbers, is no feature.
COMMON = frozenset("a all an and any are as at be by c can for form had has have he his in is it may no not of on or out that the they this to v via was were with you".split())
_SPLIT = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _ngrams(words: list[str], most: int = MAX_NGRAM) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def _plain(template: str) -> str:
    return template.replace("[", "").replace("]", "")


def _pairs(template: str) -> list[str]:
    return sorted(g for g in _ngrams(_words(_plain(template)), 2) if " " in g)


@dataclass
class Classifier:
    """The last class is unknown."""

    families: list[str]
    weights: dict[str, list[float]] = field(default_factory=dict)
    bias: list[float] = field(default_factory=list)
    temperature: float = 1.0
    anchors: list[str] = field(default_factory=list)

    def scores(self, grams: set[str]) -> list[float]:
        out = list(self.bias)
        for g in sorted(grams):
            if w := self.weights.get(g):
                for k, x in enumerate(w):
                    out[k] += x
        return out

    def probabilities(self, grams: set[str]) -> list[float]:
        s = [x / self.temperature for x in self.scores(grams)]
        top = max(s)
        e = [math.exp(x - top) for x in s]
        return [x / sum(e) for x in e]

    def known(self, text: str, least: float = MIN_PROBABILITY) -> str | None:
        """The family of a paragraph; None if unknown."""
        p = self.probabilities(_ngrams(_words(text)))
        k = max(range(len(p)), key=p.__getitem__)
        return self.families[k] if k < len(p) - 1 and p[k] >= least else None


def _strange(rng: random.Random) -> str:
    """A made-up word, of no language and of no corpus."""
    return "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiouy") for _ in range(rng.randint(1, 4))) + rng.choice("qxzvkw")


def _versions(template: str, rng: random.Random) -> tuple[list[list[str]], list[list[str]]]:
    """(paragraphs of the family, paragraphs of another license) made from a template by a fixed rule."""
    before, name, after = (*[_words(x) for x in re.split(r"[\[\]]", template)], [], [])[:3]
    w = before + name + after
    more = lambda: [_strange(rng) for _ in range(rng.randint(1, 6))]
    same = [w, w, w, more() + w, w + more(), more() + w + more()]
    if not name and len(last := _words(re.split(r"\. ", template)[-1])) < len(w):
        same += [last, last, more() + last, last + more()]
    lose = [i for i in range(len(w)) if not len(before) <= i < len(before) + len(name)] if name else list(range(len(w)))
    if len(w) > 3:
        same += [w[:i] + w[i + 1 :] for i in rng.sample(lose, min(3, len(lose)))]
    if not name and len(w) > 6:
        same += [w[: len(w) * 3 // 4], w[len(w) // 4 :]]
    other = []
    for i in range(len(name)):
        other += [before + name[:i] + [_strange(rng)] + name[i + 1 :] + after for _ in range(2)]
        if len(name) > 1:
            other += [before + name[: i + 1] + [_strange(rng)] + name[i + 1 :] + after for _ in range(2)]
    if name:
        other += [before + [_strange(rng) for _ in name] + after for _ in range(2)]
    return same, other


def _made(seed: int, templates: dict[str, tuple[str, ...]]) -> list[tuple[set[str], int]]:
    rng = random.Random(seed)
    unknown = len(templates)
    out: list[tuple[set[str], int]] = []
    for label, texts in enumerate(templates.values()):
        for text in texts:
            same, other = _versions(text, rng)
            out += [(_ngrams(v), label) for v in same] + [(_ngrams(v), unknown) for v in other]
    for text in NEGATIVES:
        w = _words(text)
        out += [(_ngrams(v), unknown) for v in (w, w, w[: len(w) // 2], w[len(w) // 2 :], [_strange(rng), *w], w[:1] + [_strange(rng)] + w[1:])]
    short = sorted({w for ts in TEMPLATES.values() for t in ts for name in re.findall(r"\[(.*?)\]", t) for w in _words(name) if len(w) <= 3})
    for w in short:  # it may be a word of some language, as `mit` and `sa` are
        for k in range(8):
            around = [_strange(rng) for _ in range(rng.randint(1, 12))]
            out.append((_ngrams([*around[: k % 3], w, *around[k % 3 :], *([w] if k % 2 else [])]), unknown))
    return out + [(_ngrams([_strange(rng) for _ in range(rng.randint(1, 30))]), unknown) for _ in range(60)]


def _fitted(rows: list[tuple[set[str], int]], families: list[str], penalty: float, turns: int) -> Classifier:
    """Proximal gradient steps with momentum on the mean log loss and an L1 penalty; only n-grams of two paragraphs or more are features."""
    grams = sorted({g for s, _ in rows for g in s if not all(w in COMMON or w.isdigit() for w in g.split(" "))})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1))
    for r, (s, _) in enumerate(rows):
        x[r, [at[g] for g in s if g in at]] = 1.0
    x[:, -1] = 1.0
    x = x[:, np.append(x[:, :-1].sum(0) > 1, True)]
    kept = [g for g in grams if sum(g in s for s, _ in rows) > 1]
    y = np.zeros((len(rows), len(families)))
    y[np.arange(len(rows)), [k for _, k in rows]] = 1.0
    scale = 1.0 / (np.linalg.norm(x, 2) ** 2 / len(rows))
    w = z = np.zeros((x.shape[1], len(families)))
    step = 1.0
    for _ in range(turns):
        p = x @ z
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = z - scale * 2.0 * (x.T @ (p - y)) / len(rows)
        new[:-1] = np.sign(new[:-1]) * np.maximum(0.0, np.abs(new[:-1]) - scale * 2.0 * penalty)
        after = (1 + math.sqrt(1 + 4 * step * step)) / 2
        w, z, step = new, new + (step - 1) / after * (new - w), after
    c = Classifier(families)
    c.weights = {g: [round(float(v), 4) for v in w[i]] for i, g in enumerate(kept) if np.abs(w[i]).max() > 0.005}
    c.bias = [round(float(v), 4) for v in w[-1]]
    return c


def _fold(templates: dict[str, tuple[str, ...]], k: int, folds: int) -> tuple[dict, dict]:
    """Templates without those of a fold, and only those."""
    return {f: tuple(t for i, t in enumerate(ts) if i % folds != k) for f, ts in templates.items()}, {f: tuple(t for i, t in enumerate(ts) if i % folds == k) for f, ts in templates.items()}


@lru_cache(maxsize=4)
def trained(penalty: float = 1.5e-4, turns: int = 250, seed: int = 7, folds: int = 3, left_out: tuple[str, ...] = ()) -> Classifier:
    """The model of all templates but `left_out` (for tests). Always the same result.

    The temperature is the one under which models of the other folds' templates give the left-out templates'
    paragraphs the least log loss.
    """
    templates = {k: tuple(t for t in ts if t not in left_out) for k, ts in TEMPLATES.items()}
    families = [*TEMPLATES, "unknown"]
    c = _fitted(_made(seed, templates), families, penalty, turns)
    unseen = []
    for k in range(folds):
        rest, held = _fold(templates, k, folds)
        part = _fitted(_made(seed, rest), families, penalty, turns)
        unseen += [(part.scores(g), y) for g, y in _made(seed + 1, held) if g]

    def loss(t: float) -> float:
        out = 0.0
        for s, y in unseen:
            top = max(s)
            out += math.log(sum(math.exp((v - top) / t) for v in s)) - (s[y] - top) / t
        return out

    c.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    c.anchors = _anchors(c)
    return c


def _anchors(c: Classifier) -> list[str]:
    """Words one of which every known paragraph holds.

    A family known with probability p scores at least temperature * log(p / (1 - p)) more than unknown. Where a
    paragraph holds none of these words, it holds none of the n-grams with them either; and all other n-grams that
    speak for a family rather than for unknown, taken together, are less than that. Words are added by what they
    take from these sums.
    """
    need = c.temperature * math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    unknown = len(c.families) - 1
    left = {g: [max(0.0, x - w[unknown]) for x in w[:unknown]] for g, w in c.weights.items()}
    out: list[str] = []
    while True:
        over = [c.bias[k] - c.bias[unknown] + sum(v[k] for v in left.values()) - need for k in range(unknown)]
        if max(over) < 0 or not left:
            return sorted(out)
        takes: dict[str, float] = {}
        for g, v in left.items():
            much = sum(x for x, o in zip(v, over, strict=True) if o >= 0)
            for w in set(g.split(" ")):
                if w not in COMMON and not w.isdigit():
                    takes[w] = takes.get(w, 0.0) + much
        best = max(sorted(takes), key=takes.__getitem__)
        out.append(best)
        left = {g: v for g, v in left.items() if best not in g.split(" ")}


def _slots(grams: list[str]) -> tuple[int, list[int]]:
    """(n, slot of each gram): the first table size from 64 per gram on in which no two n-grams share a slot."""
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    hashes = [h - (1 << 64) if h >> 63 else h for h in hashes]
    n = 64 * max(1, len(grams))
    while len({h % n for h in hashes}) < len(hashes):
        n += 1
    return n, [h % n for h in hashes]


def _array(values: list, kind: str) -> Column:
    """An array literal; made from one string, as a call for each value would take long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _strings(values: list[str]) -> Column:
    return _array(values, "string")


def scored(lines: DataFrame, c: Classifier) -> DataFrame:
    """`lines` (with `words`, the words of a paragraph) with `pairs`, `family` and `probability`; the first of families of equal probability.

    An n-gram's weights are found by its hash in an array, where no two of the model share a place, and its text is
    compared: constant time for each n-gram.
    """
    names = list(c.weights)
    size, places = _slots(names)
    table = [-1] * size
    for i, p in enumerate(places):
        table[p] = i
    index = _array(table, "int")

    def grams(ws: Column, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)]))
        return F.when(F.size(ws) >= k, each).otherwise(F.array().cast("array<string>"))

    known = lambda g: let(F.get(index, F.pmod(F.xxhash64(g), F.lit(size)).cast("int")), lambda i: F.when((i >= 0) & (F.get(_strings(names), i) == g), i).otherwise(F.lit(-1)))
    hits = lambda ws: F.array_distinct(F.filter(F.transform(F.concat(*[grams(ws, k) for k in range(1, MAX_NGRAM + 1)]), known), lambda i: i >= 0))
    adding = lambda w: lambda acc, i: acc + F.get(w, i)
    sums = lambda h: F.array(*[F.aggregate(h, F.lit(float(c.bias[k])), adding(_array([w[k] for w in c.weights.values()], "double"))) / c.temperature for k in range(len(c.families))])

    def best(s: Column, top: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.struct(F.element_at(_strings(c.families), F.array_position(s, top).cast("int")).alias("family"), (F.lit(1.0) / total).alias("probability"))

    found = let(hits(F.col("words")), lambda h: let(sums(h), lambda s: let(F.array_max(s), lambda top: best(s, top))))
    # exploded, so that a filter on the result isn't pushed below and all of it computed again for it
    return lines.select("*", F.explode(F.array(found)).alias("_r")).select(*lines.columns, F.array_distinct(grams(F.col("words"), 2)).alias("pairs"), "_r.family", "_r.probability")


def scan_licenses(docs: DataFrame, min_probability: float = MIN_PROBABILITY, min_share: float = MIN_TEMPLATE_SHARE) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed) of each paragraph of a known family.

    paragraph counts the text's lines from 0. template_share is the share of the paragraph's word pairs that stand in
    that one template of the family where it is largest; of a longer paragraph, the share of the template's. Null and
    empty texts have none; texts of any length are scanned whole. Of two families of equal probability the first
    counts. Repeated rows and rows without id give their rows each; no rows: no rows. Further columns, of any name,
    don't count. All in one pass, no shuffle. min_probability must be MIN_PROBABILITY or more.
    """
    if min_probability < MIN_PROBABILITY:
        raise ValueError("words that known paragraphs hold are listed for MIN_PROBABILITY and above")
    c = trained()
    words_of = lambda t: F.filter(F.split(t, _SPLIT), lambda x: x != "")
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.where(F.arrays_overlap(F.split("text", _SPLIT), _strings(c.anchors)))
    each = rows.select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), words_of)).alias("paragraph", "words"))
    each = scored(each.where(F.arrays_overlap("words", _strings(c.anchors))), c).where((F.col("family") != "unknown") & (F.col("probability") >= min_probability))
    share = None
    for f, texts in TEMPLATES.items():
        own = [_pairs(t) for t in texts]
        best = F.array_max(F.array(*[F.try_divide(F.size(F.array_intersect("pairs", _strings(p))).cast("double"), F.least(F.size("pairs"), F.lit(len(p))).cast("double")) for p in own]))
        share = F.when(F.col("family") == f, best) if share is None else share.when(F.col("family") == f, best)
    each = each.withColumn("template_share", F.coalesce(share, F.lit(0.0)))
    return each.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("template_share", 6).alias("template_share"), (F.col("template_share") >= min_share).alias("confirmed"))

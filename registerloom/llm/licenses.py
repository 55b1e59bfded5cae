"""License scans: a trained paragraph classifier confirmed by templates, in DataFrame operations only."""

from __future__ import annotations

import functools
import json
import math
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._rows import numbered, save

#: Passages of public licences, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}
#: Sentences with the vocabulary of licences that grant none; examples of the unknown class.
OTHERS = (
    "All rights reserved.", "Copyright notice.", "The driver's license was renewed at the office.", "He is a licensed physician in this state.",
    "The album was released under a new label.", "A license plate was found near the road.", "The software is distributed to all students of the school.",
    "Permission to enter was granted by the guard.", "The public library is free of charge.", "The general public was informed of the version of events.",
    "The warranty covers parts for two years.", "See the terms and conditions of sale.", "This work is part of a series.", "The commons are open to all citizens.",
    "The copyright holder could not be found.", "Licensed under terms that are not stated here.", "Released under the authority of the council.",
    "This work is licensed to the publisher for ten years.", "The license expires in May.", "Proprietary and confidential: no license is granted.",
    "This file is subject to a commercial license agreement with the vendor.", "A copy of the agreement is available on request.",
    "Distributed under the LGPL v2.1.", "LGPL-3.0", "LGPLv2.1", "AGPL-3.0", "AGPLv3", "Released under AGPLv3.", "Available under CC BY-SA 4.0.", "CC0 1.0",
    "Er kam mit der Zeit zurück.", "Mit dem Zug und mit einer Freundin.", "mit der Zeit", "Wir sind mit ihnen unter einem Dach.", "A seminar at MIT in the spring.",
    "Send it to me with a cc to him.", "He was here in the morning and it is as it was.", "The file is here.", "This is the version from which they worked.",
    "It was released in May and made available to the public.", "The creative work of the commons was under way.", "Terms of 4.0 or 2.0 per cent.", "No. 3 or 2",
    "The attribution of the picture is not known.", "They went from the house to the sea, and at the end of the day they were by the fire with us.",
)
#: Names that licences go by, of which the classifier learns too; none is a template.
NAMES = {
    "MIT": ("MIT License", "MIT-licensed", "Released under MIT terms.", "Available under MIT.", "License: MIT", "This code is MIT licensed."),
    "Apache-2.0": ("Apache-2.0", "Apache License 2.0", "Released under Apache 2.0.", "License: Apache-2.0"),
    "GPL-3.0": ("GPLv3", "GPLv3+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "Released under GPLv3.", "GNU GPL version 3", "Licensed under the GPL v3."),
    "GPL-2.0": ("GPLv2", "GPLv2+", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "Released under GPLv2.", "GNU GPL version 2", "Licensed under the GPL v2."),
    "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "Released under the BSD license."),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Available under CC BY-NC 4.0."),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International", "This work is available under Creative Commons Attribution 4.0 International.", "Available under CC BY 4.0."),
    "MPL-2.0": ("MPLv2", "MPLv2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Released under the MPL 2.0.", "Released under MPLv2.", "Licensed under the MPLv2."),
}
#: A text of the unknown class is returned only if it has one of these words or beginnings of words. They exclude no text of
#: a known family.
ANCHORS = ("licen", "sublicen", "copyright", "apache", "gnu", "gpl", "lgpl", "agpl", "bsd", "mozilla", "mpl", "warrant", "redistribut", "permission")
_WHOLE = {"gnu", "bsd"}
#: Words of common prose, for examples of the unknown class; those in _FREQUENT the prefilter looks for only if
#: it must, which is a matter of speed alone.
_FREQUENT = frozenset("a an and are as at be by for from he in is it of on or that the to was with".split())
_COMMON = tuple(sorted(set("""a about above after all along also an and any are as at auf be been but by can could das dem den der die do each ein eine either
end er every except file for form found free from general had have he her here him his if im in included is ist it its kind known later law made may me met mit
more name near neither new no nor not of office on one open option or other part per person public see shall she should so some state such ten than that the
their them then there these they this to two under und us use used v von was way we were what when which who whom will with without work writing written would
years you your zu""".split())))
UNKNOWN = "unknown"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
_ANCHOR = "|".join(rf"{re.escape(a)}(?![\p{{L}}\p{{N}}])" if a in _WHOLE else re.escape(a) for a in ANCHORS)
#: Java's form: an anchor where a word begins, A-Z in either case.
ANCHOR_PATTERN = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_ANCHOR})"
#: A word: letters and digits, with single points or hyphens inside.
WORD_PATTERN = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
_PY_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def py_words(text: str) -> list[str]:
    return _PY_WORD.findall(text.lower())


def _anchored(word: str) -> bool:
    return any(word == a or (a in _WHOLE and re.match(rf"{a}[.-]", word)) or (a not in _WHOLE and word.startswith(a)) for a in ANCHORS) or any(
        part.startswith(a) if a not in _WHOLE else part == a for part in re.split(r"[.-]", word) for a in ANCHORS
    )


def py_features(words: list[str]) -> set[str]:
    """Word 1- to 3-grams."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _examples(seed: int) -> list[tuple[list[str], str, int]]:
    """Training paragraphs, their family and the number of the passage that they are made from: templates and others, some
    with words dropped or amid other words."""
    rng = random.Random(seed)
    filler = [w for text in OTHERS for w in py_words(text) if not _anchored(w)]
    out, passage = [], 0
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for text in (*texts, *NAMES.get(family, ())):
            words, passage = py_words(text), passage + 1
            for i in range(30):
                w = [x for x in words if i == 0 or rng.random() > 0.04]
                if i % 3 == 1:
                    w = [rng.choice(filler) for _ in range(rng.randrange(12))] + w + [rng.choice(filler) for _ in range(rng.randrange(12))]
                out.append((w, family, passage))
    return out


def _prose(seed: int, n: int = 600) -> list[list[str]]:
    """Examples of the unknown class: words of common prose in any order, and texts of no known word."""
    rng = random.Random(seed + 1)
    return [[rng.choice(_COMMON) for _ in range(rng.choice((0, 3, 8, 20, 60, 200)))] for _ in range(n)]


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int, l1: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression, by accelerated proximal gradient steps. The penalty is on each
    feature's row of weights, so that most features have none."""
    n, v = len(x), np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (x @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    steep = 0.5 * float(np.linalg.norm(x.T @ (x @ v))) / n + 0.5
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        gap = (_soft(x @ ahead_w + ahead_b) - y) / n
        new_w, new_b = ahead_w - x.T @ gap / steep, ahead_b - gap.sum(axis=0) / steep
        norm = np.maximum(np.linalg.norm(new_w, axis=1, keepdims=True), 1e-12)
        new_w = new_w * np.maximum(0.0, 1 - l1 / steep / norm)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w, ahead_b = new_w + (last - 1) / t * (new_w - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, b


@functools.cache
def train(seed: int = 11, rounds: int = 200, l1: float = 0.001, folds: int = 3) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """(families, weights by feature, biases, least probability): sparse multinomial logistic regression over presence of
    n-grams, fitted on the driver from some thousand synthetic paragraphs.

    Every passage is held out once, with all paragraphs made from it, and scored by a model of the others. The held-out
    scores set the temperature, and the probability below which a paragraph is unknown: the 99 % quantile of what held-out
    paragraphs of the unknown class get for a family."""
    families = (*TEMPLATES, UNKNOWN)
    examples = _examples(seed)
    data = [(py_features(w), families.index(f)) for w, f, _ in examples]
    texts = [t for part in (TEMPLATES, NAMES) for own in part.values() for t in own] + [*OTHERS]
    names = sorted({x for t in texts for x in py_features(py_words(t))})  # n-grams met only in the words around them are noise
    at = {x: i for i, x in enumerate(names)}
    prose = _prose(seed)
    data += [(py_features(w), families.index(UNKNOWN)) for w in prose]
    fold = np.array([n % folds for _, _, n in examples] + [i % folds for i in range(len(prose))])
    x = np.zeros((len(data), len(names)), np.float32)
    for i, (f, _) in enumerate(data):
        x[i, [at[v] for v in f if v in at]] = 1
    truth = np.array([t for _, t in data])
    y = np.eye(len(families), dtype=np.float32)[truth]
    z = np.zeros(y.shape)
    for k in range(folds):
        w, b = _fit(x[fold != k], y[fold != k], rounds // 2, l1)
        z[fold == k] = x[fold == k] @ w + b
    loss = {t: -np.log(_soft(z * t)[np.arange(len(z)), truth] + 1e-12).mean() for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    scale = min(loss, key=loss.get)
    best = _soft(z * scale)[:, :-1].max(axis=1)
    least = float(np.clip(np.quantile(best[truth == len(families) - 1], 0.99), 0.5, 0.9))
    w, b = _fit(x, y, rounds, l1)
    w, b = np.round(w.astype(float) * scale, 6), np.round(b.astype(float) * scale, 6)
    return families, {n: tuple(w[i].tolist()) for n, i in at.items() if np.abs(w[i]).max() > 1e-4}, tuple(b.tolist()), least


@functools.cache
def signals() -> tuple[str, ...]:
    """Words of which every text of a known family has one, by the weights: the n-grams of all other words together, those
    against a family left out, don't lift any family to the least probability, nor to that of the unknown class."""
    families, weights, biases, least = train()
    k = len(families) - 1
    need = np.array([biases[k] - b for b in biases[:k]]) + math.log(least / (1 - least)) - 1e-6
    if need.min() <= 0:
        raise ValueError("a text of no known word would have a family")
    gain = {g: np.maximum(np.array(w[:k]) - w[k], 0.0) for g, w in weights.items()}
    left = {g: v for g, v in gain.items() if v.any()}
    chosen = []
    while True:
        over = sum(left.values(), np.zeros(k)) >= need
        if not over.any():
            return tuple(sorted(chosen))
        share = {}
        for g, v in left.items():
            for word in set(g.split(" ")):
                share[word] = share.get(word, 0.0) + v[over].sum()
        best = max(share, key=lambda x: (share[x] / (1000 if x in _FREQUENT else 1), x))
        chosen.append(best)
        left = {g: v for g, v in left.items() if best not in g.split(" ")}


def _either(words: list[str]) -> str:
    """Java's form of alternatives, those of one first letter together."""
    heads = {}
    for word in words:
        heads.setdefault(word[0], []).append(word[1:])
    return "|".join(rf"{re.escape(head)}(?:{'|'.join(map(re.escape, sorted(tails)))})" for head, tails in sorted(heads.items()))


def _signal_pattern() -> str:
    """Java's form: a signal where a word begins and ends, or an anchor, in lower case."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_either(list(signals()))})(?![\p{{L}}\p{{N}}])|{_ANCHOR})"


def _shingles(words: list[str]) -> list[str]:
    n = SHINGLE_WORDS
    return sorted({" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}) if words else []


def _ngrams(words: Column, n: int) -> Column:
    """By shifted copies of the array: a slice at every start would copy all words each time."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(j + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _apart(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """df with the columns kept and made, each made once: what follows is not merged into this step."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _constant(value, kind: str) -> Column:
    """A literal of nested arrays, read from JSON once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps({"v": value}, ensure_ascii=False)), f"v {kind}")["v"]


def _lookup(spark: SparkSession, weights: dict[str, tuple[float, ...]], k: int) -> tuple[Callable[[Column], Column], list[Column]]:
    """(find, columns): find maps an array of n-grams to the places of those that have weights, columns hold each class's weights
    by place. Some bits of an n-gram's hash give its place, chosen so that no two n-grams with weights share it; the whole
    hash there tells it from others."""
    names = sorted(weights)
    rows = spark.createDataFrame(list(enumerate(names)), "i int, gram string").select("i", F.xxhash64("gram").alias("h")).collect()
    hashes = [r["h"] for r in sorted(rows)]
    bits, shift = next((bits, shift) for bits in range(10, 30) for shift in range(64 - bits) if len({h >> shift & (1 << bits) - 1 for h in hashes}) == len(names))
    slots = [0] * (1 << bits)
    for i, h in enumerate(hashes):
        slots[h >> shift & (1 << bits) - 1] = i + 1
    slots, known = _constant(slots, "array<int>"), _constant([None, *hashes], "array<bigint>")
    place = lambda h: F.get(slots, F.shiftright(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    find = lambda grams: F.array_sort(F.transform(F.filter(F.transform(grams, lambda g: F.xxhash64(g)), lambda h: F.get(known, place(h)) == h), place))
    return find, [_constant([0.0, *(weights[n][i] for n in names)], "array<double>") for i in range(k)]


def scan(docs: DataFrame) -> DataFrame:
    """Texts that speak of licences: doc_id, paragraph, family, probability, template, similarity, confirmed, n_words, n_lines, rid.

    Every line is classified, and every paragraph of two lines or more: lines between lines of nothing but white space, of
    which licences are wrapped. paragraph is the number of the (first) line, n_lines tells lines (1) from paragraphs. Word
    n-grams have weights for each family, the largest probability decides, and below the calibrated least one the family is
    unknown. Only texts that hold a signal, a word without which the weights can reach no family, or an anchor are scored, as the
    others are unknown. A text of the unknown class is returned if it is a line with an anchor. A prediction is confirmed if
    a template of its family is in the text by at least SIMILARITY of its shingles of SHINGLE_WORDS words. A paragraph is
    returned if it has a known family that none of its lines has, or none confirmed while the paragraph is.

    Candidates are scored where they are read: the weights, of a fixed number, are constants of the plan, and nothing but
    the returned rows is shuffled. Nulls and empty texts have no lines; a null doc_id is returned as it is; repeated rows are scanned each; a family of equal probability comes first
    in the order of TEMPLATES. An empty table gives no rows; other columns are ignored.
    """
    families, weights, biases, least = train()
    spark, k = docs.sparkSession, len(families)
    signal, line_break = F.lit(_signal_pattern()), F.lit("\n")
    rows = numbered(docs).select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.regexp_like(F.lower("text"), signal))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, line_break))
    unit = lambda at, size, t: F.struct(at.cast("int").alias("paragraph"), size.cast("int").alias("n_lines"), t.alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda t, i: unit(i, F.lit(1), t))
    # each part but the first starts with a blank line, and has no other
    parts = F.split("text", r"(?<=\n)(?=[^\S\n]*\n)")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<paragraph: int, n_lines: int, text: string>>)").alias("out"))
    lead = lambda t: F.when(F.regexp_like(t, F.lit(r"^[^\S\n]*\n")), 1).otherwise(0)
    size = lambda t: breaks(t) - lead(t) + F.when(F.regexp_like(F.substring_index(t, "\n", -1), F.lit(r"\S")), 1).otherwise(0)
    step = lambda a, t: F.struct((a["at"] + breaks(t)).alias("at"), F.when(size(t) > 1, F.concat(a["out"], F.array(unit(a["at"] + lead(t), size(t), t)))).otherwise(a["out"]).alias("out"))
    blocks = F.aggregate(parts, start, step, lambda a: a["out"])
    units = rows.select("rid", "doc_id", F.explode(F.concat(lines, blocks)).alias("u")).select("rid", "doc_id", "u.*").filter(F.regexp_like(F.lower("text"), signal))
    anchored = F.regexp_like("text", F.lit(ANCHOR_PATTERN)).alias("anchored")
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(0)).alias("words")
    units = _apart(units, "rid", "doc_id", "paragraph", "n_lines", anchored=anchored, words=words)
    grams = F.array_distinct(F.concat(*[_ngrams(F.col("words"), n) for n in (1, 2, 3)]))
    find, columns = _lookup(spark, weights, k)
    units = _apart(units, "rid", "doc_id", "paragraph", "n_lines", "anchored", "words", found=find(grams))
    added = lambda w: lambda a, i: a + F.get(w, i)
    sums = [F.aggregate("found", F.lit(b), added(w)) for w, b in zip(columns, biases)]  # in order of the places, the same each time
    units = _apart(units, "rid", "doc_id", "paragraph", "n_lines", "anchored", "words", **{f"z{i}": z for i, z in enumerate(sums)})
    top, other = F.greatest(*[F.col(f"z{i}") for i in range(k - 1)]), F.col(f"z{k - 1}")
    total = sum((F.exp(F.col(f"z{i}") - F.col("top")) for i in range(k)), F.lit(0.0))
    number = F.coalesce(*[F.when(F.col(f"z{i}") == F.col("top"), i) for i in range(k - 1)])
    units = units.withColumn("top", top).withColumn("probability", 1 / total)
    units = units.withColumn("number", F.when((F.col("probability") >= least) & (other <= F.col("top")), number).otherwise(k - 1))
    units = units.filter((F.col("number") < k - 1) | (F.col("anchored") & (F.col("n_lines") == 1)))
    own = F.when(F.size("words") >= SHINGLE_WORDS, _ngrams(F.col("words"), SHINGLE_WORDS)).otherwise(F.array(F.array_join("words", " ")))
    units = _apart(
        units, "rid", "doc_id", "paragraph", "n_lines", "number", "probability", n_words=F.size("words"), own=F.array_distinct(own),
        forms=_constant([[_shingles(py_words(t)) for t in texts] for texts in TEMPLATES.values()] + [[]], "array<array<array<string>>>")[F.col("number")],
    )
    alike = F.transform("forms", lambda f, i: F.struct((F.size(F.array_intersect(f, F.col("own"))) / F.size(f)).alias("similarity"), (-i).alias("minus")))
    best = F.array_max(alike)
    out = units.select(
        "rid", "doc_id", "paragraph", "n_lines", "probability", "n_words", F.element_at(F.array(*[F.lit(f) for f in families]), F.col("number") + 1).alias("family"),
        F.struct((1 - best["minus"]).alias("template"), F.coalesce(best["similarity"], F.lit(0.0)).alias("similarity")).alias("best"),
    ).withColumn("confirmed", F.col("best.similarity") >= SIMILARITY)
    out = save(out)
    line, block = out.filter("n_lines = 1"), out.filter("n_lines > 1")
    inner = line.select(F.col("rid").alias("of_rid"), F.col("family").alias("of_family"), F.col("paragraph").alias("at"), F.col("confirmed").alias("sure"))
    within = (F.col("rid") == F.col("of_rid")) & (F.col("family") == F.col("of_family")) & (F.col("at") >= F.col("paragraph")) & (F.col("at") < F.col("paragraph") + F.col("n_lines"))
    out = line.unionByName(block.join(inner, within & (F.col("sure") | ~F.col("confirmed")), "left_anti"))
    return out.select(
        "doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.col("best.template").alias("template"),
        F.col("best.similarity").alias("similarity"), "confirmed", "n_words", "n_lines", "rid",
    )

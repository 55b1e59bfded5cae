"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import lean, send

#: Labelled documents of each class that the tagger is fitted on, at most, and words (between white space) of the longest.
TRAIN_ROWS, TRAIN_WORDS = 3000, 20_000
#: A word or beginning of words is a feature if it stands in toxic documents with at least so many different neighbours, ...
CONTEXTS = 6
#: ... and the odds of toxic against other documents that hold it are at least WIDE times those of all documents. The first
#: guess at the tags are the words of STRONG odds; later ones are the chain's own.
WIDE, STRONG = 4.0, 40.0
#: Letters of the beginnings of words that are features beside the word itself; one is a feature if it begins so many words.
PREFIXES = range(4, 8)
FAMILY = 3
#: Words before and after a tagged token in a training sequence, sequences of one document at most, and rounds of tagging.
WINDOW, SEQUENCES, PASSES = 8, 3, 3
#: A weight below this is none.
LEAST_WEIGHT = 0.2
_TOKEN = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its beginnings, which carry a hyphen."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


class Weights(dict):
    """Weight of each word met so far, None for words without any feature that has one; emptied when it is full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float | None:
        if len(self) > 500_000:
            self.clear()
        found = [self.weights[f] for f in features(word) if f in self.weights]
        self[word] = out = sum(found) if found else None
        return out

    def __reduce__(self):
        return Weights, (self.weights,)


class Tagger:
    """A chain with two tags, 0 and 1 (toxic). Features that mark toxic tokens have weights, words without any share one
    emission; bias, start and transitions make up the rest."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray, start: np.ndarray):
        self.words, self.bias, self.step, self.start = Weights(weights), bias, step, start
        plain = np.exp(step) * np.array([1.0, math.exp(bias)])[None, :]  # from tag, to tag
        self.one = np.stack([plain, plain * np.array([0.0, 1.0])]) / plain.max()
        self.powers = {0: np.stack([np.eye(2), np.zeros((2, 2))])}
        self.fit = (0.0, 0.0, 0.0)

    def across(self, n: int) -> np.ndarray:
        """The product of n steps over words without a weight, and the same with the expected number of toxic ones among
        them, both scaled alike: two stacked matrices."""
        if n not in self.powers:
            m = self._joined(self.across(n // 2), self.across(n // 2)) if n > 1 else self.one
            if n > 1 and n % 2:
                m = self._joined(m, self.one)
            if len(self.powers) > 100_000:
                self.powers = {0: self.powers[0]}
            self.powers[n] = m / m[0].max()
        return self.powers[n]

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([a[0] @ b[0], a[1] @ b[0] + a[0] @ b[1]])

    def marginals(self, at: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, float]:
        """(P(toxic) at the given places of a text of n words, expected number of all its toxic words), by forward-backward.

        Runs of words without a weight of their own are crossed by powers of one matrix, which gives the same numbers as
        going word by word."""
        if not n:
            return np.empty(0), 0.0
        steps, places = np.exp(self.step), at.tolist()
        emit = [np.array([1.0, math.exp(self.bias + w)]) for w in weights.tolist()]
        first = not places or places[0] > 0  # the first word has no weight
        stops = ([0] if first else []) + places
        emits = ([np.array([1.0, math.exp(self.bias)])] if first else []) + emit
        forward = []  # after each stop
        for i, (p, e) in enumerate(zip(stops, emits)):
            v = np.exp(self.start) if i == 0 else forward[-1] @ self.across(p - stops[i - 1] - 1)[0] @ steps
            v = v * e
            forward.append(v / v.sum())
        u, total, out = np.ones(2), 0.0, np.empty(len(stops))
        for i in range(len(stops) - 1, -1, -1):
            run, count = self.across((stops[i + 1] if i + 1 < len(stops) else n) - stops[i] - 1)
            if i + 1 < len(stops):  # over the next stop
                u = steps @ (emits[i + 1] * u)
                u = u / u.sum()
            total += float(forward[i] @ count @ u) / float(forward[i] @ run @ u)
            u = run @ u
            u = u / u.sum()
            both = forward[i] * u
            out[i] = both[1] / both.sum()
        return out[1:] if first else out, total + float(out.sum())

    def tag(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and marginals of the words that have a weight, and the expected number of toxic words."""
        known = self.words
        pairs = [(i, w) for i, x in enumerate(words) if (w := known[x]) is not None]
        at, weights = np.array([i for i, _ in pairs], np.int64), np.array([w for _, w in pairs])
        return at, *self.marginals(at, weights, len(words))

    def summary(self, words: list[str]) -> tuple[float, float, np.ndarray, np.ndarray]:
        """What the document's score rests on: log odds of its largest marginal (or of the mean of all, if that is larger), log of
        its expected number of toxic words."""
        at, m, total = self.tag(words)
        most = max(total / max(1, len(words)), float(m.max()) if len(m) else 0.0)
        most = min(max(most, 1e-9), 1 - 1e-9)
        return math.log(most / (1 - most)), math.log1p(total), at, m

    def score(self, words: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
        a, b, at, m = self.summary(words)
        z = self.fit[0] + self.fit[1] * a + self.fit[2] * b
        return 1 / (1 + math.exp(-min(max(z, -35.0), 35.0))), at, m


def toxic_features(docs: list[tuple[list[str], int]]) -> dict[str, float]:
    """Features of toxic words, and by how much the odds of toxic documents among those that hold them exceed the odds of all.

    Copies of one text repeat the same neighbours, so support is the number of different pairs of neighbours."""
    contexts: dict[str, set] = defaultdict(set)
    family: dict[str, set] = defaultdict(set)
    seen, n = [Counter(), Counter()], [0, 0]
    for words, label in docs:
        n[label] += 1
        seen[label].update({f for w in set(words) for f in features(w)})
        if label:
            for a, w, z in zip(["", *words], words, [*words[1:], ""]):
                for f in features(w):
                    if len(contexts[f]) < CONTEXTS:
                        contexts[f].add((a, z))
                    if f.endswith("-") and len(family[f]) < FAMILY:
                        family[f].add(w)
    base = (n[1] + 1) / (n[0] + 1)
    wide = {f for f in contexts if len(contexts[f]) >= CONTEXTS and (not f.endswith("-") or len(family[f]) >= FAMILY)}
    odds = {f: (seen[1][f] + 0.5) / (seen[0][f] + 0.5) / base for f in sorted(wide)}
    return {f: x for f, x in odds.items() if x >= WIDE}


def _windows(docs: list[tuple[list[str], int]], tags: list[tuple[list[int], list[int]]]) -> list[tuple[list[str], list[int]]]:
    """Training sequences: the surroundings of some toxic words of each document and of some words that only looked so, and one
    stretch from anywhere in the text of every document without any. tags: places of either for each document."""
    out, seen, rng = [], set(), random.Random(23)
    for (words, _), (toxic, odd) in zip(docs, tags):
        marked = set(toxic)
        for places in (toxic, odd):
            for i in sorted(rng.sample(places, min(SEQUENCES, len(places)))):
                a, z = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
                out.append((tuple(words[a:z]), [int(j in marked) for j in range(a, z)]))
        if not toxic and not odd:
            a = rng.randrange(max(1, len(words) - 2 * WINDOW + 1))
            out.append((tuple(words[a : a + 2 * WINDOW]), [0] * len(words[a : a + 2 * WINDOW])))
    return [(list(part), tags) for part, tags in out if part and not (part in seen or seen.add(part))]


def _tagged(tagger: Tagger, words: list[str], label: int) -> tuple[list[int], list[int]]:
    """(toxic words, words that looked toxic): a toxic document has at least one toxic word if any looks at all like one, others
    have none."""
    at, m, _ = tagger.tag(words)
    if not label:
        return [], at[m >= 0.2].tolist()
    return at[m >= min(0.5, max(0.05, float(m.max(initial=0.0))))].tolist(), []


def train(docs: list[tuple[list[str], int]], rounds: int = 60, l2: float = 3e-4) -> Tagger:
    """Fit the chain, then the document score by logistic regression.

    Labels mark documents, so the tags of their words are latent. The first guess are the words of strong odds in toxic
    documents; the chain is fitted to it, tags all documents anew, under what their labels say, and is fitted again."""
    odds = toxic_features(docs)
    strong = {f for f, x in odds.items() if x >= STRONG}
    guess = Tagger(dict.fromkeys(strong, 8.0), -4.0, np.zeros((2, 2)), np.zeros(2))
    tags = [([i for i, w in enumerate(words) if label and guess.words[w] is not None], []) for words, label in docs]
    for i in range(PASSES):
        tagger = fit(_windows(docs, tags), sorted(odds), rounds, l2)
        if i + 1 < PASSES:
            tags = [_tagged(tagger, words, label) for words, label in docs]
    rows = np.array([tagger.summary(words)[:2] for words, _ in docs] or [(0.0, 0.0)])
    labels = np.array([t for _, t in docs] or [0], float)
    design = np.column_stack([np.ones(len(rows)), rows])
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a weak pull to 0
        q = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = (design * (q * (1 - q))[:, None]).T @ design + 0.01 * np.eye(3)
        beta = beta + np.linalg.solve(h, design.T @ (labels - q) - 0.01 * beta)
    tagger.fit = tuple(float(b) for b in beta)
    return tagger


def fit(data: list[tuple[list[str], list[int]]], names: list[str], rounds: int, l2: float) -> Tagger:
    """The chain of the greatest conditional likelihood of tagged sequences, by gradient ascent."""
    index = {w: i + 1 for i, w in enumerate(names)}
    size = max((len(p) for p, _ in data), default=1)
    x = np.zeros((max(1, len(data)), size, 1 + len(PREFIXES)), np.int64)
    y, mask = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for i, (part, tags) in enumerate(data):
        y[i, : len(part)], mask[i, : len(part)] = tags, 1
        for j, word in enumerate(part):
            for c, f in enumerate(features(word)):
                x[i, j, c] = index.get(f, 0)
    w, bias, step, start = np.zeros(len(names) + 1), -2.0, np.zeros((2, 2)), np.zeros(2)
    total = max(1, len(data))
    theta = np.concatenate([w[1:], [bias], step.ravel(), start])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        k = len(names)
        w[1:], bias, step, start = theta[:k], theta[k], theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :]
        emit = np.stack([np.zeros(y.shape), bias + w[x].sum(axis=2)], axis=2)
        fwd = np.empty(emit.shape)
        fwd[:, 0] = start + emit[:, 0]
        for t in range(1, size):
            new = np.logaddexp(fwd[:, t - 1, :1] + step[0], fwd[:, t - 1, 1:] + step[1]) + emit[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        back = np.zeros(emit.shape)
        g_step = np.zeros((2, 2))
        for t in range(size - 2, -1, -1):
            ahead = emit[:, t + 1] + back[:, t + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            on = mask[:, t + 1] > 0
            back[:, t] = np.where(on[:, None], new, back[:, t + 1])
            pair = np.exp(fwd[:, t, :, None] + step[None] + ahead[:, None, :] - z[:, None, None]) * on[:, None, None]
            true = np.zeros((len(x), 2, 2))
            true[np.arange(len(x)), y[:, t], y[:, t + 1]] = on
            g_step += (true - pair).sum(axis=0)
        p = np.exp(fwd + back - z[:, None, None]) * mask[..., None]
        gap = (y * mask) - p[..., 1]
        g_w = np.bincount(x.ravel(), weights=np.repeat(gap.ravel(), x.shape[2]), minlength=k + 1)[1:]
        first = np.stack([1 - y[:, 0], y[:, 0]], axis=1) - p[:, 0]
        grad = np.concatenate([g_w, [gap.sum()], g_step.ravel(), (first * mask[:, :1]).sum(axis=0)]) / total - l2 * theta * np.concatenate([np.ones(k), np.zeros(7)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    k = len(names)
    weights = {f: x for f, x in zip(names, theta[:k].tolist()) if abs(x) >= LEAST_WEIGHT}
    return Tagger(weights, float(theta[k]), theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5 :])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> list[tuple[list[str], int]]:
    """A seeded sample of at most rows labelled documents of each class, none of them held out; those of it that have more than
    words words are left out."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    picked = known.filter("toxic = 1").orderBy("h", "doc_id").limit(rows).unionByName(known.filter("toxic = 0").orderBy("h", "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").filter(F.regexp_count("text", F.lit(r"\S+")) <= words)
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).toLocalIterator()
    return [(tokens(text), int(label)) for _, label, text in sorted((r["doc_id"], r["toxic"], r["text"]) for r in found)]


def _offsets(text: str, at: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the words at the given places; lower-casing may change a text's length, so they are found anew."""
    want, out = set(at.tolist()), []
    plain = len(text.lower()) == len(text)
    for i, m in enumerate(_TOKEN.finditer(text.lower() if plain else text)):
        if i in want:
            out.append(m.span())
    return out


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: Tagger = model.value
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                value, at, m = tagger.score(words)
                bad = at[m >= 0.5]
                spans = ",".join(f"{a}:{z}" for a, z in _offsets(text, bad)) if len(bad) else ""
                out.append((value, len(words), len(bad), spans))
            value, n, bad, spans = zip(*out) if out else ((), (), (), ())
            score = np.array(value, float)
            arrays = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], _COLUMNS)

    return score


_COLUMNS = ["doc_id", "held_out", "score", "predicted", "n_words", "n_toxic", "spans"]
_TYPES = "doc_id long, held_out boolean, score double, predicted int, n_words long, n_toxic long, spans string"


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_words, n_toxic, spans.

    The chain is fitted on at most rows documents of each class of labels, of at most words words each, and on at most
    SEQUENCES windows of a document (the documented bounds of the sample). Labels mark documents; the tags of their words are found in rounds of fitting and tagging, see train().
    Every whole text is tagged by forward-backward; spans are the code points of words whose toxic marginal is 0.5 or more,
    score is a logistic function of the largest marginal and the sum of all. Only the text is input of a score.

    Nulls and empty texts: no words, the score of a document without any toxic word. A null doc_id never has a label.
    Repeated rows are scored each; a document with several labels is toxic if any is, and of several texts of one id the
    first by code point is learned from. Without labels nothing is toxic and
    all scores are one low constant or near it. An empty table gives no rows; other columns are ignored.
    """
    tagger = train(training_rows(docs, labels, rows, words))
    sent = send(docs.sparkSession, tagger)
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    return inputs.mapInArrow(lean(_scorer(sent)), _TYPES)

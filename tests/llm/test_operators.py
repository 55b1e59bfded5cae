"""Operators against brute force and on edge cases."""

import hashlib
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from registerloom.llm import _grams, decontaminate, licenses, lmscore, mixing, neardup, quality, secrets, tokens, topk, toxicity

CORPUS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, or return, on tables that are not theirs.
CLASH = ("score", "keep", "rid", "n", "h", "kept", "size", "target", "held_out", "key", "start", "ord", "bucket", "repetition")


def corpus(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, la, so, len(t) if t is not None else None) for i, t, la, so in rows], CORPUS)


def odd(spark):
    long = "lorem ipsum dolor sit amet " * 8000
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, long, "en", "b"), (5, "same text of five words", "en", "a"), (5, "same text of five words", "en", "a"), (None, "no id here, token = abcdefgh12", "de", "a"), (7, "ÄÖÜ İstanbul 🎉\nLicensed under the Apache License, Version 2.0.", "de", "b")]
    return corpus(spark, rows).withColumns({c: F.lit("x") for c in CLASH})


def empty(spark):
    return corpus(spark, []).withColumns({c: F.lit("x") for c in CLASH})


LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_edge_cases(spark, kind):
    docs = odd(spark) if kind == "odd" else empty(spark)
    n = 8 if kind == "odd" else 0
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)] if n else [], LABELS)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text of five words"), (3, "same text of five words"), (None, "lorem")] if n else [], ITEMS)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == ({(5, 3)} if n else set())
    for found in (
        toxicity.score(docs, labels), lmscore.score(docs), secrets.scan(docs), quality.classify(docs, labels), neardup.near_duplicates(docs), mixing.mix(docs),
    ):
        assert found.count() == n
    found = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["family"], r["confirmed"]) for r in found] == ([(7, "Apache-2.0", True)] if n else [])
    sections = tokens.count(docs).collect()
    assert len({r["doc_id"] for r in sections}) == (7 if n else 0)
    assert secrets.redact(docs).columns == docs.columns
    assert decontaminate.decontaminate(docs, items).count() == (6 if n else 0)


def test_tiling_catches_reordered_passages(spark):
    rng = random.Random(1)
    item = words(rng, 30).split()
    parts = [item[20:], item[9:20], item[:9]]
    reordered = words(rng, 40) + " " + ", ".join(" ".join(p).upper() for p in parts) + ". " + words(rng, 40)
    half = words(rng, 40) + " " + " ".join(item[:10]) + " " + words(rng, 40)
    docs = corpus(spark, [(1, reordered, "en", "a"), (2, half, "en", "a"), (3, words(rng, 90), "en", "a")])
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(9, " ".join(item)), (8, words(rng, 20))], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["n_tiles"]) for r in rows] == [(1, 9, 1.0, 3)]
    blocks = decontaminate.contaminated(docs, spark.createDataFrame([(9, " ".join(item)), (8, words(rng, 20))], ITEMS), block_words=10).collect()
    assert [(r["doc_id"], r["item_id"]) for r in blocks] == [(1, 9)]


def greedy(a, b, k):
    """Greedy string tiling straight from its definition: covered words of a."""
    ma, mb, covered = set(), set(), 0
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                    n += 1
                if n >= k:
                    best.append((-n, i, j))
        if not best:
            return covered
        n, i, j = min(best)
        ma.update(range(i, i - n))
        mb.update(range(j, j - n))
        covered -= n


def test_tiling_by_definition():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(n)] for n in (rng.randrange(3, 14), rng.randrange(3, 25)))
        place, at = zip(*[(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]] or [(0, 0)])
        got = sum(n for _, _, n in decontaminate.tile(np.array(place), np.array(at), 3)) if a[place[0] : place[0] + 3] == b[at[0] : at[0] + 3] else 0
        assert got == greedy(a, b, 3)


def test_matches_of_repeated_words_by_definition():
    rng = random.Random(22)
    for n in range(120):
        letters = "ab" if n % 3 else "a"
        items = [" ".join(rng.choice(letters + "c" * (n % 2)) for _ in range(rng.randrange(3, 14))) for _ in range(3)]
        known = decontaminate.Items(list(enumerate(items)), 3)
        text = [rng.choice(letters + "dd" * (n % 5 == 0)) for _ in range(rng.randrange(3, 25))]
        numbers = np.array([known.vocabulary.get(w, 0) for w in text], np.int64)
        seed = known.meet(numbers)
        for i, item in enumerate(items):
            a = item.split()
            want = set()
            for p in range(len(a)):
                for q in range(len(text)):
                    if p and q and a[p - 1] == text[q - 1]:
                        continue
                    length = 0
                    while p + length < len(a) and q + length < len(text) and a[p + length] == text[q + length]:
                        length += 1
                    if length >= 3:
                        want.add((p, q, length))
            got = [x.tolist() for x in known.matches(i, numbers, seed)]
            assert set(zip(*got)) == want and len(got[0]) == len(want)
            if want:
                assert sum(n for _, _, n in decontaminate.tile_matches(*map(np.array, got), 3)) == greedy(a, text, 3)


def test_contaminated_by_one_word_over_and_over(spark):
    docs = corpus(spark, [(1, "ab " * 200_000, "en", "a"), (2, "ab cd " * 50_000, "en", "a"), (3, "ab " * 100, "en", "a")])
    items = spark.createDataFrame([(7, "ab " * 2_000), (8, "cd ab " * 500)], ITEMS)
    rows = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["n_tiles"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert rows == {(1, 7): (2_000, 1), (2, 8): (1_000, 1)}


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = words(rng, 40, 300).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot!", "CLOWN", f"grrak{rng.choice('abcdefgh')}x"]))
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(toxic)))
    out = toxicity.score(corpus(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in out)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    one = next(r for r in held if r["predicted"])
    text = rows[one["doc_id"]][1]
    assert one["spans"] and all(re.match(r"idiot|CLOWN|grrak", text[int(a) : int(z)]) for a, z in (s.split(":") for s in one["spans"].split(",")))


def test_marginals_are_those_of_all_paths():
    tagger = toxicity.Tagger({"bad": 2.0}, -1.0, np.array([[0.3, -0.4], [-0.2, 0.5]]), np.array([0.4, -0.4]))
    text = "a b bad c d e bad bad f".split()
    weight = [tagger.words[w] or 0.0 for w in text]
    total, part = 0.0, np.zeros(len(text))
    for path in range(2 ** len(text)):
        tags = [(path >> i) & 1 for i in range(len(text))]
        s = tagger.start[tags[0]] + sum(t * (tagger.bias + w) for t, w in zip(tags, weight)) + sum(tagger.step[a, b] for a, b in zip(tags, tags[1:]))
        total += math.exp(s)
        part += math.exp(s) * np.array(tags)
    at, m, expected = tagger.tag(text)
    assert at.tolist() == [2, 6, 7] and np.allclose(m, (part / total)[at]) and abs(expected - (part / total).sum()) < 1e-9


def test_expected_number_of_toxic_words():
    rng = random.Random(20)
    tagger = toxicity.Tagger({"bad": 2.0, "good": -1.0}, -1.5, np.array([[0.3, -0.4], [-0.2, 0.5]]), np.array([0.4, -0.4]))
    for n in (0, 1, 2, 70, 500, 3000):
        text = [rng.choice(["bad", "good", *["w"] * rng.choice([2, 60])]) for _ in range(n)] if n != 500 else ["w"] * n
        steps = np.exp(tagger.step)
        emit = [np.array([1.0, math.exp(tagger.bias + (tagger.words[w] or 0.0))]) for w in text]
        forward, backward = [], [np.ones(2)]
        for i, e in enumerate(emit):
            v = e * (np.exp(tagger.start) if i == 0 else forward[-1] @ steps)
            forward.append(v / v.sum())
        for e in reversed(emit[1:]):
            u = steps @ (e * backward[-1])
            backward.append(u / u.sum())
        both = [f * b / (f @ b) for f, b in zip(forward, reversed(backward))] if n else []
        at, m, expected = tagger.tag(text)
        assert abs(expected - sum(b[1] for b in both)) < 1e-6 and np.allclose(m, [both[i][1] for i in at])


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][3]
    rows = [(1, "Text.\nReleased under the MIT License.", "en", "a"), (2, f"a\n{mit.upper()}\nb", "en", "a"), (3, "The driver's license was renewed.", "en", "a"), (4, "mit der Zeit", "de", "a"), (5, "Licensed under CC BY-NC 4.0.", "en", "a")]
    found = {(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licenses.scan(corpus(spark, rows)).collect()}
    assert found == {(1, 1, "MIT", True), (2, 1, "MIT", True), (3, 0, "unknown", False), (5, 0, "CC-BY-NC-4.0", True)}
    families, weights, biases, least = licenses.train()
    for row in licenses.scan(corpus(spark, rows)).collect():  # the same model in plain Python
        line = rows[row["doc_id"] - 1][1].split("\n")[row["paragraph"]]
        z = np.array(biases) + sum((np.array(weights[f]) for f in licenses.py_features(licenses.py_words(line)) if f in weights), np.zeros(len(biases)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p[:-1].max() - row["probability"]) < 1e-5


def test_licenses_by_other_names(spark):
    texts = [
        "Released under GPLv3.", "GPLv2+", "MPLv2", "CC BY 4.0", "This work is available under Creative Commons Attribution 4.0 International.", "Released under MIT terms.",
        "Distributed under the LGPL v2.1.", "AGPL-3.0", "mit der Zeit", "It was the work of a public library.",
    ]
    found = {r["doc_id"]: r["family"] for r in licenses.scan(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert found == dict(enumerate(["GPL-3.0", "GPL-2.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-4.0", "MIT", "unknown", "unknown"]))


def test_license_signals_exclude_no_family():
    families, weights, biases, least = licenses.train()
    signals, k = set(licenses.signals()), len(families) - 1
    rest = [np.array(w) for g, w in weights.items() if not signals & set(g.split(" "))]
    for f in range(k):
        margin = biases[f] - biases[k] + sum(max(w[f] - w[k], 0) for w in rest)
        assert margin < math.log(least / (1 - least))


def test_wrapped_licenses(spark):
    mit, apache, gpl = licenses.TEMPLATES["MIT"][3], licenses.TEMPLATES["Apache-2.0"][3], licenses.TEMPLATES["GPL-3.0"][1]
    texts = ["Intro.\n \n\n" + textwrap.fill(mit, 60) + "\n\nOther text.", textwrap.fill(apache, 50), "Some words\r\n\r\n" + textwrap.fill(gpl, 40).replace("\n", "\r\n")]
    out = licenses.scan(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    sure = {(r["doc_id"], r["paragraph"], r["n_lines"], r["family"], r["template"]) for r in out if r["confirmed"]}
    size = [textwrap.fill(t, n).count("\n") + 1 for t, n in ((mit, 60), (apache, 50), (gpl, 40))]
    assert sure == {(0, 3, size[0], "MIT", 4), (1, 0, size[1], "Apache-2.0", 4), (2, 2, size[2], "GPL-3.0", 2)}


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 40)).astype(np.float32))]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1100, None), (1200, [float("nan")] * 40), (1300, [None] * 40), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows[:702]]
    want = set()
    for q, x in good:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:10]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    for options in ({}, {"query_rows": 3}):
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, **options).collect()} == want
    assert topk.search(df.limit(0)).count() == 0


def naive_ctw(train, texts, depth):
    """log10 probabilities by recursion over contexts."""
    end = b"\xff"
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(text):
        whole = end * depth + text + end
        for i in range(depth, len(whole)):
            for k in range(8):
                yield whole[i - depth : i], (1 << k) | (whole[i] >> (8 - k)), (whole[i] >> (7 - k)) & 1

    for text in train:
        for ctx, node, bit in steps(text):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node][bit] += 1
                if d:
                    children[ctx[depth - d + 1 :], node].add(ctx[depth - d :])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def lnp(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*counts[ctx, node])
            if len(ctx) < depth:
                below = sum(lnp(c, node) for c in children[ctx, node])
                own = np.logaddexp(own, below) - math.log(2)
            memo[ctx, node] = own
        return memo[ctx, node]

    out = []
    for text in texts:
        total = 0.0
        for ctx, node, bit in steps(text):
            guess = None
            for d in range(depth, -1, -1):
                c = ctx[depth - d :]
                n0, n1 = counts[c, node] if (c, node) in counts else (0, 0)
                one = (n1 + 0.5) / (n0 + n1 + 1)
                if guess is None:
                    guess = one
                else:
                    below = sum(lnp(x, node) for x in children.get((c, node), ()))
                    w = 1 / (1 + math.exp(below - kt(n0, n1)))
                    guess = w * one + (1 - w) * guess
            total += math.log10(guess if bit else 1 - guess)
        out.append(total)
    return out


def test_lm_score(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["The", "cat", "sät", "on", "mat"]) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + [None]
    docs = corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    canon = [b" ".join((t or "").encode().lower().split()) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    train = [c for c, h in zip(canon, held) if not h]
    want = naive_ctw(train, canon, 3)
    counts = Counter(w for c in train for w in [*c.split(), "END"])
    total = sum(counts.values())
    for sent in (10**6, 0):
        rows = sorted(lmscore.score(docs, depth=3, sent_rows=sent).collect(), key=lambda r: r["doc_id"])
        for r, score, c, h in zip(rows, want, canon, held):
            seen = [counts[w] for w in [*c.split(), "END"]]
            assert r["held_out"] == h and r["train_tokens"] == total and r["n_tokens"] == len(seen) and r["n_known"] == sum(x > 0 for x in seen)
            assert abs(r["base_score"] - sum(math.log10((x + 1) / (total + len(counts) + 1)) for x in seen)) < 1e-9
            assert abs(r["score"] - score) < 1e-4


def test_lm_score_sees_six_bytes(spark):
    rng = random.Random(12)
    texts = [rng.choice(["abcdefg", "bbcdefh", "cbcdefi"]) for _ in range(40)]
    canon = [t.encode() for t in texts]
    train = [c for i, c in enumerate(canon) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = sorted(lmscore.score(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r["doc_id"])
    assert all(abs(r["score"] - score) < 1e-4 for r, score in zip(rows, naive_ctw(train, canon, 6)))


def test_lm_score_is_the_same_by_either_join(spark):
    rng = random.Random(13)
    docs = corpus(spark, [(i, words(rng, 200, 90), "en", "a") for i in range(20)])
    sent, joined = ({r["doc_id"]: r["score"] for r in lmscore.score(docs, depth=3, sent_rows=n).collect()} for n in (10**6, 0))
    assert all(abs(sent[i] - joined[i]) < 1e-9 for i in sent)


def test_secrets(spark):
    rng = random.Random(6)
    bits = ["token = ", "'", '"', "secret", ":", "=", "=abc", "AKIA", "ABCDEFGHIJKL12", "deadbeef" * 4, "API_KEY", "x" * 9, " ", "ü", "\n", "passwd=", "short", "🎉"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    rows = sorted(secrets.scan(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        listed = [f"{k}:{a}:{z}" for a, _, z, k in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in listed) for k in ("assign", "access", "hex"))
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == listed


def test_weak_parts_count_only_together(spark):
    far = "filler " * 60
    texts = [
        "user = bob\npwd: hunter2!\nhttps://db.example.org/x", "user = bob, nothing else", f"user = bob {far} pwd: hunter2!", "user = bob\n\npwd: hunter2!",
        "see https://example.org only", "login: amy token = abcdefgh12",
    ]
    rows = sorted(secrets.scan(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r["doc_id"])
    assert [r["n_linked"] for r in rows] == [3, 0, 0, 0, 0, 1]
    clean = sorted(secrets.redact(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r["doc_id"])
    assert clean[0]["text"] == "[SECRET]\n[SECRET]\n[SECRET]" and clean[1]["text"] == texts[1] and clean[5]["n_chars"] == len(clean[5]["text"])


def naive_kneser_ney(train, grams, order):
    end = b"\xff"
    tables = [Counter() for _ in range(order + 1)]
    for t in train:
        whole = end * (order - 1) + t + end
        tables[order].update(whole[i - order : i] for i in range(order, len(whole) + 1))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts = {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in tables[k].values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else None
        cuts[k] = [min(max((i + 1) - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 1) for i in range(3)] if all(n) else [0.5, 1.0, 1.5]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = p(g[1:])
        near = [c for x, c in tables[k].items() if x[:-1] == g[:-1]]
        if not sum(near):
            return lower
        cut = lambda c: cuts[k][min(c, 3) - 1] if c else 0
        return (max(tables[k][g] - cut(tables[k][g]), 0) + sum(map(cut, near)) * lower) / sum(near)

    return {g: math.log10(p(g)) for g in grams}


def test_quality(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(5, 30), 50) for _ in range(60)] + ["#### @@@@ %%%% " * 20, None]
    docs = corpus(spark, [(i, t, "en" if i % 2 else None, "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(60, 0, 0)], LABELS)
    order = 3
    raw = [(t or "").encode() for t in texts]
    cut = lambda t: [(b"\xff" * (order - 1) + t + b"\xff")[i : i + order] for i in range(len(t) + 1)]
    price = None
    for sent in (10**6, 0):
        rows = sorted(quality.classify(docs, labels, order=order, sent_rows=sent).collect(), key=lambda r: r["doc_id"])
        learned = [t for r, t in zip(rows, raw) if r["learned"]]
        assert 20 < len(learned) < 40 and all(r["trusted"] == (r["doc_id"] < 40) for r in rows)
        price = price or naive_kneser_ney(learned, {g for t in raw for g in cut(t)}, order)
        assert all(abs(r["logprob"] - sum(price[g] for g in cut(t))) < 1e-6 for r, t in zip(rows, raw))
        assert [r["doc_id"] for r in rows if not r["keep"]] == [60]
    assert all(r["keep"] for r in quality.classify(docs, labels.limit(0), order=order).collect())


def test_quality_threshold_is_a_quantile(spark):
    rng = random.Random(10)
    docs = corpus(spark, [(i, words(rng, rng.randrange(1, 30), 50), "en", "a") for i in range(900)])
    rows = quality.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(800)], LABELS), order=3).collect()
    held = sorted(-r["logprob"] / r["n_words"] for r in rows if r["trusted"] and not r["learned"])
    limit = held[math.ceil(0.99 * len(held)) - 1]
    assert len(held) >= 100 and all(abs(math.log10(r["threshold"]) - limit) < 1e-9 for r in rows)
    assert all(r["keep"] == (-r["logprob"] / r["n_words"] <= limit + 1e-12) for r in rows)


def brute_components(texts, k, similarity):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(8)
    texts = []
    for family in range(4):
        base = words(rng, 120).split()
        for copy in range((90, 6, 3, 1)[family]):
            w = list(base)
            for _ in range(rng.randrange(0, 9) if copy else 0):  # from equal to far
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                del w[: rng.randrange(30)]
            texts.append(" ".join(w))
    texts += ["Two words", "two\tWORDS", "one", "", None, words(rng, 50)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_components(rows, 3, 85)
    out = neardup.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows]), k=3, similarity=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def fill(sizes, weights, cap):
    free, target = set(sizes), {}
    total = sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "ä", "z", "z", "z", "z", None])) for i in range(600)] + [(600, "tiny", "en", "aa")]
    docs = corpus(spark, rows)
    out = mixing.mix(docs, bucket_rows=32).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in out:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    again = mixing.mix(docs, bucket_rows=32).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_round_trip(spark, rule):
    texts = ["One line\nzwei Zeilen\n\n  drei 🎉\n", "x", "", None, "a\r\n\nb"]
    out = sorted(tokens.count(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), rule=rule).collect(), key=lambda r: (r["doc_id"], r["section"]))
    encode, sizes = tokens.encoder(tokens.load(tokens.TOKENIZER))
    for i, t in enumerate(texts):
        mine = [r for r in out if r["doc_id"] == i]
        assert abs(sum(r["n_tokens"] for r in mine) - len(encode(t or ""))) < 1e-9
        assert "".join((t or "")[r["start_char"] : r["end_char"]] for r in mine) == (t or "")
        assert len(mine) == max(1, (t or "").count("\n") + (not (t or "").endswith("\n")))
        assert sum(sizes[encode(t or "")]) == len((t or "").encode())


def shuffled(docs, kind):
    """docs in an order that another run may deal otherwise."""
    return docs.repartition(7) if kind == "repartition" else docs.groupBy(*docs.columns).agg(F.count("*").alias("times")).drop("times")


@pytest.mark.parametrize("kind", ["repartition", "groupBy"])
def test_rows_that_are_not_stored(spark, kind):
    rng = random.Random(14)
    item = words(rng, 25)
    rows = [(i, words(rng, 40) + (f" {item}" if i % 11 == 0 else " password = abcdefgh1" if i % 5 == 0 else ""), "en", "ab"[i % 2]) for i in range(440)]
    docs = shuffled(corpus(spark, rows), kind)
    clean = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert sorted(r["doc_id"] for r in clean) == [i for i in range(440) if i % 11]
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert all(texts[i] == t.replace("password = abcdefgh1", "[SECRET]") for i, t, _, _ in rows)
    plan = {r["doc_id"]: r["whole"] + r["extra"] for r in mixing.mix(corpus(spark, rows)).collect()}
    assert Counter(r["doc_id"] for r in mixing.repeat_rows(docs).collect()) == Counter({i: n for i, n in plan.items() if n})


def test_mixing_stops_at_the_last_repetition(spark):
    docs = corpus(spark, [(i, "" if i % 2 else "one two", "en", "a") for i in range(40)] + [(100 + i, "x " * 50, "en", "b") for i in range(40)])
    for r in mixing.mix(docs, bucket_rows=4).collect():
        assert r["whole"] + r["extra"] <= 3
    out = mixing.repeat_rows(docs.withColumn("repetition", F.lit("mine")), bucket_rows=4)
    assert out.columns[-1] == "repetition_2" and {r["repetition"] for r in out.collect()} == {"mine"} and max(r["repetition_2"] for r in out.collect()) <= 3


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(15)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a + " zz"), (3, b + " zz"), (None, a), (None, words(rng, 60)), (4, " ")]
    out = neardup.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows]), k=3, similarity=85).collect()
    assert sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["first"]) for r in out)) == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_near_duplicates_of_one_class_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIR_ROWS", 4)
    rng = random.Random(16)
    base = words(rng, 80).split()
    rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(40)] + [(100 + i, words(rng, 80)) for i in range(5)]
    out = neardup.near_duplicates(corpus(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, 5, 80)


def linked(parts):
    """Weak candidates that count, by comparing each with all others: parts are (kind, start, end) or breaks."""
    base = [p for p in parts if p[0] in ("assign", "access", "hex")]
    weak = [p for p in parts if p[0] in ("id", "key", "endpoint") and not any(b[1] < p[2] and p[1] < b[2] for b in base)]
    block = lambda p: sum(b[0] == "break" and b[1] < p[1] for b in parts)
    near = lambda p, role: any(
        secrets.ROLE[q[0]] == role and q != p and block(q) == block(p) and min(abs(q[1] - p[2]), abs(p[1] - q[2])) <= secrets.SCOPE_GAP for q in base + weak
    )
    rule = {"id": lambda p: near(p, "secret"), "key": lambda p: near(p, "id") or near(p, "endpoint"), "endpoint": lambda p: near(p, "id") and near(p, "secret")}
    return sorted(base + [p for p in weak if rule[p[0]](p)], key=lambda p: (p[1], p[0]))


def test_linking_by_brute_force(spark):
    rng = random.Random(17)
    kinds = [name for name, _, _ in secrets._KINDS]
    rows, want = [], {}
    for doc in range(60):
        parts, at = [], 0
        for _ in range(rng.randrange(1, 14)):
            at += rng.choice([1, 5, 60, 200, 240, 241, 500])
            kind, size = rng.choice([*kinds, "break"]), rng.randrange(3, 30)
            parts.append((kind, at, at + size))
            at += size
        rows += [(doc, doc, len(kinds) if k == "break" else kinds.index(k), a, z) for k, a, z in parts]
        want[doc] = linked(parts)
    out = defaultdict(list)
    for r in secrets.link(spark.createDataFrame(rows, "rid long, doc_id long, ord int, start long, end long")).collect():
        out[r["doc_id"]].append((kinds[r["ord"]], r["start"], r["end"]))
    assert all(sorted(out[doc], key=lambda p: (p[1], p[0])) == want[doc] for doc in want)


def test_linking_takes_linear_time(spark):
    seconds = []
    for n in (16_000, 64_000):
        docs = corpus(spark, [(1, "user = bob\npwd: hunter2! x\n" * (n // 2), "en", "a")])
        began = time.time()
        assert secrets.scan(docs).first()["n_linked"] == n
        seconds.append(time.time() - began)
    assert seconds[1] < 8 * max(seconds[0], 1.0)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_by_brute_force(spark, rule):
    rng = random.Random(18)
    texts = ["".join(rng.choice(["ab ", "\n", "\n\n", "  ", "wörter", "🎉", "\r\n", "x" * 30, ". "]) for _ in range(rng.randrange(0, 40))) for _ in range(40)] + ["y" * 60_000]
    encode, sizes = tokens.encoder(tokens.load(tokens.TOKENIZER))
    out = defaultdict(list)
    for r in tokens.count(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), rule=rule).collect():
        out[r["doc_id"]].append((r["section"], r["n_tokens"], r["n_crossing"]))
    for i, t in enumerate(texts):
        lines = t.encode().split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [n for n, x in enumerate(lines) for _ in x]
        n, crossing, at = [0.0] * len(lines), [0] * len(lines), 0
        for token in encode(t):
            own = owner[at : at + sizes[token]]
            at += sizes[token]
            crossing[own[0]] += own[0] != own[-1]
            for x in [own[0]] if rule == "start" else [own[-1]] if rule == "end" else own:
                n[x] += 1 if rule != "share" else 1 / len(own)
        assert [(s, round(x, 6), c) for s, x, c in sorted(out[i])] == [(s, round(x, 6), c) for s, (x, c) in enumerate(zip(n, crossing))]


def test_topk_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank long").withColumns({c: F.lit("x") for c in ("query_id", "score", "e")})
    out = topk.search(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 30


def test_counts_are_merged():
    rng = np.random.default_rng(19)
    held, want = _grams.Counts(), Counter()
    for _ in range(40):
        keys = rng.integers(0, 200_000, 60_000)
        weight = int(rng.integers(0, 2))
        held.add(keys, weight)
        want.update({k: n * weight for k, n in Counter(keys.tolist()).items()})
    keys, n = held.flush()
    assert dict(zip(keys.tolist(), n.tolist())) == want and not len(held.flush()[0])


def test_contaminated_by_brute_force(spark):
    rng = random.Random(21)
    items = [(i, words(rng, rng.randrange(2, 12), 9)) for i in range(25)] + [(99, "w1 w2")]
    rows = [(i, words(rng, rng.randrange(0, 60), 9).replace(" ", rng.choice([" ", ", ", "\n"])).upper()) for i in range(60)]
    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = x.split(), re.findall(r"\w+", t.lower())
            covered = greedy(a, b, 3) if len(a) >= 3 else 0
            if len(a) >= 3 and covered >= 0.6 * len(a):
                want[d, i] = covered
    out = decontaminate.contaminated(corpus(spark, [(i, t, "en", "a") for i, t in rows]), spark.createDataFrame(items, ITEMS), block_words=60).collect()
    assert {(r["doc_id"], r["item_id"]): r["covered_words"] for r in out} == want and len(want) > 50
    clean = decontaminate.decontaminate(corpus(spark, [(i, t, "en", "a") for i, t in rows]), spark.createDataFrame(items, ITEMS))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in want}


def naive_licenses(text):
    """(paragraph, lines, family, template, confirmed) by scoring every line and every paragraph of several lines."""
    families, weights, biases, least = licenses.train()
    units = [(i, 1, line) for i, line in enumerate(text.split("\n"))]
    block = []
    for i, line in enumerate([*text.split("\n"), ""]):
        if line.strip() and i < len(units):
            block.append(i)
        else:
            if len(block) > 1:
                units.append((block[0], len(block), "\n".join(units[j][2] for j in block)))
            block = []
    found = []
    for at, n, unit in units:
        w = licenses.py_words(unit)
        z = np.array(biases) + sum((np.array(weights[f]) for f in sorted(licenses.py_features(w)) if f in weights), np.zeros(len(biases)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        known = p[:-1].max() >= least and z[-1] <= z[:-1].max()
        family = families[int(z[:-1].argmax())] if known else "unknown"
        if family == "unknown":
            if n == 1 and any(licenses._anchored(x) for x in w):
                found.append((at, n, family, 1, False))
            continue
        own = set(licenses._shingles(w))
        alike = [len(own & set(form)) / len(form) for form in (licenses._shingles(licenses.py_words(t)) for t in licenses.TEMPLATES[family])]
        found.append((at, n, family, int(np.argmax(alike)) + 1, max(alike) >= 0.8))
    lines = [f for f in found if f[1] == 1]
    own = lambda f: [x for x in lines if x[2] == f[2] and f[0] <= x[0] < f[0] + f[1]]
    return sorted(lines + [f for f in found if f[1] > 1 and not any(x[4] or not f[4] for x in own(f))])


def test_licenses_by_brute_force(spark):
    rng = random.Random(22)
    passages = [t for own in licenses.TEMPLATES.values() for t in own] + [t for own in licenses.NAMES.values() for t in own] + list(licenses.OTHERS)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice([rng.choice(passages), words(rng, 12)])
            if rng.random() < 0.3:
                t = " ".join(w for w in t.split() if rng.random() < 0.8)
            parts.append(textwrap.fill(t, rng.choice([30, 60, 10_000])) if t else "")
        texts.append(rng.choice(["\n", "\n\n", "\n \n"]).join(parts))
    texts += ["", "Released under the MIT License.\n" * 2]  # repeated lines
    got = defaultdict(list)
    for r in licenses.scan(corpus(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect():
        got[r["doc_id"]].append((r["paragraph"], r["n_lines"], r["family"], r["template"], r["confirmed"]))
    for i, t in enumerate(texts):
        mine, want = sorted(got[i]), naive_licenses(t)
        strip = lambda rows: [x if x[2] != "unknown" else (*x[:3], 0, x[4]) for x in rows]
        assert strip(mine) == strip(want), t

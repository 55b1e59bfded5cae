"""The pipeline on a small corpus with planted cases."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from test_operators import brute_components, greedy, naive_kneser_ney

from registerloom.llm import decontaminate, mixing, quality, queries, secrets


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows = [(i, words(60), "en", f"s{i % 3}") for i in range(120)]
    item = words(20)
    rows += [(200, rows[4][1], "en", "s0"), (201, words(30) + " " + item, "en", "s1"), (202, words(300) + " token = abcdefgh1234", "en", "s2"), (203, "%%% ### $$$ " * 40, "en", "s0"), (5, rows[5][1], "en", "s2"), (None, words(60), "en", "s0"), (204, None, "en", "s1")]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(str(tmp_path / ("documents.parquet" if k == 0 else f"{k}"))), str(tmp_path)).write.parquet(str(tmp_path / f"{k + 1}"))
        current = spark.read.parquet(str(tmp_path / f"{k + 1}"))
        seen[name] = current.collect()
        assert current.columns[:5] == docs.columns
    ids = {name: [r["doc_id"] for r in out] for name, out in seen.items()}
    assert 203 not in ids["quality"] and {200, 201, 202, None} <= set(ids["quality"])
    assert 200 not in ids["near_duplicates"] and ids["near_duplicates"].count(5) == 1 and None in ids["near_duplicates"]
    assert 201 not in ids["decontamination"] and len(ids["decontamination"]) == len(ids["near_duplicates"]) - 1
    assert len(ids["secrets"]) == len(ids["decontamination"]) and all("abcdefgh1234" not in (r["text"] or "") for r in seen["secrets"])
    assert set(ids["mixing"]) <= set(ids["secrets"]) and max(r["repetition"] for r in seen["mixing"]) <= 3


def test_stages_by_brute_force(spark, tmp_path, monkeypatch):
    """Each stage's decisions on what the one before kept, by plain Python."""
    monkeypatch.setattr(quality.classify, "__defaults__", (3, *quality.classify.__defaults__[1:]))  # shorter n-grams
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    texts = [words(rng.randrange(5, 40)) for _ in range(150)]
    item = words(12)
    texts += [" ".join([*t.split()[:-1], "end"]) for t in texts[:30]] + [words(9) + " " + item for _ in range(5)] + ["%$# " * 30, "", words(20) + " token=abcdefgh99 user: bob"]
    rows = [(i, t, "en", "xyz"[i % 3], len(t)) for i, t in enumerate(texts)] + [(None, texts[3], "de", None, 1), (7, texts[8], "en", "x", 1), (500, None, None, "x", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept.append([tuple(r) for r in docs.collect()])
    key = lambda r: tuple(map(repr, r))

    # quality: probabilities by a plain model of the documents that were learned from, thresholds by hand
    judged = quality.classify(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    text_of = {(r[0], r[1]): r for r in rows}
    learned = [(t or "").encode() for i, t, *_ in rows if any(j["doc_id"] == i and j["learned"] for j in judged)]
    raw = {t: (t or "").encode() for _, t, *_ in rows}
    cut = lambda t: [(b"\xff" * 2 + t + b"\xff")[i : i + 3] for i in range(len(t) + 1)]
    price = naive_kneser_ney(learned, {g for t in raw.values() for g in cut(t)}, 3)
    log = {t: (-sum(price[g] for g in cut(b)), len(b.split()) + 1) for t, b in raw.items()}
    held = [(la, *log[t]) for i, t, la, *_ in rows for j in [next(j for j in judged if j["doc_id"] == i)] if j["trusted"] and not j["learned"]]

    def least(values, q):
        return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]

    def limits(lang):
        own = [(p, n) for la, p, n in held if la == lang] or None
        mean = sum(p for p, n in own or [x[1:] for x in held]) / sum(n for p, n in own or [x[1:] for x in held])
        return own, mean

    def mixed(p, n, mean):
        return (p + quality.PRIOR_WORDS * mean) / (n + quality.PRIOR_WORDS)

    def good(r):
        own, mean = limits(r[2])
        every = own or [x[1:] for x in held]
        values = [mixed(p, n, mean if own else limits(la)[1]) for (p, n), la in zip(every, [r[2]] * len(every) if own else [x[0] for x in held])]
        at = lambda q: least(values, q)
        return mixed(*log[r[1]], mean) <= at(0.5) + quality.SPREAD * (at(0.95) - at(0.5)) + 1e-9

    assert sorted(kept[0], key=key) == sorted((r for r in rows if good(r)), key=key) and text_of

    # near duplicates: one row of each component stays, of the least id
    numbered = list(enumerate(kept[0]))
    order = sorted(numbered, key=lambda x: (x[1][0] is None, x[1][0] or 0))
    roots = brute_components([(n, r[1]) for n, (_, r) in enumerate(order)], 5, 80)
    stay = [r for n, (_, r) in enumerate(order) if roots[n][1] == n]
    assert sorted(r[0] or -1 for r in kept[1]) == sorted(r[0] or -1 for r in stay) and len(kept[1]) < len(kept[0])

    # decontamination, secrets, mixing
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    bad = lambda t: greedy(tokens(item), tokens(t), decontaminate.TILE_WORDS) >= decontaminate.COVERAGE * len(tokens(item))
    assert sorted(kept[2], key=key) == sorted((r for r in kept[1] if not bad(r[1])), key=key)
    spans = {(r["doc_id"], r["spans"]) for r in secrets.scan(spark.read.parquet(str(tmp_path / "2"))).collect() if r["spans"]}
    want = []
    for r in kept[2]:
        t = r[1]
        for span in [s for i, found in spans if i == r[0] for s in reversed(found.split(","))]:
            a, z = map(int, span.split(":")[1:])
            t = t[:a] + "[SECRET]" + t[z:]
        want.append((r[0], t, *r[2:4], r[4] if t == r[1] else len(t)))
    assert sorted(kept[3], key=key) == sorted(want, key=key)
    plan = Counter()
    for r in mixing.mix(spark.read.parquet(str(tmp_path / "3"))).collect():
        plan[r["doc_id"]] += r["whole"] + r["extra"]
    assert Counter(r[0] for r in kept[4]) == +plan


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ("rid", "keep", "first", "repetition", "__loom_rid", "n", "score")
    rows = [(i, f"some words of document {i} and more of them {i * 7}", "en", "a", 1) for i in range(12)]
    for name, some in (("none", []), ("some", rows)):
        folder = tmp_path / name
        df = spark.createDataFrame(some, schema)
        for c in clash[:4] + clash[5:]:
            df = df.selectExpr("*", f"'mine' as {c}")
        df.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [*df.columns, "repetition_2"] and {r["repetition"] for r in out.collect()} == ({"mine"} if some else set())


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))

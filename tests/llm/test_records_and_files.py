"""Golden records, importance resampling and token files against brute force, and their edge cases."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registerloom.llm import golden, importance, tokenfiles, topk

SF = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def brute_golden(rows):
    trust = {s: 4 - i for i, s in enumerate(golden.TRUST)}
    text = lambda x: x if x and x.strip(" \t\n\v\f\r") else None
    groups = defaultdict(list)
    for r in rows:
        groups[r["client_id"] if r["master_id"] is None else r["master_id"]].append(r)
    out = []
    for cluster, own in groups.items():
        latest = max((r["updated_at"] for r in own if r["updated_at"]), default=None)
        fresh = lambda r: bool(r["updated_at"]) and latest - r["updated_at"] <= dt.timedelta(days=60)  # noqa: B023, E731
        low = dt.datetime.min
        recent = lambda r: (r["updated_at"] is not None, r["updated_at"] or low, trust.get(r["source"], 0), r["client_id"] is not None, -(r["client_id"] or 0))
        trusted = lambda r: (fresh(r), trust.get(r["source"], 0), *recent(r))  # noqa: B023, E731
        best = lambda f, key: max(((key(r), r[f], r["client_id"]) for r in own if f == "balance" and r[f] is not None or f != "balance" and text(r[f])), default=(None, None, None))[1:]  # noqa: B023, E731
        segment, email, name = best("segment", recent), best("email", trusted), best("name", lambda r: (len(r["name"]), *trusted(r)))  # noqa: B023
        balance = best("balance", lambda r: (text(r["segment"]) is not None and text(r["segment"]) == segment[0], *recent(r)))  # noqa: B023
        a = max(own, key=lambda r: ((text(r["city"]) is not None) + (r["nation_id"] is not None), *trusted(r)))
        placed = text(a["city"]) is not None or a["nation_id"] is not None
        cents = None if balance[0] is None or not abs(balance[0]) < 9e16 else math.floor(100 * balance[0] + 0.5)
        out.append((cluster, len(own), sum(not fresh(r) for r in own), name[0], email[0], segment[0], text(a["city"]), a["nation_id"], cents, name[1], email[1], segment[1], balance[1], a["client_id"] if placed else None))
    return Counter(out)


def test_golden_brute_force(spark):
    clients = spark.read.parquet(f"{SF}/clients.parquet")
    for hot in (golden.HOT_CLUSTERS, 1, 10**9):  # none, few and all clusters hot
        assert Counter(map(tuple, golden.golden_records(clients, hot_clusters=hot).collect())) == brute_golden([r.asDict() for r in clients.collect()])


def test_golden_edges(spark):
    at = lambda *x: dt.datetime(2024, *x)
    rows = [
        (1, None, "store", at(1, 1), "Ann", "a@x", "Ulm", 3, " ", 1.005),
        (2, 1, "crm", at(3, 1), "Änn B", "", None, None, "retail", None),  # exactly 60 days after the first
        (3, 1, "web", None, "Ann C", "c@x", "\t", 4, None, float("nan")),
        (4, 4, None, at(1, 1), None, None, None, None, None, -0.005),
        (4, 4, None, at(1, 1), None, None, None, None, None, -0.005),  # the row again
        (5, 5, "crm ", at(1, 1, 0, 0, 0, 1), "x", "e@x", "B", 1, "online", 2.0),
        (6, 5, "partner", at(3, 1, 0, 0, 0, 2), "y", "f@x", "A", 2, "public", 3.0),  # 60 days and one microsecond later
        (None, None, "crm", None, "nobody", None, None, None, "retail", 1e300),
        (None, None, "crm", None, "anybody", None, None, None, "retail", 7.0),
    ]
    clients = spark.createDataFrame(rows, CLIENTS).withColumn("cluster_id", F.lit("clash")).withColumn("latest", F.lit(1))
    got = golden.golden_records(clients)
    assert Counter(map(tuple, got.collect())) == brute_golden([r.asDict() for r in clients.collect()])
    by = {r.cluster_id: r for r in got.collect()}
    assert (by[1].n_stale, by[1].email, by[1].name, by[1].city, by[1].nation_id, by[1].balance_cents) == (1, "a@x", "Änn B", "Ulm", 3, 100)
    assert (by[4].n_records, by[4].balance_cents, by[4].address_from, by[5].n_stale, by[5].email) == (2, 0, None, 1, "f@x")
    assert (by[None].n_records, by[None].name, by[None].balance_cents, by[None].name_from) == (2, "anybody", None, None)
    assert golden.golden_records(clients.limit(0)).count() == 0


def test_golden_zones(spark):
    """A timestamp with a zone counts hours as they pass, one without a zone as they are written; both across a change of clocks."""
    rows = [(1, 1, "crm", dt.datetime(2024, 2, 1), "a", "a", "a", 1, "a", 1.0), (2, 1, "web", dt.datetime(2024, 4, 1), "b", "b", "b", 2, "b", 2.0)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        plain = spark.createDataFrame(rows, CLIENTS)
        assert golden.golden_records(plain).first().n_stale == 0  # 60 days
        zoned = plain.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        assert golden.golden_records(zoned, stale_hours=60 * 24 - 1).first().n_stale == 0  # one hour less
        assert golden.golden_records(plain, stale_hours=60 * 24 - 1).first().n_stale == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def brute_resample(docs, target, longest=2, buckets=10_000, min_words=20, percent=25, seed=7):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in runs(words(x))), Counter(bucket(f) for x in target for f in runs(words(x)))
    n_s, n_t, out = s.total(), t.total(), []
    for doc_id, text in docs:
        w = words(text)
        gains = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (n_s + buckets) / ((s[bucket(f)] + 1) * (n_t + buckets)))) for f in runs(w)]
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append([doc_id, len(w), len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r, place.get(id(r))) for r in out)


def test_resample_brute_force(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert Counter(map(tuple, importance.resample(docs, items).collect())) == want
    monkeypatch.setattr(importance, "PIECE_BYTES", 7)
    pieces = [w for piece in importance._words("Ab, cd-Éf  GH9\x00ü x" * 3) for w in piece]
    assert pieces == re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ("ab, cd-Éf  gh9\x00ü x" * 3).encode())


def test_resample_edges(spark):
    long = " ".join(f"w{i % 50}" for i in range(50_000))
    rows = [(1, "a b a b"), (None, "a b"), (None, None), (2, ""), (3, "!!"), (4, long), (5, "a b"), (6, "Aİ a"), (7, "ein")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("clash"), "row": F.lit(1)})
    target = spark.createDataFrame([("a b",), (None,)], "text string")
    for longest in (1, 2, 3):
        got = importance.resample(docs, target, longest=longest, min_words=2, percent=50)
        assert Counter(map(tuple, got.collect())) == brute_resample(rows, ["a b", None], longest, min_words=2, percent=50)
    twice = importance.resample(docs.union(docs), target, min_words=1, percent=100)
    assert sorted(r["rank"] for r in twice.collect() if r["rank"]) == list(range(1, 13))  # repeated rows, each with a place
    assert importance.resample(docs.limit(0), target).count() == 0
    assert Counter(map(tuple, importance.resample(docs, target.limit(0), min_words=0).collect())) == brute_resample(rows, [], min_words=0)


def test_scores_beyond_exact_numbers_are_errors(spark):
    rows = lambda big: spark.createDataFrame([(100, [big, 1.0]), (1, [big, 0.5])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.search(rows(1000.0)).collect()] == [1024000**2 + 512 * 1024]
    with pytest.raises(Exception, match="no double holds exactly"):
        topk.search(rows(1e6)).collect()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_pieces_have_the_ids_of_whole_texts(tokenizer):
    own, rng = tokenfiles.Encoder(open(TOKENIZER).read()), random.Random(5)
    parts = ["a", "É", "ß", "'s", "'ll", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x1c", "!", "1", "中", "\U0001f642", "ā", "<|endoftext|>", "\r\n", "don't", "x.y_z", "̀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [[*w, 0] for w in want]
    assert [own._single(t).tolist() for t in texts if t] == [[*w, 0] for t, w in zip(texts, want) if t]


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for n, high in ((1, 5), (2, 2), (1000, 1), (5000, 3), (20_000, 400)):
        ids = rng.integers(0, high, n)
        ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        left, right, lengths, seq, to = tokenfiles.compress(ids, ends, 500)
        assert (tokenfiles.expand(seq, left, right, lengths, 500) == ids).all()
        assert n < 1000 or len(seq) + 2 * len(left) < n
        for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends)):
            own = seq[to[i - 1] if i else 0 : to[i]]
            for start, stop in ((0, z - a), (3, 8), (z - a - 1, z - a), (2, 2)):
                assert tokenfiles.span(own, left, right, lengths, 500, start, min(stop, z - a)).tolist() == ids[a:z][start:stop].tolist()
    left, *_ = tokenfiles.compress(np.zeros(4096, np.int64), np.array([4096]), 10)
    assert len(left) >= 9  # a run halves with each rule


def test_token_files(spark, tokenizer, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"file://{tmp_path}/ids"
    tokenfiles.write(docs, path, TOKENIZER, block_ids=5000, shard_bytes=50_000)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])
    assert spark.read.parquet(path).count() > 20
    got = sorted(map(tuple, tokenfiles.digests(spark, path, TOKENIZER).collect()))
    assert got == [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x, s in zip(rows, ids, starts.tolist())]
    assert [r.ids for r in sorted(tokenfiles.read(spark, path, TOKENIZER).collect())] == ids
    some = [d for d, _ in rows[3:180:70]]
    by = dict(zip((d for d, _ in rows), ids))
    assert {r.doc_id: r.ids for r in tokenfiles.fetch(spark, path, TOKENIZER, some, 5, 40).collect()} == {d: by[d][5:40] for d in some}
    plan = tokenfiles.fetch(spark, path, TOKENIZER, some, 5, 40)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(first_doc" in plan  # blocks without these documents are not read


def test_token_file_edges(spark, tokenizer, tmp_path):
    rows = [(2, "b b b"), (None, "n"), (1, None), (1, ""), (3, "x " * 30_000), (2, "b b b"), (-5, "\n\n a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("clash"), "shard": F.lit(9)})
    path = f"file://{tmp_path}/edges"
    tokenfiles.write(docs, path, TOKENIZER, block_ids=100)
    got = sorted(tokenfiles.read(spark, path, TOKENIZER).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert [(r.doc_id, r.ids) for r in got] == [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in ordered]
    tokenfiles.write(docs.limit(0), f"file://{tmp_path}/none", TOKENIZER)
    assert tokenfiles.digests(spark, f"file://{tmp_path}/none", TOKENIZER).count() == 0

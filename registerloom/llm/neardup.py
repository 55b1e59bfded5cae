"""Near duplicates by circulant MinHash: banding, exact Jaccard verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rows import checked_broadcast, discard, hash_words, hold, lean, mix, numbered, save

SHINGLE_WORDS = 5
SIMILARITY = 80  # per cent
#: A pair at Jaccard 0.8 shares no band with probability (1 - 0.8**6)**40 = 6e-6, at 0.85 with 6e-9.
BANDS, BAND_ROWS = 40, 6
#: Sets in one block of a dense cluster, on average.
BLOCK = 256
#: Pairs of one class that meet its set in one task.
PAIR_ROWS = 1024
_CHUNK, _CACHED = 4 << 20, 1 << 15


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, 64-bit hashes in order, one text after the other, and the sets' sizes.

    texts: words joined by single spaces. With fewer than k words the whole sequence is the one shingle.
    """
    buf = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    words, ends = hash_words(buf)
    last = np.flatnonzero(buf[ends] == 255)  # the last word of each text
    first = np.concatenate([[0], last[:-1] + 1])
    sets, sizes = [], np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        run = words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            run = mix(run) + words[j : len(words) - k + 1 + j]
        run = mix(run)
        for i, text in enumerate(texts):
            if not text:
                continue
            a, z = first[i], last[i] + 1
            if z - a >= k:
                got = np.sort(run[a : z - k + 1])
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
            else:
                got = _short(words[a:z])
            sets.append(got)
            sizes[i] = len(got)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def _short(words: np.ndarray) -> np.ndarray:
    x = words[:1].copy()
    for j in range(1, len(words)):
        x = mix(x) + words[j : j + 1]
    return mix(x + np.uint64(len(words)))


def circulant_bands(flat: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets.

    The first permutation places a shingle on a circle of 2**32 positions; the second one, shifted by j positions,
    gives coordinate j of the signature: the least value over the set.
    """
    keys = np.empty((len(sizes), bands), np.uint64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):  # as many sets at a time as stay in the processor's cache
        lo = ends[a] - sizes[a]
        z = max(a + 1, int(np.searchsorted(ends, lo + _CACHED, side="right")))
        _band_keys((flat[lo : ends[z - 1]] >> np.uint64(32)).astype(np.uint32), (ends[a:z] - sizes[a:z] - lo).astype(np.int64), rows, keys[a:z])
        a = z
    return keys


def _band_keys(place: np.ndarray, starts: np.ndarray, rows: int, keys: np.ndarray) -> None:
    v, w = np.empty_like(place), np.empty_like(place)
    with np.errstate(over="ignore"):
        for b in range(keys.shape[1]):
            key = np.full(len(starts), np.uint64(b + 1))
            for r in range(rows):
                np.add(place, np.uint32(b * rows + r), out=v)
                for factor, shift in ((0x9E3779B1, 15), (0x85EBCA77, 13), (0xC2B2AE3D, 0)):
                    np.multiply(v, np.uint32(factor), out=v)
                    if shift:
                        np.right_shift(v, np.uint32(shift), out=w)
                        np.bitwise_xor(v, w, out=v)
                key = mix(key) + np.minimum.reduceat(v, starts)
            keys[:, b] = mix(key)


def _canonical(column: pa.Array) -> list[bytes]:
    return [b" ".join(t.encode().lower().split()) if t else b"" for t in column.to_pylist()]


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) < _CHUNK):
            held += len(texts[to])
            to += 1
        yield slice(at, to)
        at = to


def _signer(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _canonical(batch.column("text"))
            for part in _chunks(texts):
                flat, sizes = shingle_sets(texts[part], k)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                prints = _prints(flat, cuts)
                new = {}  # one signature for equal sets
                for i, p in enumerate(prints):
                    if p is not None:
                        new.setdefault(p, i)
                own = list(new.values())
                keys = circulant_bands(np.concatenate([flat[cuts[i] : cuts[i + 1]] for i in own]), sizes[own], bands, rows) if own else None
                at = {i: j for j, i in enumerate(own)}
                sig = [keys[at[i]].tobytes() if i in at else None for i in range(len(prints))]
                same = [batch.column(c)[part.start : part.stop] for c in ("doc_id", "rid")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(sizes), pa.array(prints, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "rid", "n", "print", "sig"])

    return sign


def _spread(bands: int):
    def spread(batches):
        for batch in batches:
            n = batch.num_rows
            keys = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64)
            take = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(keys), take("cls"), take("n")], ["key", "cls", "n"])

    return spread


def _prints(flat: np.ndarray, cuts: np.ndarray) -> list[bytes | None]:
    """A digest of each set, None for an empty one."""
    return [hashlib.blake2b(flat[a:z].tobytes(), digest_size=16).digest() if z > a else None for a, z in zip(cuts, cuts[1:])]


def _setter(k: int):
    def sets(batches):
        for batch in batches:
            texts = _canonical(batch.column("text"))
            for part in _chunks(texts):
                flat, sizes = shingle_sets(texts[part], k)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([batch.column("cls")[part.start : part.stop], pa.array([flat[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], ["cls", "shingles"])

    return sets


def _verifier(similarity: int):
    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, cls) of every set."""
    for batch in batches:
        parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        if parts:
            owners = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), [len(x) for x in parts])
            flat = np.concatenate(parts)
            for at in range(0, len(flat), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 17)]), pa.array(owners[at : at + (1 << 17)])], ["shingle", "cls"])


def _blocks(similarity: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of sets (or within one) of different components, counted by products of 0/1 matrices."""
        left, right = pdf[pdf["block"] == pdf["i"]], pdf[pdf["block"] == pdf["j"]]
        shingles, inverse = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["shingles"]]), return_inverse=True)
        shared = np.bincount(inverse, minlength=len(shingles)) > 1
        column = np.where(shared, np.cumsum(shared) - 1, -1)
        sides = []
        for side in (left, right):
            sets = [column[np.searchsorted(shingles, np.frombuffer(x, np.uint64))] for x in side["shingles"]]
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            col = np.concatenate(sets) if sets else np.empty(0, np.int64)
            sides.append((row[col >= 0], col[col >= 0]))
        both = np.zeros((len(left), len(right)), np.float64)
        for at in range(0, int(shared.sum()), 4096):
            m = []
            for (row, col), n in zip(sides, both.shape):
                here = (col >= at) & (col < at + 4096)
                x = np.zeros((n, 4096), np.float32)
                x[row[here], col[here] - at] = 1
                m.append(x)
            both += m[0] @ m[1].T
        n, k = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
        a, b = left["cls"].to_numpy(), right["cls"].to_numpy()
        good = (100 * both >= similarity * (n + k - both)) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
        x, y = np.nonzero(good)
        return pd.DataFrame({"a": np.minimum(a[x], b[y]), "b": np.maximum(a[x], b[y])}).drop_duplicates()

    return links


def beside(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """df with aggregates over all rows of one key: combined before they are shuffled, and sent to where the rows are if there
    are few enough, so that a key that many rows share is no task of its own, as it would be in a window."""
    per = save(df.groupBy(F.col(key).alias("__key")).agg(*[c.alias(n) for n, c in aggs.items()]))
    return df.join(checked_broadcast(per), F.col(key) == F.col("__key")).drop("__key")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node that it is connected with.

    Rounds of large-star and small-star; each shortens the paths, and the edges never grow in number.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), keep=True)
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = beside(both, "u", m=F.least(F.min("v"), F.col("u"))).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = beside(large, "u", m=F.min("v"))
        new = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = save(new, keep=True)
        now = mark(new)
        discard(edges)
        edges, seen, last = new, now, seen
        if seen == last:
            break
    hold(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, rid, first.

    Texts are words with A-Z in lower case; a document's set is its distinct k-word shingles. Documents are linked when
    100 * intersection >= similarity * union of the full sets; a component's id is its smallest doc_id.

    Equal sets are one class first, so copies never meet pairwise. Classes that share a band key are candidates. What only
    one candidate has is in no intersection, so the sizes without it rule pairs out, and whole classes, before any set is
    read. In each bucket all members are first verified against one centre, the member with most in common with others.
    Then every remaining pair of a bucket that is not connected yet is verified: pair by pair where there are few, or block
    by block in clusters whose buckets overlap so much that all pairs of the cluster are fewer. No bucket is capped.

    rid numbers the rows of docs as read; first tells the one row of each component (smallest doc_id, then rid) that stands
    for it, so that a filter on it keeps one row of each group whatever the ids.

    Nulls: a null or blank text has no shingles and is linked with nothing (its row is first). A row with null doc_id is
    linked by its text like any other; kept is false, component_id null if no row of its component has an id, and only then
    can it be first. Rows with one doc_id and different texts are documents of their own that share an id: each is linked by its own
    text. Repeated rows get the same component. Fewer than k words make one shingle of all. An empty table gives no rows;
    other columns are ignored.
    """
    inputs = numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "rid")
    signed = save(inputs.mapInArrow(lean(_signer(k, bands, rows)), "doc_id long, rid long, n long, print binary, sig binary"))
    classes = signed.filter("n > 0").groupBy("print").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least"))
    classes = save(classes.withColumn("cls", F.monotonically_increasing_id()))
    buckets = save(classes.mapInArrow(lean(_spread(bands), 8192), "key long, cls long, n long"))
    met = buckets.groupBy(F.col("key").alias("met")).agg(F.count("*").alias("c")).filter("c > 1").select("met")
    buckets = save(buckets.join(checked_broadcast(save(met)), F.col("key") == F.col("met"), "left_semi"))
    # the text of one row of each candidate class is read again for its set
    wanted = save(classes.join(checked_broadcast(save(buckets.select("cls").distinct())), "cls", "left_semi").select(F.col("least.rid").alias("rid"), "cls"))
    part = inputs.join(checked_broadcast(wanted), "rid").select("cls", "text")
    sets = save(part.mapInArrow(lean(_setter(k)), "cls long, shingles binary"))
    alone = sets.mapInArrow(lean(_shingler, 4096), "shingle long, cls long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).filter("c = 1")
    alone = save(alone.groupBy("cls").agg(F.count("*").alias("own")))
    buckets = buckets.join(checked_broadcast(alone), "cls", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    buckets = save(beside(buckets.filter(100 * F.col("common") >= similarity * F.col("n")), "key", met=F.count("*")).filter("met > 1").select("key", "cls", "n", "common"))

    def split(pairs: DataFrame, side: str) -> DataFrame:
        """Classes of many pairs, and in how many parts their pairs are dealt; the set goes to each part."""
        parts = pairs.groupBy(F.col(side).alias("of")).agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts"))
        return checked_broadcast(save(parts.filter("parts > 1")))

    def with_set(pairs: DataFrame, many: DataFrame, side: str, other: str, name: str) -> DataFrame:
        of = F.coalesce("parts", F.lit(1))
        left = pairs.join(many, F.col(side) == F.col("of"), "left").withColumn("part", F.pmod(F.xxhash64(other), of).cast("int")).drop("of", "parts")
        right = sets.join(many, F.col("cls") == F.col("of"), "left").select(F.col("cls").alias(side), F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), F.col("shingles").alias(name))
        return left.join(right, [side, "part"]).drop("part")

    def verified(pairs: DataFrame) -> DataFrame:
        """Which of the distinct pairs (a, b) are links."""
        pairs = save(pairs)
        many_a, many_b = split(pairs, "a"), split(pairs, "b")
        both = with_set(with_set(pairs, many_a, "a", "b", "x"), many_b, "b", "a", "y").select("a", "b", "x", "y")
        return both.mapInArrow(lean(_verifier(similarity)), "a long, b long")

    def possible(x: str, y: str):
        """Whether the sizes allow a link: an intersection holds at most what either has in common with any other."""
        most = F.least(f"{x}common", f"{y}common")
        return 100 * most >= similarity * (F.col(f"{x}n") + F.col(f"{y}n") - most)

    centre = F.max(F.struct((2 * F.col("common") - F.col("n")).alias("score"), (-F.col("cls")).alias("minus"), "cls", "n", "common"))
    pairs = beside(buckets, "key", c=centre).filter(F.col("c.cls") != F.col("cls")).filter(possible("", "c."))
    roots = components(verified(pairs.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()))
    state = buckets.join(checked_broadcast(roots), F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    state = save(beside(state, "key", lo=F.min("root"), hi=F.max("root"), first=F.min("cls"), size=F.count("*")).filter("lo <> hi"))
    if state.limit(1).count():
        clusters = components(state.select(F.col("first").alias("a"), F.col("cls").alias("b")))
        state = save(_clustered(state, clusters))
        weight = state.groupBy("cluster").agg(F.sum("size").alias("in_buckets"), F.count_distinct("cls").alias("members"))
        dense = save(weight.filter(f"in_buckets > members * members or members > {BLOCK} and in_buckets >= members * members").select(F.col("cluster").alias("dense"), F.ceil(F.col("members") / BLOCK).cast("int").alias("n_blocks")))
        of_dense = F.col("cluster") == F.col("dense")
        few = state.join(checked_broadcast(dense), of_dense, "left_anti")
        x, y = few.alias("x"), few.alias("y")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & possible("x.", "y."))
        links = verified(pairs.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
        many = state.join(checked_broadcast(dense), of_dense).select("cluster", "cls", "root", "n", "n_blocks").distinct()
        many = many.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("n_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        many = many.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(sets, "cls")
        links = links.unionByName(many.groupBy("cluster", "i", "j").applyInPandas(_blocks(similarity), "a long, b long"))
        links = links.join(_named(roots, "a"), "a", "left").join(_named(roots, "b"), "b", "left")
        links = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = classes.select("print", "cls", "least").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = beside(rooted, "root", best=F.min("least")).select("print", "best")
    out = signed.select("doc_id", "rid", "n", "print").join(rooted, "print", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"), "rid", F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("first"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "rid", "first")


def _clustered(state: DataFrame, clusters: DataFrame) -> DataFrame:
    """state with cluster: the least class that its buckets connect each class with."""
    found = clusters.select("node", F.col("root").alias("cluster"))
    return state.join(checked_broadcast(found), F.col("cls") == F.col("node"), "left").withColumn("cluster", F.coalesce("cluster", "cls")).drop("node")


def _named(roots: DataFrame, name: str) -> DataFrame:
    return roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))


#: near_duplicates(k=3, similarity=85) without rid and first in DuckDB SQL, for tables whose ids are not repeated.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), g AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.root = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id, s.s
"""

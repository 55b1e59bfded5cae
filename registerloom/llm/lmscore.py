"""Language-model scores by context-tree weighting over byte contexts.

Counts and prices of n-grams travel in shards: one row holds thousands of keys and numbers as bytes, so that neither the
shuffle nor the JVM handles them one by one. An n-gram's shard goes by its three nearest bytes of context, so that whole
subtrees of contexts meet, and there are the more shards the more text there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, dealt, look_up, numbers, shard_keys, shards_for, table, text_size
from ._grams import Counts, Table, _group, codes, pieces
from ._rows import hash_words, lean, numbered, save, send

#: Bytes of context of the deepest nodes.
DEPTH = 6
#: Bytes of context by which n-grams are dealt; the trees above are made of the shards' sums.
TOP = 3
#: Prior weight of the deeper contexts at a node.
SPLIT = 0.5
_PRIOR = np.log(SPLIT / (1 - SPLIT))
#: Key of the end of a text among the words.
END_WORD = -1
_NODES = 256
#: Prices and word counts that may be sent to the executors: at most 16 bytes each, so under 256 MB.
SENT_ROWS = 16_000_000
#: N-grams that a task holds before it passes them on, and that are weighted at a time.
HELD, WEIGHTED = 2_000_000, 1 << 16
GRAM, WORD = 0, 1


def held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id as text, modulo 7, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def canonical(texts: list[str | None]) -> list[bytes]:
    """What the model codes: the words with A-Z in lower case, one space between them."""
    return [b" ".join(t.encode().lower().split()) if t else b"" for t in texts]


def _word_keys(buf: np.ndarray) -> np.ndarray:
    """Keys of the words of canonical texts that each end with 0xFF; the end itself is counted apart."""
    hashes, ends = hash_words(buf)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return hashes[ends > starts].view(np.int64)


def _shard(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of n-grams by their nearest bytes of context, and of words."""
    return shard_keys(keys >> 8 & (1 << 8 * TOP) - 1 if kind == GRAM else keys, shards)


def _words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Keys of the words of canonical texts, some texts at a time, without their ends."""
    part, size = [], 0
    for t in [*texts, None]:
        if part and (t is None or size > 1 << 20):
            yield _word_keys(np.frombuffer(b"".join(part), np.uint8))
            part, size = [], 0
        if t is not None:
            part.append(t + b"\xff")
            size += len(t)


def _counter(depth: int, shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counts(), Counts()

        def passed(kind: int, held: Counts) -> Iterator[pa.RecordBatch]:
            keys, n = held.flush()
            for shard, k, c in dealt(_shard(kind, keys, shards), keys, n):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([k.tobytes()]), pa.array([c.tobytes()])], _COUNTED)

        for batch in batches:
            texts = canonical(batch.column("text").to_pylist())
            held = batch.column("held_out").to_pylist()
            for learn in (True, False):
                own = [t for t, h in zip(texts, held) if h is not learn]
                for buf, lengths, _ in pieces(own, depth + 1):
                    grams.add(codes(buf, lengths, depth + 1), int(learn))
                if learn and own:
                    words.add(np.full(len(own), END_WORD, np.int64))
                    for keys in _words_of(own):
                        words.add(keys)
            for kind, some in ((GRAM, grams), (WORD, words)):
                if some.merged > HELD:
                    yield from passed(kind, some)
        yield from passed(GRAM, grams)
        yield from passed(WORD, words)

    return count


_COUNTED = ["kind", "shard", "keys", "n"]


def _merge(table: pa.Table) -> pa.Table:
    """All counts of one shard as one row."""
    held = Counts()
    held.parts = [(numbers(table["keys"]), numbers(table["n"]))]
    held.merge()
    keys, n = held.flush()
    return pa.table({"kind": table["kind"][:1], "shard": table["shard"][:1], "keys": [keys.tobytes()], "n": [n.tobytes()], "size": [len(keys)], "total": [int(n.sum())]})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series after a shift by 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


_SMALL = 1 << 16
_HALF, _WHOLE = log_gamma(np.arange(_SMALL) + 0.5), log_gamma(np.arange(_SMALL) + 1.0)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones; small counts are looked up."""
    n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
    n, out = n0 + n1, np.empty(len(n0))
    small = n < _SMALL
    out[small] = _HALF[n0[small]] + _HALF[n1[small]] - _WHOLE[n[small]]
    big = ~small
    out[big] = log_gamma(n0[big] + 0.5) + log_gamma(n1[big] + 0.5) - log_gamma(n[big] + 1.0)
    return out - np.log(np.pi)


class _Level:
    """The nodes of one depth. codes: sorted pairs of context and byte; for each of a byte's eight decisions, a node is
    the run of codes with one context and one beginning of the byte."""

    def __init__(self, codes_: np.ndarray, n: np.ndarray):
        self.codes, self.at, self.n0, self.n1 = codes_, [], [], []
        for k in range(8):
            start = codes_ >> (8 - k)
            first = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
            ones = np.add.reduceat(n * ((codes_ >> (7 - k)) & 1), first)
            self.n1.append(ones)
            self.n0.append(np.add.reduceat(n, first) - ones)
            self.at.append(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes_)))))
        self.guess = [(n1 + 0.5) / (n0 + n1 + 1) for n0, n1 in zip(self.n0, self.n1)]
        self.own = [kt(n0, n1) for n0, n1 in zip(self.n0, self.n1)]
        self.lnp, self.weight = self.own, None

    def mix(self, below: list[np.ndarray]) -> None:
        self.weight = [_weight(own, b) for own, b in zip(self.own, below)]
        self.lnp = [_lnp(own, b) for own, b in zip(self.own, below)]


def _weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against the mixture of the deeper ones."""
    return 1 / (1 + np.exp(np.clip(below - own + _PRIOR, -700, 700)))


def _lnp(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own + np.log(1 - SPLIT), below + np.log(SPLIT))


def _levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict[int, _Level], dict[int, np.ndarray], np.ndarray]:
    """The subtree's levels from depth up to top, the place of each sorted n-gram among the codes of each level, and the
    order of the n-grams."""
    order = np.argsort(grams)
    levels, place = {depth: _Level(grams[order], n[order])}, {depth: np.arange(len(grams))}
    counts = n[order]
    for d in range(depth - 1, top - 1, -1):
        child = levels[d + 1]
        distinct, at = _group(child.codes & ((1 << 8 * (d + 1)) - 1))
        counts = np.bincount(at, weights=counts, minlength=len(distinct))
        level = levels[d] = _Level(distinct, counts)
        below = []
        for k in range(8):
            parent = np.empty(len(child.lnp[k]), np.int64)
            parent[child.at[k]] = level.at[k][at]  # all codes of a child's node lie in one node of the parent
            below.append(np.bincount(parent, weights=child.lnp[k], minlength=len(level.own[k])))
        level.mix(below)
        place[d] = at[place[d + 1]]
    return levels, place, order


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(shard, parts): the shard's n-grams and counts in parts of about WEIGHTED, each with whole subtrees."""
    for batch in batches:
        for shard, keys, n in zip(batch.column("shard").to_pylist(), batch.column("keys"), batch.column("n")):
            keys, n = numbers([keys]), numbers([n])
            near = keys >> 8 & (1 << 8 * TOP) - 1
            order = np.argsort(near, kind="stable")
            keys, n, near = keys[order], n[order], near[order]
            starts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            cuts, at = [0], 0
            while at < len(keys):
                i = np.searchsorted(starts, at + WEIGHTED, side="right") - 1
                nxt = starts[i] if starts[i] > at else starts[i + 1] if i + 1 < len(starts) else len(keys)
                at = len(keys) if at + WEIGHTED >= len(keys) else int(nxt)
                cuts.append(at)
            yield shard, [(keys[a:z], n[a:z]) for a, z in zip(cuts, cuts[1:])]


def _rooter(depth: int):
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the contexts of TOP bytes: counts and ln P, summed by the context one byte shorter and node."""
        for _, parts in _subtrees(batches):
            for keys, n in parts:
                level = _levels(keys, n, depth, TOP)[0][TOP]
                found = []
                for k in range(8):
                    code = np.empty(len(level.n0[k]), np.int64)
                    code[level.at[k]] = level.codes
                    node = (1 << k) | ((code & 255) >> (8 - k))
                    found.append((code & ((1 << 8 * TOP) - 256) | node, level.n0[k], level.n1[k], level.lnp[k]))
                code, *sums = (np.concatenate(c) for c in zip(*found))
                code, at = _group(code)
                yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(np.bincount(at, weights=x, minlength=len(code))) for x in sums)], ["code", "n0", "n1", "below"])

    return roots


def _mixer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (code, n0, n1, below) with their weights, guesses and ln P."""
    for batch in batches:
        n0, n1, below = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n0", "n1", "below"))
        own = kt(n0, n1)
        made = {"weight": _weight(own, below), "guess": (n1 + 0.5) / (n0 + n1 + 1), "lnp": _lnp(own, below)}
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("code", "n0", "n1")), *map(pa.array, made.values())], ["code", "n0", "n1", *made])


def _pricer(depth: int, sent):
    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 probability of the last byte of each n-gram after the others."""
        code, code_weight, code_guess, top = sent.value
        for shard, parts in _subtrees(batches):
            priced = []
            for keys, n in parts:
                levels, place, _ = _levels(keys, n, depth, TOP)
                grams = levels[depth].codes
                byte, near, value = grams & 255, (grams >> 8) & 255, np.zeros(len(grams))
                for k in range(8):
                    guess = levels[depth].guess[k][levels[depth].at[k]]
                    for d in range(depth - 1, TOP - 1, -1):
                        at = levels[d].at[k][place[d]]
                        weight = levels[d].weight[k][at]
                        guess = weight * levels[d].guess[k][at] + (1 - weight) * guess
                    node = (1 << k) | (byte >> (8 - k))
                    at = np.searchsorted(code, grams & ((1 << 8 * TOP) - 256) | node)
                    guess = code_weight[at] * code_guess[at] + (1 - code_weight[at]) * guess
                    for name, at in (("one", near * _NODES + node), ("zero", node)):
                        weight = top[f"{name}_weight"][at]
                        guess = weight * top[f"{name}_guess"][at] + (1 - weight) * guess
                    value += np.log10(np.where((byte >> (7 - k)) & 1, guess, 1 - guess))
                priced.append((grams, value.astype(np.float32)))
            grams, value = (np.concatenate(c) for c in zip(*priced))
            order = np.argsort(grams)
            arrays = [pa.array([GRAM], pa.int32()), pa.array([shard], pa.int32()), pa.array([grams[order].tobytes()]), pa.array([value[order].tobytes()])]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "shard", "keys", "value"])

    return price


def context_tree(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, shard, keys, value) of shards of n-grams (kind, shard, keys, n): value is the log10 probability of the last byte of
    each, in single precision.

    The trees of all contexts that share their three nearest bytes are weighted bottom-up in one place, some thousand n-grams
    at a time. Depth 2 is made of their sums in a table, of at most 256 * 256 contexts with 255 nodes each; depth 1 and the
    root, at most 65,280 and 255 nodes, on the driver. All three are sent back.
    """
    if depth < TOP:
        raise ValueError(f"depth is at least {TOP}")
    spark = grams.sparkSession
    sums = grams.mapInArrow(lean(_rooter(depth), 1), "code long, n0 double, n1 double, below double")
    sums = sums.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    two = save(sums.mapInArrow(lean(_mixer, 1 << 16), "code long, n0 double, n1 double, weight double, guess double, lnp double"))
    one = two.groupBy(F.expr("shiftright(code, 8) & 255").alias("near"), F.expr("code & 255").alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lnp").alias("below")).toPandas()
    top = {f"{k}_{v}": np.full(_NODES * size, 0.5) for k, size in (("one", _NODES), ("zero", 1)) for v in ("weight", "guess")}
    at = (one["near"] * _NODES + one["node"]).to_numpy()
    n0, n1, below = (one[c].to_numpy() for c in ("n0", "n1", "below"))
    top["one_weight"][at], top["one_guess"][at] = _weight(kt(n0, n1), below), (n1 + 0.5) / (n0 + n1 + 1)
    zero = one.assign(below=_lnp(kt(n0, n1), below)).sort_values(["node", "near"]).groupby("node", as_index=False)[["n0", "n1", "below"]].sum()
    at = zero["node"].to_numpy()
    n0, n1, below = (zero[c].to_numpy() for c in ("n0", "n1", "below"))
    top["zero_weight"][at], top["zero_guess"][at] = _weight(kt(n0, n1), below), (n1 + 0.5) / (n0 + n1 + 1)
    nodes = two.select("code", "weight", "guess").orderBy("code").toArrow()
    sent = send(spark, (*(nodes[c].to_numpy() for c in ("code", "weight", "guess")), top))
    return grams.mapInArrow(lean(_pricer(depth, sent), 1), "kind int, shard int, keys binary, value binary")


def _scores(texts: list[bytes], depth: int, priced: Table, words: Table) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, sum of log10(c + 1), log10 probability and bytes of each canonical text."""
    total, base = np.zeros(len(texts)), np.zeros(len(texts))
    tokens, known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for buf, lengths, owners in pieces(texts, depth + 1):
        value = priced.look(codes(buf, lengths, depth + 1), 0.0).astype(float)
        total += np.bincount(owners, weights=np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]])), minlength=len(texts))
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 1 << 20):
            size += len(texts[to])
            to += 1
        buf = np.frombuffer(b"".join(t + b"\xff" for t in texts[at:to]), np.uint8)
        hashes, ends = hash_words(buf)
        real = ends > np.concatenate([[0], ends[:-1] + 1])
        owner = at + np.concatenate([[0], np.cumsum(buf[ends] == 255)[:-1]])[real]
        c = words.look(np.concatenate([hashes[real].view(np.int64), np.full(to - at, END_WORD, np.int64)]), 0)
        owner = np.concatenate([owner, np.arange(at, to)])
        base += np.bincount(owner, weights=np.log10(c + 1.0), minlength=len(texts))
        tokens += np.bincount(owner, minlength=len(texts))
        known += np.bincount(owner, weights=c > 0, minlength=len(texts)).astype(np.int64)
        at = to
    return tokens, known, base, total, np.array([len(t) + 1 for t in texts], np.int64)


def _scorer(depth: int, tables):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priced, words = tables.value
        for batch in batches:
            found = _scores(canonical(batch.column("text").to_pylist()), depth, priced, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, found)], _COLUMNS)

    return score


_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"]
_TYPES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def _wanted(depth: int):
    def wanted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Keys of n-grams and words that the scores of texts need."""
        texts = canonical(texts)
        for buf, lengths, _ in pieces(texts, depth + 1):
            yield GRAM, codes(buf, lengths, depth + 1)
        yield WORD, np.array([END_WORD], np.int64)
        for keys in _words_of(texts):
            yield WORD, keys

    return wanted


def _block_scorer(depth: int):
    def score(docs: pa.Table, known: dict[int, Table]) -> pa.Table:
        found = _scores(canonical(docs["text"].to_pylist()), depth, known[GRAM], known[WORD])
        return pa.table([docs["doc_id"], docs["held_out"], *map(pa.array, found)], names=_COLUMNS)

    return score


def score(docs: DataFrame, depth: int = DEPTH, sent_rows: int = SENT_ROWS) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model codes a document's words, A-Z in lower case and joined by one space, byte by byte and then the end, so that
    it prices the same event as the base, which counts whole words. A byte's eight binary decisions each have a tree over
    the bytes before it; the nodes of all depths, Krichevsky-Trofimov estimates from all learning documents, are mixed by
    their posterior weights. score is the log10 probability, bits_per_byte the code length.

    Counting meets all n-grams of all documents (those of held-out ones with count 0), so every n-gram has its price. The
    prices and word counts are sent to the executors if they have at most sent_rows rows. Beyond that, blocks of documents
    ask the shards for their distinct n-grams and words, and meet the answers: each block then scores with a table of its
    own, to the same numbers. A block's n-grams travel once there and once back, so no document meets all prices.

    Nulls and empty texts: one token, the end. A null doc_id counts as '' for the fold. Repeated rows are scored each. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    size, n_rows = rows.agg(*text_size(F.col("text"))).first()
    shards = shards_for(size)
    counted = rows.mapInArrow(lean(_counter(depth, shards)), "kind int, shard int, keys binary, n binary")
    counted = save(counted.groupBy("kind", "shard").applyInArrow(_merge, "kind int, shard int, keys binary, n binary, size long, total long"))
    sizes = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect()}
    vocabulary, total = (sizes[WORD]["size"], sizes[WORD]["total"]) if WORD in sizes else (0, 0)
    words = counted.filter(F.col("kind") == WORD).select("kind", "shard", "keys", F.col("n").alias("value"))
    priced = save(context_tree(counted.filter(F.col("kind") == GRAM), depth))
    if sum(r["size"] for r in sizes.values()) <= sent_rows:
        tables = send(spark, (table(priced.select("keys", "value").toArrow(), "value", np.float32), table(words.select("keys", "value").toArrow(), "value", np.int64)))
        out = rows.mapInArrow(lean(_scorer(depth, tables)), _TYPES)
    else:
        shard_of = lambda kind, keys: _shard(kind, keys, shards)
        known, types = priced.unionByName(words), {GRAM: np.float32, WORD: np.int64}
        out = look_up(blocks(numbered(rows), size, n_rows), known, types, _wanted(depth), shard_of, _block_scorer(depth), _TYPES)
    rate = F.log10(F.lit(float(total + vocabulary + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * rate).alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

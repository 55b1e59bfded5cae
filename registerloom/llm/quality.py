"""Quality classifier: an interpolated modified Kneser-Ney byte n-gram model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, look_up, packed, shard_keys, shards_for, text_size
from ._grams import Counts, Table, codes, pieces
from ._rows import BROADCAST_ROWS, checked_broadcast, lean, numbered, save, send

#: Bytes of an n-gram.
ORDER = 5
#: One in so many trusted documents is kept from the model and sets the thresholds.
HELD_OUT = 5
#: A document is rejected above this quantile of its language's held-out trusted log perplexities.
QUANTILE = 0.99
#: With fewer held-out texts the quantile is not known; then the limit is the median plus SPREAD times the way from there to the
#: 95 % quantile, of log perplexities with PRIOR_WORDS.
LEAST_HELD = 100
SPREAD = 4.0
#: A discount is at least this, so that bytes never seen keep some mass.
LEAST_DISCOUNT = 0.1
#: Words at the language's mean rate that are added to each document, so that a few odd words alone don't reject a short one.
PRIOR_WORDS = 30.0


def _raw(texts: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()

        def out():
            keys, n = held.flush()
            for at in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(n[at : at + (1 << 17)])], ["key", "n"])

        for batch in batches:
            texts, learned = _raw(batch.column("text").to_pylist()), batch.column("learned").to_pylist()
            for learn in (True, False):
                for buf, lengths, _ in pieces([t for t, x in zip(texts, learned) if x is learn], order):
                    held.add(codes(buf, lengths, order), int(learn))
            if held.merged > 2_000_000:
                yield from out()
        yield from out()

    return count


def _discounts(table: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n = [float(x or 0) for x in table.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5)]).first()]
    if not all(n):  # too little text for the estimate
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max((i + 1) - (i + 2) * y * n[i + 1] / n[i], LEAST_DISCOUNT), i + 1.0) for i in range(3)]


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value) of each n-gram of grams (key, n): value is the log10 probability of its last byte after the others.

    Counts of the highest order are those of the trusted texts; a lower order counts the different bytes that precede.
    Every order is a table keyed by n-gram or by context, spread over all executors, and the orders meet in joins; the
    n-grams to price, seen or not, carry their shorter forms along.
    """
    tables = [grams.select("key", F.col("n").alias("c"))]
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        seen = F.sum((F.col("c") > 0).cast("long"))
        tables.append(save(tables[-1].groupBy(F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).agg(seen.alias("c"))))
    priced = None
    for k, table in enumerate(reversed(tables), 1):
        d1, d2, d3 = _discounts(table)
        ctx = F.shiftright("key", 8)
        rows = table.withColumn("ctx", ctx)
        mass = [F.lit(d1) * F.count(F.when(F.col("c") == 1, 1)), F.lit(d2) * F.count(F.when(F.col("c") == 2, 1)), F.lit(d3) * F.count(F.when(F.col("c") > 2, 1))]
        contexts = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (mass[0] + mass[1] + mass[2]).alias("mass"))
        rows = rows.join(contexts, "ctx")
        if priced is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            mask = (1 << 8 * (k - 1)) - 1
            rows = rows.withColumn("short", F.col("key").bitwiseAND(F.lit(mask).cast("long")))
            rows = rows.join(priced.select(F.col("key").alias("short"), F.col("p").alias("lower")), "short")
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = (F.greatest(F.col("c") - cut, F.lit(0.0)) + F.col("mass") * F.col("lower")) / F.col("total")
        priced = rows.select("key", F.when(F.col("total") > 0, own).otherwise(F.col("lower")).alias("p"))
    return priced.select("key", F.log10("p").alias("value"))


def _priced(texts: list[bytes], order: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Words, the end among them, and log10 probability of each text."""
    total = np.zeros(len(texts))
    for buf, lengths, owners in pieces(texts, order):
        value = table.look(codes(buf, lengths, order), 0.0)
        total += np.bincount(owners, weights=np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]])), minlength=len(texts))
    return np.array([len(t.split()) + 1 for t in texts], np.int64), total


def _scorer(order: int, table):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _priced(_raw(batch.column("text").to_pylist()), order, table.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEYS), *map(pa.array, found)], [*_KEYS, "n_words", "logprob"])

    return score


_KEYS = ["doc_id", "lang", "trusted", "learned", "rid"]
_TYPES = "doc_id long, lang string, trusted boolean, learned boolean, rid long, n_words long, logprob double"


def _wanted(order: int):
    def wanted(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        for buf, lengths, _ in pieces(_raw(texts), order):
            yield 0, codes(buf, lengths, order)

    return wanted


def _block_scorer(order: int):
    def score(docs: pa.Table, known: dict[int, Table]) -> pa.Table:
        found = _priced(_raw(docs["text"].to_pylist()), order, known[0])
        return pa.table([*(docs[c] for c in _KEYS), *map(pa.array, found)], names=[*_KEYS, "n_words", "logprob"])

    return score


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, spread: float = SPREAD, prior_words: float = PRIOR_WORDS, sent_rows: int = BROADCAST_ROWS,
    quantile: float = QUANTILE, least_held: int = LEAST_HELD,
) -> DataFrame:
    """One row for each row of docs: doc_id, lang, trusted, learned, n_words, logprob, perplexity, threshold, keep, rid.

    Trusted texts are the documents that labels mark with quality 1. The model learns from all of them but one in HELD_OUT
    by a hash of the id; those set the thresholds, as a model thinks too well of what it has learned. logprob is the log10 probability of the
    whole text, byte by byte and its end, under the trusted model; perplexity is a word's, the end counting as a word.
    A document is kept unless its log perplexity is above the quantile of its language's held-out trusted texts. In a
    language with fewer than least_held of them, perplexities have prior_words more words at those texts' mean, and the
    limit is their median plus spread times the way to their 95 % quantile. Text of few words repeated over and over is
    cheap to the model and may be kept. The n-grams' prices are sent to the executors if there are at most
    sent_rows, else blocks of documents fetch those that they need.

    Nulls and empty texts: a null text is empty and priced by its end alone; a null lang is a language of its own; a null
    doc_id is never trusted. A language without trusted text is held to the threshold of all trusted ones; with none at all,
    everything is kept (threshold null). Repeated rows are judged each; a document with several labels is trusted if any
    has quality 1. An empty table gives no rows; other columns are ignored.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    rows = numbered(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", "rid")
    rows = rows.join(checked_broadcast(good), F.col("doc_id") == F.col("good_id"), "left").withColumn("trusted", F.col("good_id").isNotNull()).drop("good_id")
    rows = rows.withColumn("learned", F.col("trusted") & (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HELD_OUT)) != 0))
    grams = save(rows.select("text", "learned").mapInArrow(lean(_counter(order)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    priced = save(kneser_ney(grams, order))
    if priced.count() <= sent_rows:
        t = priced.toArrow()
        table = send(docs.sparkSession, Table(t["key"].to_numpy(), t["value"].to_numpy()))
        scored = rows.mapInArrow(lean(_scorer(order, table)), _TYPES)
    else:
        size, n_rows = docs.agg(*text_size(F.col("text"))).first()
        shards = shards_for(size)
        scored = look_up(blocks(rows, size, n_rows), packed(priced, shards), {0: np.float64}, _wanted(order), lambda kind, keys: shard_keys(keys, shards), _block_scorer(order), _TYPES)
    scored = save(scored)
    trusted = scored.filter("trusted and not learned")
    rate = -F.sum("logprob") / F.sum("n_words")
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # no null, so that languages join
    means = trusted.groupBy(lang.alias("of")).agg(rate.alias("mean"), F.count("*").alias("n_held"))
    overall = trusted.agg(rate.alias("all_mean"))
    # joins without a condition are with one row
    scored = scored.withColumn("of", lang).join(F.broadcast(overall)).join(checked_broadcast(save(means)), "of", "left")
    mean = F.coalesce("mean", "all_mean", F.lit(0.0))
    log = -F.col("logprob") / F.col("n_words")
    mixed = (-F.col("logprob") + prior_words * mean) / (F.col("n_words") + prior_words)
    many = F.coalesce(F.col("n_held") >= least_held, F.lit(False))
    scored = scored.withColumn("mixed", mixed).withColumn("log_perplexity", F.when(many, log).otherwise(mixed))
    trusted = scored.filter("trusted and not learned")
    at = lambda q, c="mixed": F.percentile_approx(c, q, 10000)
    limit = at(0.5) + spread * (at(0.95) - at(0.5))
    by_lang = trusted.groupBy("of").agg(F.when(F.first("n_held") >= least_held, at(quantile, "log_perplexity")).otherwise(limit).alias("own"))
    every = trusted.agg(limit.alias("every"))
    out = scored.join(F.broadcast(every)).join(checked_broadcast(save(by_lang)), "of", "left").withColumn("limit", F.coalesce("own", "every"))
    keep = F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))
    return out.select(
        "doc_id", "lang", "trusted", "learned", "n_words", "logprob", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"),
        F.pow(F.lit(10.0), "limit").alias("threshold"), keep.alias("keep"), "rid",
    )

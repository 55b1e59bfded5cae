"""Importance resampling: documents whose hashed n-grams look like a target's are drawn with a higher chance.

Texts are taken in blocks. A block has an integer dictionary of its words; its n-grams are tuples of these integers, counted
as numbers. Each distinct tuple is written out as bytes and hashed once, and its bucket is joined back to the places where the
tuple stands. A dictionary of the whole corpus would not save hashing: in the test tables more than half of all pairs of words
stand there once, so the tuples, sent to their hashes and back, would be larger than the texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import lean, ranks, save, send

BUCKETS = 10_000
#: Documents with fewer words are never drawn; percentage of the others that is.
MIN_WORDS, PERCENT = 20, 25
#: Words in one run at most.
LONGEST = 2
SEED = 7
#: Bytes of text in a block (or one text), and in a piece that is split into words at once.
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: A-Z in lower case; all ASCII characters but letters and digits separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _words(text: str) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    raw, at = text.encode().translate(_FOLD), 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE_BYTES)
        yield raw[at : to if to >= 0 else len(raw)].split()
        at = to + 1 if to >= 0 else len(raw)


class Block:
    """Texts as numbers of words in the block's own dictionary."""

    def __init__(self) -> None:
        self.dictionary: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        known, n = self.dictionary, 0
        for words in _words(text or ""):
            self.pieces.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            n += len(words)
        self.lengths.append(n)
        self.size += len(text or "")

    def runs(self, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of 1 to longest words: (bucket of each distinct run, number of its run at each place, text of each place)."""
        words = np.concatenate([np.empty(0, np.int64), *self.pieces])
        text_of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        spelled = list(self.dictionary)
        hashes = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
        tuples = words  # number of the run that starts at each word
        yield hashes % buckets, tuples, text_of
        following = np.array([b" " + w for w in spelled] or [b""], object)
        for n in range(2, longest + 1):
            # a run is the number of its beginning and that of its last word, as one number
            same = text_of[n - 1 :] == text_of[: max(len(text_of) - n + 1, 0)]
            keys = (tuples[: len(same)] * max(len(spelled), 1) + words[n - 1 :])[same]
            distinct, place = np.unique(keys, return_inverse=True)
            begins, last = np.divmod(distinct, max(len(spelled), 1))
            # crc32 goes on where the beginning's ended: the hash of all bytes of the run, joined by spaces
            hashes = np.fromiter(map(zlib.crc32, following[last].tolist(), hashes[begins].tolist()), np.int64, len(distinct))
            yield hashes % buckets, place, text_of[: len(same)][same]
            tuples = np.zeros(len(same), np.int64)  # where a text ends no longer run starts, whatever stands here
            tuples[same] = place


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], Block]]:
    block, ids = Block(), []
    for batch in batches:
        ids.append(batch.column("doc_id"))
        for text in batch.column("text"):
            block.add(text.as_py())
        if block.size >= BLOCK_BYTES:
            yield ids, block
            block, ids = Block(), []
    if ids:
        yield ids, block


def _counter(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, block in _in_blocks(batches):
            for bucket, place, _ in block.runs(longest, buckets):
                np.add.at(total, bucket, np.bincount(place, minlength=len(bucket)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return count


def _weigher(gains, longest: int, buckets: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _in_blocks(batches):
            n, total = np.zeros((2, len(block.lengths)), np.int64)
            for bucket, place, text in block.runs(longest, buckets):
                n += np.bincount(text, minlength=len(n))
                gain = np.concatenate([[0], np.cumsum(gains.value[bucket][place])])  # whole numbers, so sums are exact
                ends = np.cumsum(np.bincount(text, minlength=len(n)))  # places of a text follow each other
                total += gain[ends] - gain[np.concatenate([[0], ends[:-1]])]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.array(block.lengths, np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of words of all texts (doc_id, text) fall into each bucket; each task sends its sums, by bucket."""
    found = texts.mapInArrow(lean(_counter(longest, buckets)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target's over source's smoothed share, for each bucket, floored."""
    size = len(source)
    of_source, of_target = float(source.sum()) + size, float(target.sum()) + size
    share = lambda s, t: (float(t) + 1) * of_source / ((float(s) + 1) * of_target)
    return np.array([math.floor(1000 * math.log(share(s, t))) for s, t in zip(source, target)], np.int64)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Every document with its weight and, where drawn, its rank: doc_id, n_words, n_features, weight, score, rank.

    A document's features are its runs of 1 to longest words; weight is the floored mean of their buckets' gains, which
    compare the buckets' shares in the target's texts and in all of docs. score adds seeded Gumbel noise of the doc_id; of
    the documents with at least min_words words, percent % with the highest scores are drawn, ties to the smaller doc_id.

    Nulls: a null text has no words; a null doc_id counts as the text "null" for the noise and comes last in ties. Texts
    without words have weight 0 and are not drawn (unless min_words is 0). Repeated rows are documents of their own, with one
    score; which of them come first is open. An empty docs gives no rows, an empty target one where all counts are 0. Other
    columns are ignored. The counts of all buckets are the only thing that passes the driver: two numbers a bucket.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gains = send(docs.sparkSession, gains_of(bucket_counts(texts, longest, buckets), bucket_counts(wanted, longest, buckets)))
    weighed = texts.mapInArrow(lean(_weigher(gains, longest, buckets)), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = save(weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    placed = ranks(able, "rank", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


#: The same in DuckDB SQL over the tables documents and benchmark. Bytes are folded into crc32 by its table of 256 entries,
#: which eight shifts of each index make.
SQL = f"""
with recursive shifts as (
  select i, i as crc, 0 as n from range(256) t(i)
  union all
  select i, case when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, n + 1 from shifts where n < 8
),
crc_table as (select list(crc order by i) as steps from shifts where n = 8),
texts as (
  select true as source, row_number() over () as r, doc_id, text from documents
  union all
  select false, row_number() over (), null, text from benchmark
),
words as (
  select source, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts
),
features as (
  select source, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words
),
counted as (select source, r, f, count(*) as n from features group by all),
hashed as (
  select f, (xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))),
      lambda i: strpos('123456789ABCDEF', hex(encode(f))[2 * i + 1]) * 16 + strpos('123456789ABCDEF', hex(encode(f))[2 * i + 2]))),
    lambda crc, b: xor(crc >> 8, steps[(xor(crc, b) & 255) + 1])), 4294967295) % {BUCKETS})::int as bucket
  from (select distinct f from counted), crc_table
),
buckets as (
  select bucket, coalesce(sum(n) filter (source), 0)::double as s, coalesce(sum(n) filter (not source), 0)::double as t
  from counted join hashed using (f) group by bucket
),
gains as (
  select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from buckets) + {BUCKETS}) / ((s + 1) * ((select sum(t) from buckets) + {BUCKETS}))))::bigint as gain
  from buckets
),
weights as (
  select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight
  from counted join hashed using (f) join gains using (bucket) where source group by r
),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::text, 'null'))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words left join weights using (r) where source
),
placed as (
  select *, case when n_words >= {MIN_WORDS} then row_number() over (partition by n_words >= {MIN_WORDS} order by score desc, doc_id nulls last) end as place
  from scored
)
select doc_id, n_features, weight, score,
  case when place <= (select {PERCENT} * count(*) // 100 from scored where n_words >= {MIN_WORDS}) then place end as rank
from placed
"""

"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._rows import save, send

TOP = 10
#: A vector is a query if its id is divisible by this.
QUERY_EVERY = 100
#: Components become whole numbers: floor(SCALE * x).
SCALE = 1024
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53
#: Dimensions that are accumulated before candidates are compacted; query vectors in one block, and pairs of a query and a
#: candidate that are scored at a time.
BLOCK_DIMS, QUERY_ROWS, BLOCK_PAIRS = 16, 8192, 1 << 22


def _matrix(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole components padded with 0 to the batch's longest): none that is null, holds a
    null or a non-finite component."""
    vectors = batch.column(column)
    lengths = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()], np.int64)
    starts = np.asarray(vectors.offsets)[:-1].astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    width = max(0, int(lengths.max(initial=0)))
    at = starts[:, None] + np.arange(width)[None, :]
    inside = np.arange(width)[None, :] < lengths[:, None]
    x = np.where(inside, flat[np.minimum(at, max(0, len(flat) - 1))] if len(flat) else 0.0, 0.0)
    good = (lengths >= 0) & np.isfinite(x).all(axis=1)
    return np.flatnonzero(good), np.floor(SCALE * x[good])


class Queries:
    """Query vectors in vertical layout (dimensions by queries), their dimensions in order of falling mass."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        self.largest = np.abs(x).max(initial=0.0)
        self.order = np.argsort(-(x**2).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(x[:, self.order].T)
        self.rest = self._rest(self.columns)

    @staticmethod
    def _rest(columns: np.ndarray) -> list[np.ndarray]:
        """Norms of what is left of each vector before each block of dimensions and after the last."""
        cuts = range(0, len(columns) + BLOCK_DIMS, BLOCK_DIMS)
        return [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts]

    def aligned(self, x: np.ndarray) -> np.ndarray:
        """Candidates in vertical layout and the queries' order of dimensions; what either lacks counts as 0."""
        d = len(self.order)
        x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
        return np.ascontiguousarray(x[:, self.order].T)


def search_block(q: Queries, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of all candidates that may be among the top ones, given each query's floor.

    Scores grow block of dimensions by block; a pair survives as long as its partial score and the product of the norms
    of what is left can reach the floor. Bounds are exact numbers up to rounding, so they are taken a little wide."""
    c = q.aligned(x)
    rest = Queries._rest(c)
    score = q.columns[:BLOCK_DIMS].T @ c[:BLOCK_DIMS]
    alive_q, alive_c = np.nonzero(score + q.rest[1 if len(q.rest) > 1 else 0][:, None] * rest[1 if len(rest) > 1 else 0][None, :] * (1 + 1e-9) + 1e-6 >= floor[:, None])
    partial = score[alive_q, alive_c]
    for b in range(1, len(q.rest) - 1):
        rows = slice(b * BLOCK_DIMS, (b + 1) * BLOCK_DIMS)
        out = np.empty(len(partial))
        for at in range(0, len(partial), 1 << 18):
            part = slice(at, at + (1 << 18))
            out[part] = np.einsum("ij,ij->j", q.columns[rows][:, alive_q[part]], c[rows][:, alive_c[part]])
        partial = partial + out
        keep = partial + q.rest[b + 1][alive_q] * rest[b + 1][alive_c] * (1 + 1e-9) + 1e-6 >= floor[alive_q]
        alive_q, alive_c, partial = alive_q[keep], alive_c[keep], partial[keep]
        if b == 1 and len(partial) > 4 * top * len(q.ids):  # a first estimate lifts the floors: the top-th of lower bounds
            low = partial - q.rest[b + 1][alive_q] * rest[b + 1][alive_c] * (1 + 1e-9) - 1e-6
            low = np.where(ids[alive_c] == q.ids[alive_q], -np.inf, low)
            order = np.lexsort((-low, alive_q))
            first = np.searchsorted(alive_q[order], np.arange(len(q.ids)))
            nth = first + top - 1
            ok = (nth < len(order)) & (alive_q[order][np.minimum(nth, len(order) - 1)] == np.arange(len(q.ids)))
            lift = np.where(ok, low[order][np.minimum(nth, len(order) - 1)], -np.inf)
            keep = partial + q.rest[b + 1][alive_q] * rest[b + 1][alive_c] * (1 + 1e-9) + 1e-6 >= np.maximum(floor, lift)[alive_q]
            alive_q, alive_c, partial = alive_q[keep], alive_c[keep], partial[keep]
    own = ids[alive_c] == q.ids[alive_q]
    return alive_q[~own], ids[alive_c][~own], partial[~own]


def _best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[rank < top], ids[rank < top], score[rank < top]


def _searcher(sent, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = sent.value
        floor = np.full(len(q.ids), -np.inf)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        size = max(64, BLOCK_PAIRS // max(1, len(q.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                good, x = _matrix(part, "embedding")
                if not len(good):
                    continue
                largest = np.abs(x).max(initial=0.0)
                if largest * q.largest * len(q.order) >= EXACT:
                    raise ValueError(f"components as large as {largest / SCALE:g} have inner products that no double holds exactly")
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)[good].astype(np.int64)
                new = search_block(q, ids, x, floor, top)
                best = _best(*(np.concatenate(pair) for pair in zip(best, new)), top)
                full = np.bincount(best[0], minlength=len(q.ids)) == top
                last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True)) if len(best[0]) else np.empty(0, np.int64)
                floor[best[0][last]] = np.where(full[best[0][last]], best[2][last], -np.inf)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[best[0]]), pa.array(best[1]), pa.array(best[2].astype(np.int64))], ["query_id", "vec_id", "score"])

    return search


def search(embeddings: DataFrame, top: int = TOP, query_every: int = QUERY_EVERY, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the top candidates of every query by whole inner product, ties to the smaller id.

    Queries are the vectors whose id is divisible by query_every, candidates all others' rows. Queries are sent in blocks of
    about query_rows vectors, one after the other and so of a bounded size, each against all candidates where these are
    read (a query set of a hundredth of the rows takes a scan for every 100 * query_rows rows, and no shuffle of vectors); a
    task keeps top rows a query. Scores are sums of whole numbers; where one could reach EXACT, up to which floating point
    holds them exactly, the search is an error.

    Nulls: a vector that is null, holds a null or a non-finite component, or has a null id, takes no part. Vectors of
    different length are compared over their common dimensions. Rows with one id: as queries they are one, the first by its
    components; as candidates each is a row of its own, but none of them for the query of that id. Fewer candidates than
    top give fewer rows; an empty table gives none. Other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    sane = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    asked = rows.filter((F.col("vec_id") % query_every == 0) & sane).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = save(asked)
    n = asked.count()
    blocks = max(1, -(-n // query_rows))
    found = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
        batch = part.to_batches()[0] if part.num_rows else None
        if batch is None:
            continue
        good, x = _matrix(batch, "embedding")
        sent = send(embeddings.sparkSession, Queries(batch.column("vec_id").to_numpy()[good], x))
        some = rows.mapInArrow(_searcher(sent, top), "query_id long, vec_id long, score long")
        if blocks > 1:  # one block at a time is in memory, here and on the executors
            some = save(some)
            sent.unpersist(blocking=True)
        found.append(some)
    found = reduce(DataFrame.unionByName, found) if found else embeddings.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB SQL.
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= {TOP}
"""

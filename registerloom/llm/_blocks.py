"""Looking up what blocks of documents need in tables of n-grams that are too large to send.

A table lies in shards, each a row with thousands of keys and values as bytes. Blocks of documents ask the shards for their
distinct keys and meet the answers, so each key of a block travels once there and once back, and every block is scored with a
small table of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._grams import Counts, Table
from ._rows import lean, mix

#: Bytes of text in a block, on average, and bytes of text for each shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20


def shards_for(size: int) -> int:
    """Number of shards for so many bytes of text."""
    return 1 << max(4, min(20, (size // SHARD_BYTES).bit_length()))


def shard_keys(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key."""
    return (mix(keys.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def dealt(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(shard, columns...) for each shard."""
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, z in zip(first, [*first[1:], len(shard)]):
        yield (int(shard[a]), *(c[a:z] for c in columns))


def numbers(column: pa.ChunkedArray | pa.Array | list, kind=np.int64) -> np.ndarray:
    """The numbers of all rows of bytes."""
    size = np.dtype(kind).itemsize
    buffers = [x.as_buffer() for x in column]
    out, at = np.empty(sum(len(b) for b in buffers) // size, kind), 0
    for b in buffers:
        out[at : at + len(b) // size] = np.frombuffer(b, kind)
        at += len(b) // size
    return out


def table(rows: pa.Table, column: str, kind) -> Table:
    return Table(numbers(rows["keys"]), numbers(rows[column], kind))


def packed(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (key, value) as shards (kind 0, shard, keys, value)."""

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column("key").to_numpy(), batch.column("value").to_numpy()
            for shard, k, v in dealt(shard_keys(keys, shards), keys, values):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([shard], pa.int32()), pa.array([k.tobytes()]), pa.array([v.tobytes()])], ["kind", "shard", "keys", "value"])

    return rows.select("key", F.col("value").cast("double").alias("value")).mapInArrow(spread_out, "kind int, shard int, keys binary, value binary")


def blocks(rows: DataFrame, size: int, n_rows: int) -> DataFrame:
    """Numbered rows (rid) with the number of their block: rows that follow each other in one file, of about BLOCK_BYTES."""
    block_rows = max(1, BLOCK_BYTES * n_rows // max(size, 1))
    # the upper bits of a row's number tell its file
    return rows.withColumn("block", F.expr(f"shiftleft(shiftright(rid, 33), 33) + (rid & {(1 << 33) - 1}) div {block_rows}"))


def _asker(wanted: Callable[[list[str | None]], Iterator[tuple[int, np.ndarray]]], shard_of: Callable[[int, np.ndarray], np.ndarray]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counts] = {}
        now = None

        def passed() -> Iterator[pa.RecordBatch]:
            for kind, counts in held.items():
                keys = counts.flush()[0]
                for shard, k in dealt(shard_of(kind, keys), keys):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([now]), pa.array([k.tobytes()])], ["kind", "shard", "block", "keys"])

        for batch in batches:
            number = batch.column("block").to_numpy()
            for block in np.unique(number).tolist():  # rows of one block follow each other
                if block != now:
                    yield from passed()
                    now = block
                for kind, keys in wanted(batch.column("text").filter(pa.array(number == block)).to_pylist()):
                    held.setdefault(kind, Counts()).add(keys)
        yield from passed()

    return ask


def _answer(kinds: dict[int, type]):
    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """What a shard knows of the keys that blocks ask for, as bytes."""
        values = []
        if len(asked):
            kind = kinds[asked["kind"][0].as_py()]
            own = table(known, "value", kind)
            values = [own.look(numbers([k]), 0).astype(kind).tobytes() for k in asked["keys"]]
        return pa.table({"kind": asked["kind"], "block": asked["block"], "keys": asked["keys"], "value": pa.array(values, pa.binary())})

    return answer


def look_up(
    docs: DataFrame, known: DataFrame, kinds: dict[int, type], wanted: Callable[[list[str | None]], Iterator[tuple[int, np.ndarray]]],
    shard_of: Callable[[int, np.ndarray], np.ndarray], score: Callable[[pa.Table, dict[int, Table]], pa.Table], schema: str,
) -> DataFrame:
    """score of each block of docs (block, text, ...) with tables of the keys that wanted gives for its texts.

    known are shards (kind, shard, keys, value) whose values have the types in kinds; shard_of deals keys as known is dealt."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        of = answers["kind"].to_numpy()
        return score(rows, {kind: table(answers.filter(pa.array(of == kind)), "value", t) for kind, t in kinds.items()})

    asked = docs.select("block", "text").mapInArrow(lean(_asker(wanted, shard_of)), "kind int, shard int, block long, keys binary")
    answers = asked.groupBy("kind", "shard").cogroup(known.groupBy("kind", "shard")).applyInArrow(_answer(kinds), "kind int, block long, keys binary, value binary")
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def text_size(text: Column) -> list[Column]:
    """Aggregates of a table: bytes of its texts, and rows."""
    return [F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")]

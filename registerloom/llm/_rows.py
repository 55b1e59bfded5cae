"""Shared plumbing: tables in the cluster's shared folder, checked broadcasts, word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of (key, value) that one broadcast may hold: 24 bytes each, under 100 MB.
BROADCAST_ROWS = 4_000_000
#: Files whose paths numbered() broadcasts.
NUMBERED_FILES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What the innermost scope has to clean up.
_HELD: contextvars.ContextVar[list[Callable[[], None]] | None] = contextvars.ContextVar("held", default=None)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that save() writes and broadcasts that send() makes inside go when it ends, but for those made with keep."""
    held = []
    token = _HELD.set(held)
    try:
        yield
    finally:
        _HELD.reset(token)
        for clean in reversed(held):
            clean()


def _later(clean: Callable[[], None], keep: bool) -> None:
    if not keep and (held := _HELD.get()) is not None:
        held.append(clean)


def save(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path
    _later(lambda: discard(out), keep)
    return out


def hold(df: DataFrame) -> None:
    """Let the scope, if there is one, delete a table made with keep after all."""
    _later(lambda: discard(df), False)


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that no later plan reads."""
    spark, path = df.sparkSession, df._loom_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def send(spark: SparkSession, value):
    """value as a broadcast; the caller has checked its size."""
    out = spark.sparkContext.broadcast(value)
    _later(out.destroy, False)
    return out


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with the rows' numbers in column name, the same ones each time that the result is read, however its files are then
    dealt to tasks: the place of a row's file among docs' files by path, in the upper bits, and of the row in its file.

    Rows of Parquet files are numbered as they are; anything else (a shuffle may deal its rows otherwise the next time) is
    stored first, and so is what lies in more than NUMBERED_FILES files, as their paths are broadcast. Rows that have been
    numbered get the same numbers again."""
    plan = docs._jdf.queryExecution().analyzed()
    joined = lambda p: p.nodeName() == "Join" and any(p.output().apply(i).name() == "__loom_path" for i in range(p.output().size()))
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") or joined(plan):
        plan = plan.children().head()
    kind = lambda x: x.getClass().getSimpleName()
    stored = plan.nodeName() == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation" and kind(plan.relation().fileFormat()) == "ParquetFileFormat"
    if not stored or len(docs.inputFiles()) > NUMBERED_FILES:
        docs = save(docs.coalesce(NUMBERED_FILES), keep=True)
    paths = sorted(re.sub("^file:/+", "file:/", f) for f in docs.inputFiles())
    about = docs.metadataColumn("_metadata")
    rows = docs.withColumns({"__loom_file": F.regexp_replace(about["file_path"], "^file:/+", "file:/"), name: about["row_index"]})
    if len(paths) > 1:
        files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "__loom_path string, __loom_at long")
        rows = rows.join(F.broadcast(files), F.col("__loom_file") == F.col("__loom_path"), "left")
        at = F.coalesce("__loom_at", F.raise_error(F.concat(F.lit("a file that was not listed: "), "__loom_file")).cast("long"))
        rows = rows.withColumn(name, F.shiftleft(at, 33).bitwiseOR(F.col(name))).drop("__loom_path", "__loom_at")
    return rows.drop("__loom_file")


def ranks(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their places (from 1) in order in column name; rows that tie in all of order are placed as it happens.

    Rows are dealt by range and sorted where they are; the only thing that passes the driver is how many each range has."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__loom_part": F.spark_partition_id(), "__loom_place": place})
    dealt = save(dealt)
    offsets, before = [], 0
    for part, n in sorted(dealt.groupBy("__loom_part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__loom_part int, __loom_before long"))
    placed = dealt.join(offset, "__loom_part").withColumn(name, F.col("__loom_before") + F.col("__loom_place") + 1)
    return placed.drop("__loom_part", "__loom_place", "__loom_before")


def _release() -> None:
    """Give free memory back to the system: Python workers are used again and would go on holding it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work, rows: int = 2048, size: int = 4 << 20):
    """work, a function for mapInArrow, on batches of at most rows rows and about size bytes (or one row); what a task held
    goes when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(part for batch in batches for part in slices(batch, rows, size))
        finally:
            _release()

    return run


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > size:
            n //= 2
        yield batch.slice(at, n)
        at += n


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else df as it is (then the join shuffles)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def keep_rows(docs: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """docs whose doc_id is in ids (keep) or not in ids; ids has one column, doc_id. Null ids are in no list."""
    key = "__loom_id"
    ids = checked_broadcast(ids.select(F.col("doc_id").alias(key)).distinct())
    return docs.join(ids, docs["doc_id"] == F.col(key), "left_semi" if keep else "left_anti")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split() separates at exactly the six white spaces."""
    return text.encode().lower().split() if text else []


#: Odd base of the word hash and its inverse modulo 2**64; a fixed table makes bytes into 64-bit numbers.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 1 << 16
_POW = np.array([1], np.uint64)
_IPOW = np.array([1], np.uint64)


def _powers(n: int) -> None:
    global _POW, _IPOW
    with np.errstate(over="ignore"):
        while len(_POW) < n:
            k = np.uint64(pow(_BASE, len(_POW), 1 << 64))
            j = np.uint64(pow(_INV, len(_IPOW), 1 << 64))
            _POW, _IPOW = np.concatenate([_POW, _POW * k]), np.concatenate([_IPOW, _IPOW * j])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def hash_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in buf (bytes; words end at one space or 0xFF each) and their end offsets."""
    ends = np.flatnonzero((buf == 32) | (buf == 255))
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    out = np.empty(len(ends), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(ends):  # blocks of whole words, so that powers stay in cache
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20))))
            lo, hi = int(starts[at]), int(ends[to - 1])
            _powers(hi - lo + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf[lo:hi]] * _POW[: hi - lo])])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _IPOW[s] + (e - s).astype(np.uint64)
            at = to
    return mix(out), ends

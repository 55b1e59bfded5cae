"""Texts to records: chunks, a pluggable extractor with retries, answers, outcomes and the run log."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X

#: DDL of an array of records, for from_json.
RECORDS = "array<struct<" + ",".join(f"{f.name}:string" for f in S.RECORD.fields) + ">>"


class Extractor(Protocol):
    """Anything that answers a chunk of text; an empty answer or an exception (but MemoryError) is a failed attempt."""

    def __call__(self, chunk: str) -> str: ...


@dataclass(frozen=True)
class Options:
    """Settings of a run: words of a chunk, their overlap, its mode, calls at a time in each task, seconds that a call may take,
    attempts, back-off, pause between calls and policy."""

    max_words: int = 500
    overlap: int = 50
    chunk_mode: str = "compat"
    mode: str = "parallel"
    concurrent: int = 5
    timeout: float = 180.0
    attempts: int = 3
    backoff: float = 1.5
    delay: float = 0.0
    strict: bool = False


def chunks(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """file, chunk_id (from 1), chunk of texts (file, text)."""
    windows = X.chunk_words("text", options.max_words, options.overlap, options.chunk_mode)
    return texts.select("file", F.posexplode(windows).alias("pos", "chunk")).select("file", (F.col("pos") + 1).alias("chunk_id"), "chunk")


def prompt(instruction: str, text: Column | str) -> Column:
    """What a model is asked: the instruction and the text, one after the other."""
    return F.concat(F.lit(instruction), F.col(text) if isinstance(text, str) else text)


def answers(chunk_rows: DataFrame, make: Callable[[], Extractor], options: Options = Options()) -> DataFrame:
    """chunk rows with answer (null after the last failed attempt), attempts and seconds; make() is called in each task.

    A task has options.concurrent calls under way at a time, answers keep the order of chunks, and a call that takes longer
    than options.timeout is a failed attempt, which leaves its thread to it. Where a worker lacks threads or memory for a call,
    the task fails, not the attempt. There are as many tasks as the table has partitions; the mode 'sequential' makes one call
    after the other in a single task."""
    sequential = options.mode == "sequential"

    def one(ask: Extractor, own: threading.local, chunk: str) -> tuple[str | None, int, float]:
        began, answer, tries = time.time(), None, 0
        while not answer and tries < options.attempts:
            if tries:
                time.sleep(options.backoff * tries)
            tries += 1
            call = begun(ask, own, chunk) if options.timeout else None
            try:
                answer = (ask(chunk) if call is None else call.result(options.timeout)) or None
            except MemoryError:
                raise
            except Exception:  # noqa: BLE001  the outcome of the chunk says it
                answer = None
        if options.delay:
            time.sleep(options.delay)
        return answer, tries, time.time() - began

    def begun(ask: Extractor, own: threading.local, chunk: str) -> Future:
        if not hasattr(own, "call") or not own.call.done():  # the first call, or the one before hangs
            own.calls = ThreadPoolExecutor(1)
        own.call = own.calls.submit(ask, chunk)
        return own.call

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, width, own = make(), 1 if sequential else options.concurrent, threading.local()
        with ThreadPoolExecutor(width) as chunks_:
            for pdf in batches:
                rows = list(chunks_.map(lambda chunk: one(ask, own, chunk), pdf["chunk"]))
                yield pd.DataFrame({"file": pdf["file"], "chunk_id": pdf["chunk_id"], "answer": [r[0] for r in rows], "attempts": [r[1] for r in rows], "seconds": [r[2] for r in rows]})

    dealt = chunk_rows.coalesce(1) if sequential else chunk_rows
    return dealt.mapInPandas(run, "file string, chunk_id int, answer string, attempts int, seconds double")


def outcome(exists: Column, empty: Column, failed: Column, n_matches: Column, parsed: Column, strict: bool) -> Column:
    """What became of a file; failed is the array of chunk numbers without an answer."""
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(failed).cast("array<string>"), ", "), F.lit("]"))
    out = F.when(~exists, "file not found").when(empty, "empty file")
    if strict:
        out = out.when(F.size(failed) > 0, F.concat(F.lit("failed chunks "), listed))
    out = out.when(n_matches == 0, "no data extracted").when(~parsed, "parse failed")
    return out.when(F.size(failed) > 0, F.concat(F.lit("partial success (missing chunks "), listed, F.lit(")"))).otherwise("success")


def files(texts: DataFrame, answer_rows: DataFrame, options: Options = Options()) -> DataFrame:
    """file, further columns of texts, n_chunks, failed, seconds, records (null unless saved), status of each file, which has one
    row of texts.

    Objects of all answers are parsed together or not at all, in order of the chunks."""
    matches = X.json_objects("answer")
    per = answer_rows.withColumn("found", matches).groupBy("file").agg(
        F.count("*").cast("int").alias("n_chunks"), F.array_sort(F.collect_list(F.when(F.col("answer").isNull(), F.col("chunk_id")))).alias("failed"),
        F.sum("seconds").alias("seconds"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "found"))), lambda x: F.coalesce(x["found"], F.expr("cast(array() as array<string>)")))).alias("found"),
    )
    none = F.expr("cast(array() as array<int>)")
    about = texts.withColumns({"exists": F.col("text").isNotNull(), "empty": X.is_blank("text")}).drop("text")  # no text is shuffled
    rows = about.join(per, "file", "left").withColumns({"failed": F.coalesce("failed", none), "found": F.coalesce("found", F.expr("cast(array() as array<string>)"))})
    parsed = F.from_json(F.concat(F.lit("["), F.array_join("found", ",\n"), F.lit("]")), RECORDS)
    rows = rows.withColumn("records", F.when(F.size("found") > 0, parsed))
    status = outcome(F.col("exists"), F.col("empty"), F.col("failed"), F.size("found"), F.col("records").isNotNull(), options.strict)
    rows = rows.withColumn("status", status)
    saved = F.col("status").startswith("success") | F.col("status").startswith("partial")
    further = [c for c in texts.columns if c not in ("file", "text")]
    return rows.select("file", *further, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "failed", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.when(saved, F.col("records")).alias("records"), "status")


def run_log(done: DataFrame, mode: str = "parallel") -> DataFrame:
    return done.select(F.col("file").alias("File"), F.lit(mode).alias("Mode"), F.col("n_chunks").alias("Chunks"), F.round("seconds", 2).alias("Time (s)"), F.col("status").alias("Outcome"))


def log_summary(log: DataFrame) -> DataFrame:
    """files, chunks, seconds, succeeded, failed and partial of a run log."""
    status = F.regexp_replace("Outcome", r"^[^\p{L}]+", "")
    return log.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("Chunks"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.sum("Time (s)"), F.lit(0.0)).alias("seconds"),
        F.count_if(status == "success").alias("succeeded"), F.count_if(status.startswith("partial")).alias("partial"), F.count_if(status.startswith("failed") | status.startswith("parse")).alias("failed"),
    )


def pending(inputs: DataFrame, outputs: DataFrame, need_size: bool = False) -> DataFrame:
    """inputs (path) that have no output of that path yet; with need_size, an empty one does not count."""
    done = outputs.filter("size > 0") if need_size else outputs
    return inputs.join(done.select("path"), "path", "left_anti")

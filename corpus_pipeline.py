"""The corpus pipeline: documents through five operators, each stage written as Parquet and read by the next.

Every stage works on all documents that the one before kept, and on whole texts. All stages but the last return the columns
of documents; the last repeats rows and numbers them in `repetition`.

Nulls, empty texts, ties, repeated rows and extra columns are handled as the operators' docstrings say; a column of the
documents' that is named like one that a stage uses inside stays as it is. An empty table passes through every stage.

A stage first writes its decisions, a narrow table; what it broadcast and stored on the way then goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registerloom.llm import decontaminate, mixing, neardup, quality, secrets
from registerloom.llm._rows import checked_broadcast, discard, numbered, save, scope


def _without(rows: DataFrame, judge: Callable[[], DataFrame]) -> DataFrame:
    """rows, numbered in __loom_rid, without those whose numbers (rid) judge returns."""
    with scope():
        bad = save(judge().select(F.col("rid").alias("__loom_bad")), keep=True)
    return rows.join(checked_broadcast(bad), F.col("__loom_rid") == F.col("__loom_bad"), "left_anti").drop("__loom_rid")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    rows, labels = numbered(docs, "__loom_rid"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(rows, lambda: quality.classify(rows, labels).filter("not keep"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the first row of the smallest doc_id.

    Rows are judged by their texts: rows of one doc_id with different texts are documents of their own. A row without a
    doc_id goes if it is a near duplicate of any row that stays; documents without words stay.
    """
    rows = numbered(docs, "__loom_rid")
    return _without(rows, lambda: neardup.near_duplicates(rows).filter("not first"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, numbered in repetition."""
    return mixing.repeat_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: A language model's perplexities cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            discard(before)
        before = docs
    return docs

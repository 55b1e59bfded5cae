"""Queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, golden, importance, licenses, lmscore, mixing, neardup, quality, secrets, tokenfiles, tokens, topk, toxicity
from ._rows import shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("rid")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("rid")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rid")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), k=3, similarity=85).drop("rid", "first")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "extra")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(_documents(spark, sf_dir))


def op11_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_records(spark.read.parquet(f"{sf_dir}/clients.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


def op13_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, path = public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/loom-ids-{uuid.uuid4().hex}"
    tokenfiles.write(_documents(spark, sf_dir), path, tokenizer)
    return tokenfiles.digests(spark, path, tokenizer)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_licenses": op3_licenses,
        "op4_topk": op4_topk,
        "op5_lmscore": op5_lmscore,
        "op6_secrets": op6_secrets,
        "op7_quality": op7_quality,
        "op8_neardup": op8_neardup,
        "op9_mixing": op9_mixing,
        "op10_tokens": op10_tokens,
        "op11_golden": op11_golden,
        "op12_importance": op12_importance,
        "op13_tokenfiles": op13_tokenfiles,
    }


def oracle_sql() -> dict[str, str]:
    """Where DuckDB SQL can say the same; the other queries are tested against brute force."""
    return {"op4_topk": topk.SQL, "op8_neardup": neardup.SQL, "op11_golden": golden.SQL, "op12_importance": importance.SQL}

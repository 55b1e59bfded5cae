"""Rows keep their numbers, and operators their results, when files are dealt to tasks in another way."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from registerloom.llm import mixing, neardup
from registerloom.llm._rows import numbered

SF = "/root/testdata/sf0.001"
PACKINGS = ({}, {"spark.sql.leafNodeDefaultParallelism": "8"}, {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}, {"spark.sql.files.maxPartitionNum": "1"})


@pytest.fixture
def packed(spark):
    """Runs a function under each way of packing files."""

    def run(made, packings=PACKINGS):
        out = []
        for conf in packings:
            for k, v in conf.items():
                spark.conf.set(k, v)
            out.append(made())
            for k in conf:
                spark.conf.unset(k)
        return out

    return run


def test_numbers_do_not_move(spark, tmp_path, packed):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_metadata": F.lit("clash"), "__loom_row": F.lit(1)})
    docs.repartition(16).write.parquet(f"file://{tmp_path}/docs with ä")
    docs = spark.read.parquet(f"file://{tmp_path}/docs with ä")
    n = docs.count()
    for rows in (docs, docs.filter("doc_id % 3 > 0").select("doc_id", "text")):
        found = packed(lambda: {r.doc_id: r.rid for r in numbered(rows).select("doc_id", "rid").collect()})  # noqa: B023
        assert all(f == found[0] for f in found) and len(set(found[0].values())) == len(found[0])
    again = numbered(numbered(docs, "first").filter("doc_id % 2 = 0").withColumn("more", F.lit(1)))
    assert again.filter("first <> rid").count() == 0 and again.count()
    assert numbered(docs).columns == [*docs.columns, "rid"] and numbered(docs).count() == n
    shuffled = numbered(docs.repartition(5))
    assert {r.doc_id: r.rid for r in shuffled.collect()} == {r.doc_id: r.rid for r in shuffled.repartition(2).collect()}


def test_more_files_than_are_broadcast(spark, tmp_path, monkeypatch):
    from registerloom.llm import _rows

    monkeypatch.setattr(_rows, "NUMBERED_FILES", 2)
    spark.range(100).repartition(4).write.parquet(f"file://{tmp_path}/many")
    rows = numbered(spark.read.parquet(f"file://{tmp_path}/many"))
    assert {(r.id, r.rid) for r in rows.collect()} == {(r.id, r.rid) for r in numbered(rows.drop("rid")).repartition(7).collect()}
    assert rows.select("rid").distinct().count() == 100


def test_results_do_not_move(spark, tmp_path, packed):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(16).write.parquet(f"file://{tmp_path}/docs")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/docs")
    near = packed(lambda: Counter(map(tuple, neardup.near_duplicates(read(), k=3, similarity=85).collect())), PACKINGS[1:3])
    assert all(x == near[0] for x in near)
    mixed = packed(lambda: Counter((r.doc_id, r.repetition) for r in mixing.repeat_rows(read().withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))).collect()), PACKINGS[1:3])
    assert all(x == mixed[0] for x in mixed)

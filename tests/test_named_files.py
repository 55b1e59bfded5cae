"""The sink of named files: whole files of committed attempts only, where Spark reads them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from registerloom.sources import files, named


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_files_land_where_spark_reads(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", "ä\n"), ("b.txt", "b"), (None, "x"), ("c.txt", None), ("a/b/c/d.txt", "deep")], "path string, content string")
    for folder in (f"{tmp_path}/plain", f"file://{tmp_path}/uri", f"file:{tmp_path}/short"):
        files.write_named(rows, folder)
        assert {r["file"]: r["text"] for r in files.texts(spark, folder).collect()} == {"x.txt": "ä\n", "b.txt": "b", "d.txt": "deep"}
    assert found(tmp_path / "plain") == ["a/b/c/d.txt", "a/x.txt", "b.txt"]
    files.write_named(rows.select("path", F.encode("content", "UTF-8").alias("content")), f"{tmp_path}/bytes")
    assert (tmp_path / "bytes/a/x.txt").read_bytes() == "ä\n".encode()
    files.write_named(rows.limit(0), f"{tmp_path}/none")
    assert found(tmp_path / "none") == []


def test_merged_arrays(spark, tmp_path):
    files.write_merged(spark.range(10).select(F.to_json(F.struct("id")).alias("value")).repartition(3), str(tmp_path))
    assert len(found(tmp_path)) == 3
    assert sorted(x["id"] for f in found(tmp_path) for x in json.loads((tmp_path / f).read_text())) == list(range(10))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "there.txt").write_text("old")
    rows = spark.range(20).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") < 15, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).cast("string").alias("content"))
    with pytest.raises(Exception, match="broken"):
        files.write_named(rows.repartition(4), str(tmp_path))
    assert found(tmp_path) == ["there.txt"]
    with pytest.raises(Exception, match="not a path below"):
        files.write_named(spark.createDataFrame([("../x", "a")], "path string, content string"), str(tmp_path / "in"))
    assert found(tmp_path) == ["there.txt"]


def test_only_committed_attempts_appear(tmp_path):
    from pyspark.sql import Row

    writer = named.Writer(f"file://{tmp_path}", False)
    first = writer.write(iter([Row(path="a.txt", content="first"), Row(path="b.txt", content="lost")]))  # an attempt that Spark gives up
    second = writer.write(iter([Row(path="a.txt", content="second"), Row(path="a.txt", content="last")]))
    assert first.attempt != second.attempt
    assert all(f.startswith(".staging-") for f in found(tmp_path))
    writer.commit([second, None])
    assert found(tmp_path) == ["a.txt"] and (tmp_path / "a.txt").read_text() == "last"
    again = named.Writer(f"file://{tmp_path}", False)
    again.abort([again.write(iter([Row(path="c.txt", content="x")]))])
    assert found(tmp_path) == ["a.txt"]

"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What landed() has written, by application and key.
_LANDED: dict[tuple, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: iterations start from it without their history."""
    path = fresh(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files of tables: another stamp, another table."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path + "{,/*}")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def landed(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], write: Callable[[DataFrame, str], None]) -> DataFrame:
    """build() written by write and read back; once for each key in an application, so that queries share one landed table."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _LANDED:
        df, path = build(), fresh(spark, "landed")
        write(df, path)
        _LANDED[key] = spark.read.schema(df.schema).parquet(path)
    return _LANDED[key]

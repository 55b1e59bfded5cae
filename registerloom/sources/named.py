"""Files of given names, as a data source that Spark's write protocol drives.

A task writes to a folder of its own attempt; only what Spark commits is moved to its place, so a task that runs again, or
beside another attempt, leaves nothing. If the job fails, what was staged goes and no file has appeared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "named_files"
#: Files that the driver moves at a time.
MOVERS = 32


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of the file system that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return files, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and what is in it, as paths below it."""

    attempt: str
    paths: list[str]


class Writer(DataSourceWriter):
    """Writes rows (path, content) as files; or rows (value) as the elements of one JSON array for each task."""

    def __init__(self, folder: str, merged: bool) -> None:
        self.folder, self.merged = folder, merged
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = _opened(self.folder)
        attempt = f"{self.staging}/{uuid.uuid4().hex}"
        done = Written(attempt, [])

        def target(path: str) -> str:
            # a path may not leave the folder
            if not path or path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"not a path below the folder: {path!r}")
            place = f"{root}/{attempt}/{path}"
            files.create_dir(place.rsplit("/", 1)[0], recursive=True)
            done.paths.append(path)
            return place

        if self.merged:
            between = b"[\n"
            with files.open_output_stream(target(f"merged-{TaskContext.get().partitionId():05d}.json")) as out:
                for row in rows:
                    if row["value"] is not None:
                        out.write(between + row["value"].encode())
                        between = b",\n"
                out.write(b"\n]" if between == b",\n" else b"[]")
        else:
            for row in rows:
                if row["path"] is not None and row["content"] is not None:
                    with files.open_output_stream(target(row["path"])) as out:
                        out.write(row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"]))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.folder)
        files.create_dir(root, recursive=True)
        moves = [(f"{root}/{m.attempt}/{p}", f"{root}/{p}") for m in messages if m for p in dict.fromkeys(m.paths)]
        for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: files.move(*x), moves))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = _opened(self.folder)
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class NamedFiles(DataSource):
    """format('named_files'): writes only; option merged writes values as JSON arrays."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        need = ["value"] if self.options.get("merged") == "true" else ["path", "content"]
        if schema.names != need:
            raise ValueError(f"the columns are {', '.join(need)}")
        return Writer(self.options["path"], need == ["value"])


def save(rows: DataFrame, folder: str, merged: bool = False) -> None:
    """rows to folder, which may lie in any file system that Spark and pyarrow know; without a scheme, in Spark's default one."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    rows.write.format(NAME).mode("append").option("merged", str(merged).lower()).save(qualified(spark, folder))

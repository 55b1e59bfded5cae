"""Files that arrive in a folder, taken up once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def new_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, file, text of the text files in folder and below."""
    rows = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), X.basename(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def take_up(rows: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run handle on what is new since the last call and append its result to out; the checkpoint remembers what was done."""

    def batch(df: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own folder
        handle(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type of a stream of events (ts, event_type, value); an extension for timed sources."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rows import WORD, checked_broadcast, numbered, save, scope

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = 17
#: Documents in one bucket of a source's seeded order, on average, and buckets in one run of them.
BUCKET_ROWS, RUN_BUCKETS = 2048, 1024


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """sources with rank (from 0) in code-point order of name, nulls last, without one task for all of them."""
    dealt = save(
        sources.repartitionByRange(F.col(name).asc_nulls_last())
        .sortWithinPartitions(F.col(name).asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
    )
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # one row a partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    spark = sources.sparkSession
    order = Window.partitionBy("part").orderBy(F.col(name).asc_nulls_last())
    offset = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part int, offset long"))
    return dealt.withColumn("pos", F.row_number().over(order)).join(offset, "part").withColumn("rank", F.col("offset") + F.col("pos") - 1).drop("part", "pos", "offset")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (weight, source_size) with target: sizes are shared by weight, clamped at max_epochs sizes of the source;
    the excess is shared again by weight among the others until none is above its clamp.

    Each round is one aggregate of two numbers; a round clamps at least one more source, most rounds many.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(max_epochs)
    level = 0.0
    while True:
        held = F.col("weight") * F.lit(level) >= cap  # the level only rises: what was clamped stays clamped
        free, used, n = sources.agg(F.sum(F.when(~held, F.col("weight"))), F.sum(F.when(held, cap)), F.count(F.when(~held, 1))).first()
        if not n:
            break
        raised = max(level, (total - (used or 0.0)) / free)
        if raised == level or not sources.filter(~held & (F.col("weight") * F.lit(raised) > cap)).limit(1).count():
            level = raised
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """One boundary bucket: in seeded order, take each document that still fits in what is left of the extra words."""
    pdf = pdf.sort_values(["h", "size", "doc_id"], kind="stable", na_position="last")
    left, extra = float(pdf["left"].iloc[0]), []
    for size in pdf["size"]:
        extra.append(1 if size <= left else 0)
        left -= size * extra[-1]
    return pdf.assign(extra=extra)[["rid", "extra"]]


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """How often the mix repeats each document: doc_id, source, size, source_size, target, whole, extra, taken, rid.

    A source with target t and size s is repeated t/s times: floor(t/s) whole repetitions of every document, and one
    extra repetition of a seeded sample that holds the fraction's words. The sample is the start of the source's order by
    a seeded hash: hash buckets wholly before the cut are taken, those after it are not, and within the one bucket at the
    cut documents are taken as long as they fit, so that a source misses its target by less than one small document.
    A bucket holds about bucket_rows documents at any size of source, so no source meets in one task; rows that are the same
    in id and text fall into one bucket. No row is repeated more than max_epochs times, rounded up.

    Nulls: a null text has size 0, a null source is a source, sorted last; a null doc_id is a document like others, its
    place in the order then depends on its place in docs. Empty texts are taken whole times with 0 words. Repeated rows
    are documents of their own. An empty table gives none. rid numbers the rows of docs as read; other columns of docs are
    ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("rid").cast("string")))
    sizes = save(
        numbered(docs.select("doc_id", F.col("source").alias("src"), "text"))
        .select("doc_id", "src", word_count(F.col("text")).alias("size"), "rid", F.xxhash64(F.lit(seed), key, "text").alias("h"))
    )
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = save(water_fill(save(ranked(per, "src").withColumn("weight", pick)), max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumns({
        "whole": F.least(F.floor(epochs + 1e-12), F.lit(math.floor(max_epochs))).cast("long"),
        "n_buckets": F.ceil(F.col("n_docs") / bucket_rows).cast("long"),
    })
    left = F.col("target") - F.col("whole") * F.col("source_size")
    more = F.col("whole") < math.ceil(max_epochs)
    per = per.withColumn("extra_words", F.when(more, F.greatest(F.lit(0.0), F.floor(left + 1e-6).cast("double"))).otherwise(0.0))
    small = checked_broadcast(per.select("src", "source_size", "target", "whole", "extra_words", "n_buckets"))
    # the hash's upper bits in order: bucket b holds the b-th part of the seeded order
    unit = (F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53)))
    rows = sizes.join(small, sizes["src"].eqNullSafe(small["src"])).drop(small["src"]).withColumn("bucket", F.floor(unit * F.col("n_buckets")).cast("long"))
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"), F.first("extra_words").alias("extra_words"))
    buckets = save(buckets.withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS)))
    # words before each bucket: those of the runs before its own, and of the buckets before it in its run
    runs = buckets.groupBy("src", "run").agg(F.sum("words").alias("run_words"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("src").alias("r_src"), F.col("run").alias("r_run"), earlier("run_words", Window.partitionBy("src").orderBy("run")).alias("before_run"))
    buckets = buckets.withColumn("before", earlier("words", Window.partitionBy("src", "run").orderBy("bucket")))
    buckets = buckets.join(checked_broadcast(save(runs)), buckets["src"].eqNullSafe(F.col("r_src")) & (F.col("run") == F.col("r_run")))
    buckets = buckets.withColumn("left", F.col("extra_words") - F.col("before_run") - F.col("before")).filter("left > 0")
    buckets = save(buckets.select(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"), "left", (F.col("left") >= F.col("words")).alias("full")))
    cut = buckets.filter(~F.col("full"))
    on = lambda b: rows["src"].eqNullSafe(b["b_src"]) & (rows["bucket"] == b["b_bucket"])
    cut_rows = rows.join(checked_broadcast(cut), on(cut)).select("src", "bucket", "rid", "h", "size", "doc_id", "left")
    some = cut_rows.groupBy("src", "bucket").applyInPandas(_fill, "rid long, extra int")
    rows = rows.join(checked_broadcast(buckets.filter("full")), on(buckets), "left").join(checked_broadcast(save(some)), "rid", "left")
    extra = F.when(F.coalesce(F.col("full"), F.lit(False)), 1).otherwise(F.coalesce(F.col("extra"), F.lit(0))).cast("long")
    rows = rows.withColumn("extra", extra)
    taken = (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long")
    return rows.select("doc_id", F.col("src").alias("source"), "size", F.col("source_size").cast("long"), "target", "whole", "extra", taken.alias("taken"), "rid")


def repeat_rows(docs: DataFrame, number: str = "repetition", **options) -> DataFrame:
    """docs itself with every row as often as the mix takes it, numbered from 1 in column number.

    Where docs has a column of that name, it stays, and the numbers get the first free name of number_2, number_3 and so on.
    Nulls, empty texts, ties and repeated rows are taken as mix() says; an empty table gives no rows.
    """
    rows = numbered(docs, "__loom_row")
    with scope():
        plan = mix(rows, **options).select(F.col("rid").alias("__loom_rid"), (F.col("whole") + F.col("extra")).alias("__loom_n"))
        plan = save(plan.filter("__loom_n > 0"), keep=True)
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (number, *(f"{number}_{i}" for i in range(2, len(taken) + 3))) if n.lower() not in taken)
    rows = rows.join(checked_broadcast(plan), F.col("__loom_row") == F.col("__loom_rid"))
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__loom_n")))).drop("__loom_row", "__loom_rid", "__loom_n")

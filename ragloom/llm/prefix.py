"""Running totals and ranks over whole tables without gathering a key, or the table, in one task."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK = 4096


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The table written once in the shared folder and read again: it cuts the lineage, and what
    is read is the same however often it is read and whichever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def before(df: DataFrame, order: str, value: str, keys: list[str], out: str) -> DataFrame:
    """`out`: the total of `value` over the rows of the same `keys` with a smaller `order` (a
    whole number, different in each row of a key). Totals of runs of 4,096 numbers are summed
    apart, so that a task sorts one run, or one row per run."""
    run = F.floor(F.col(order) / CHUNK)
    df = df.withColumn("_run", run)
    within = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_run").agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(across), F.lit(0))).drop("_total")
    return df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [*keys, "_run"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_run", "_base", "_in")


def ranks(df: DataFrame, bucket: Column, order: list[Column], keys: list[str], out: str) -> DataFrame:
    """`out`: the place of each row, from 0, among the rows of the same `keys`, in the order of
    (bucket, order). `bucket` is a whole number that deals out a key's rows evenly."""
    df = df.withColumn("_bucket", bucket)
    counts = before(df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", "_n", keys, "_before").drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_place", place).join(counts, [*keys, "_bucket"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_bucket", "_place", "_before")




def labelled_sample(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` rows of a table of labels: those whose ids come first by hash."""
    labels = labels.where(F.col(id_col).isNotNull())
    return labels.orderBy(F.xxhash64(F.lit(7), F.col(id_col)), *[F.col(c) for c in labels.columns]).limit(most)

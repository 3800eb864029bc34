"""A small table's value beside every row of its key, whichever keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import written
from .textbytes import fresh, q

SENT_BYTES = 16 << 20  # of keys and values, sent to every executor
SHARE = 1000  # a key with more than one in so many of the rows is hot


def beside(rows: DataFrame, key: str, values: DataFrame, out: str) -> DataFrame:
    """`rows` with `out`: the `value` of the row of `values` (key, value; one row a key) that has the same
    `key`, null keys alike; null where there is none.

    Values of at most 16 MB, by measure, are sent to every executor. Beyond that only those of the keys that have more
    than a thousandth of the rows each are sent, which are fewer than a thousand; the other rows meet
    theirs in a shuffle, in which no key has more rows than that."""
    values = written(values.select("key", "value"), "values")
    k, v = fresh(rows, "key", "value")
    named = values.select(F.col("key").alias(k), F.col("value").alias(v))
    size = values.select(F.sum(F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + 32)).first()[0]
    if (size or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col(q(k))), "left").withColumn(out, F.col(q(v))).drop(k, v)
    counts = written(rows.groupBy(F.col(key).alias("key")).count(), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > total // SHARE).select("key")
    hot_values = values.join(F.broadcast(hot), values["key"].eqNullSafe(hot["key"]), "left_semi").select(F.col("key").alias(k), F.col("value").alias(v), F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot_values), F.col(key).eqNullSafe(F.col(q(k))), "left")
    done = marked.where("_hot").withColumn(out, F.col(q(v))).drop(k, v, "_hot")
    rest = marked.where("_hot is null").drop(k, v, "_hot")
    met = rest.join(named, F.col(key).eqNullSafe(F.col(q(k))), "left").withColumn(out, F.col(q(v))).drop(k, v)
    return done.unionByName(met)

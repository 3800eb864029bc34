"""Connected components of a table of links, as a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import written


def components(links: DataFrame, kind: str) -> DataFrame:
    """node, root for every node in `links` (a, b): root is the smallest node reachable.

    In each round every node goes to the node of the least hash within two links, itself included; a new
    hash each round makes the number of nodes left fall by a constant factor on average, on
    long chains too, and a star is done in one. The round's tables are written in the shared folder, so a lost
    executor costs one round."""
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    roots = written(nodes.select("node", F.col("node").alias("root")), "roots")
    step = 0
    while links.limit(1).count():
        step += 1
        hashed = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        own = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
        both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).union(links.select(F.col("b").alias("node"), F.col("a").alias("next"))).union(own.select("node", F.col("node").alias("next")))
        near = written(both.groupBy("node").agg(F.min(hashed("next")).alias("n")), "near")
        beyond = both.join(near.withColumnRenamed("node", "next"), "next")
        joins = written(beyond.groupBy("node").agg(F.min("n").alias("n")).select("node", F.col("n.to").alias("to")), "joins")
        roots = written(roots.join(joins, roots["root"] == joins["node"], "left").select(roots["node"], F.coalesce(joins["to"], roots["root"]).alias("root")), "roots")
        left = joins.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = joins.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(left, "a").join(right, "b").where("ta <> tb")
        links = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))

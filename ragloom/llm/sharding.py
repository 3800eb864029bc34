"""Dealing rows out to shards by proportional stratified interleaving.

Within each source the rows are ranked by a seeded hash. A row of rank r (from 0) among n of its source
has the fractional rank (r + 1/2) / n; sorting all rows by that puts the sources next to each other in
their proportions, and cutting the sorted rows at equal counts gives shards that all have the mixture
of the whole. The law that holds is `rows`: the shards' counts differ by one at most.

Both ranks come from counts of hash ranges and positions within a range, so a source that holds
most rows is ranked by many tasks. A null source is a source of its own. Null and empty texts are rows
like any other. Rows that are equal in id and text are interchangeable, and each gets a slot. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ranks, written
from .textbytes import q

BUCKET_ROWS = 1024


def shards(docs: DataFrame, n: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, source, law, shard, slot."""
    text = F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(q(id_col)).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(q(source_col)).cast("string").alias("source"))
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = written(rows, "sharding")
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    # the hash as a number from 0 up to buckets
    bucket = F.floor((F.shiftright(F.col("_hash"), 11) + F.lit(1 << 52)) * F.lit(buckets / (1 << 53))).cast("long")
    in_source = ranks(rows, bucket, [F.col("_hash"), F.col("doc_id"), F.col("text_crc32")], ["_source"], "_rank")
    sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    placed = in_source.join(sizes, "_source").withColumn("_at", (F.col("_rank") + 0.5) / F.col("_rows"))
    order = [F.col("_at"), F.xxhash64(F.lit(seed), "_source"), F.col("_source")]
    placed = ranks(placed, F.least(F.floor(F.col("_at") * buckets).cast("long"), F.lit(buckets - 1)), order, [], "_position")
    # exact for whole numbers: the first place of shard s is the least p with p * n >= s * total
    shard = F.expr(f"(_position * {n}L) div {max(total, 1)}L")
    begin = F.expr(f"(shard * {total}L + {n - 1}L) div {n}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_position") - begin).select("doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), "shard", "slot")

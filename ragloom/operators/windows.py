"""Window operators (W1-W7): the reference's sequential loops as ordered windows.

Skew: a plain ``Window.partitionBy(key)`` sorts a whole key in one task. Running totals here
cut the rows, in the order of (key, order), into chunks of about equal row count
(:func:`row_chunks`), so that a key with a third of all rows, even at a single time, is many
chunks. The window runs per (key, chunk), and what a key carries into a chunk comes from a
table with one row per chunk at most: only a chunk's first key can have begun earlier. The
sliding rate-limit count splits each key into time buckets and copies only the last window
length of every bucket into the next one; buckets with too many rows are counted by
positions instead. Top-n filters use ``row_number() <= n``, which Spark plans with a partial
WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


# --------------------------------------------------------------- chunked prefix aggregate
def row_chunks(df: DataFrame, keys: list[str], order: list, chunks: int | None = None) -> DataFrame:
    """The rows with ``__chunk``: their place among runs of about equal row count in the order of
    (keys, order), numbered along it. Rows equal in all of these share a chunk. The runs are the
    partitions of a range shuffle, as many as ``spark.sql.shuffle.partitions`` or ``chunks``, and
    written under the checkpoint folder: their numbers stay the same in every later read."""
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *_cols(keys), *_cols(order)).withColumn("__chunk", F.spark_partition_id())
    path = scratch_path(spark, "row-chunks")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def _in_chunk(keys: list[str], order: list):
    return (Window.partitionBy(*keys, "__chunk").orderBy(*_cols(order))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``carry`` (keys, __chunk, ...) beside the rows of its key and chunk; it has at most one
    row per chunk, so it is broadcast. Null keys match."""
    names = {c: f"__c_{c}" for c in [*keys, "__chunk"]}
    right = carry.select(*[F.col(c).alias(names.get(c, c)) for c in carry.columns])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return rows.join(F.broadcast(right), cond, "left").drop(*names.values())


def prefix_agg(df: DataFrame, keys: list[str], order: list, value: Column, how: str = "sum",
               inclusive: bool = True, out: str = "prefix", chunks: int | None = None) -> DataFrame:
    """Running sum / max of ``value`` per key in ``order`` (no keys: over the whole table).

    Rows before the current one in its chunk come from a window over (key, chunk); the earlier
    chunks contribute one carried-in value per chunk. Without an earlier value a sum is 0 and a
    max null."""
    if how not in ("sum", "max"):
        raise ValueError(how)
    fn = F.sum if how == "sum" else F.max
    d = row_chunks(df.withColumn("__v", value), keys, order, chunks)
    w = _in_chunk(keys, order)
    if not inclusive:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "__chunk").agg(fn("__v").alias("__t"))
    carry = totals.withColumn("__off", fn("__t").over(_earlier(keys))).drop("__t").filter("__off is not null")
    d = _with_carry(d.withColumn("__in", fn("__v").over(w)), carry, keys)
    if how == "sum":
        res = F.coalesce(F.col("__off"), F.lit(0)) + F.coalesce(F.col("__in"), F.lit(0))
    else:
        res = F.greatest(F.col("__off"), F.col("__in"))
    return d.withColumn(out, res).drop("__chunk", "__v", "__in", "__off")


# ------------------------------------------------------------------------------ W1
HOT_ROWS = 1 << 20  # rows of a (client, bucket) group beyond which it is counted by positions


def rate_limit(df: DataFrame, limit: int = 60, window_seconds: int = 60, client_col: str = "client_id",
               ts_col: str = "ts", id_col: str = "request_id", bucket_windows: int = 16,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per client, ``n`` = requests in (t - window, t] counting this one and every earlier
    one (denied ones included; equal times in id order); allowed iff n <= limit;
    remaining = max(0, limit - n).

    Each client is cut into buckets of ``bucket_windows`` window lengths; the rows in the
    last window length of a bucket are copied into the next bucket so every row sees
    its whole window inside its own (client, bucket) group. Groups of more than ``hot_rows``
    rows are never gathered: there ``n`` is the row's position less that of the last request at
    or before t - window, both from running counts over chunks of equal row count.
    """
    win_us = int(window_seconds) * 1_000_000
    span = win_us * int(bucket_windows)
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    b = F.floor(F.col("__us") / F.lit(span))
    # a row in the last window length of its bucket is also copied (as context) into the next one
    buckets = F.when(F.col("__us") >= (b + 1) * F.lit(span) - F.lit(win_us), F.array(b, b + 1)).otherwise(F.array(b))
    u = (df.withColumn("__us", us)
           .select("*", F.posexplode(buckets).alias("__pos", "__b"))
           .withColumn("__own", F.col("__pos") == 0).drop("__pos"))
    hot = u.groupBy(client_col, "__b").count().filter(F.col("count") > hot_rows).drop("count")
    if hot.isEmpty():
        out = _limit_in_groups(u, client_col, id_col, win_us)
    else:  # at most one such group in ``hot_rows`` rows
        hot = F.broadcast(hot.select(F.col(client_col).alias("__hc"), F.col("__b").alias("__hb")))
        cond = F.col(client_col).eqNullSafe(F.col("__hc")) & F.col("__b").eqNullSafe(F.col("__hb"))
        out = _limit_in_groups(u.join(hot, cond, "left_anti"), client_col, id_col, win_us).unionByName(
            _limit_by_position(u.join(hot, cond, "left_semi"), client_col, id_col, win_us))
    return (out.withColumn("allowed", F.col("n_in_window") <= limit)
               .withColumn("remaining", F.greatest(F.lit(limit) - F.col("n_in_window"), F.lit(0)))
               .drop("__us", "__b", "__own"))


def _limit_in_groups(u: DataFrame, client_col: str, id_col: str, win_us: int) -> DataFrame:
    w_range = Window.partitionBy(client_col, "__b").orderBy("__us").rangeBetween(-(win_us - 1), 0)
    w_peer = Window.partitionBy(client_col, "__b", "__us")
    w_peer_ord = w_peer.orderBy(F.col("__own").asc(), F.col(id_col).asc())
    n = (F.count(F.lit(1)).over(w_range)
         - (F.count(F.lit(1)).over(w_peer) - F.row_number().over(w_peer_ord)))
    return u.withColumn("n_in_window", n).filter("__own")


def _limit_by_position(u: DataFrame, client_col: str, id_col: str, win_us: int) -> DataFrame:
    """The same counts from two running counts: the row's own position, and, for a question put at
    t - window after all rows of that time, how many rows came before it."""
    keys = [client_col, "__b"]
    placed = prefix_agg(u, keys, ["__us", id_col], F.lit(1), out="__at")
    asked = placed.filter("__own").withColumn("__when", F.col("__us") - F.lit(win_us)).withColumn("__ask", F.lit(1))
    counted = u.select(*keys, F.col("__us").alias("__when"), F.lit(0).alias("__ask"))
    both = prefix_agg(asked.unionByName(counted, allowMissingColumns=True), keys, ["__when", "__ask", "__at"],
                      1 - F.col("__ask"), out="__past")
    return (both.filter("__ask = 1").withColumn("n_in_window", F.col("__at") - F.col("__past"))
                .drop("__at", "__when", "__ask", "__past"))


# ------------------------------------------------------------------------------ W2
def last_n_per_key(df: DataFrame, n: int = 1000, key_col: str = "name", ts_col: str = "ts",
                   seq_col: str = "seq") -> DataFrame:
    """The newest ``n`` rows per key (ties by seq). Planned with a partial group limit
    before the shuffle, so a hot key sends at most n rows per task."""
    w = Window.partitionBy(key_col).orderBy(F.col(ts_col).desc(), F.col(seq_col).desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


# ------------------------------------------------------------------------------ W3
def lru_evict(df: DataFrame, required: int, partition_cols: list[str] | None = None,
              ts_col: str = "last_accessed", key_col: str = "cache_key", size_col: str = "size_bytes") -> DataFrame:
    """Oldest ``last_accessed`` first (ties by key), evict while the space freed before
    the row is < ``required``. Returns the evicted rows with ``freed_before``."""
    ranked = prefix_agg(df, partition_cols or [], [ts_col, key_col], F.coalesce(F.col(size_col), F.lit(0)),
                        inclusive=False, out="freed_before")
    return ranked.filter(F.col("freed_before") < required)


# ------------------------------------------------------------------------------ W4
def evict_oldest(df: DataFrame, max_size: int, partition_cols: list[str] | None = None,
                 ts_col: str = "created_at", key_col: str = "cache_key") -> DataFrame:
    """When a cache holds n >= max_size entries, the n - max_size + 1 oldest go, so
    max_size - 1 remain. Returns the evicted rows: those whose position from the newest entry of
    their cache, a running count over chunks, is past max_size - 1."""
    newest = [F.col(ts_col).desc(), F.col(key_col).desc()]
    ranked = prefix_agg(df, partition_cols or [], newest, F.lit(1), out="__from_newest")
    return ranked.filter(F.col("__from_newest") > max(max_size - 1, 0)).drop("__from_newest")


# ------------------------------------------------------------------------------ W5
def counter_rate(df: DataFrame, key_cols: list[str], ts_col: str = "ts", counter_col: str = "total_requests") -> DataFrame:
    """Requests per second since the first sample: (counter - first counter) / elapsed
    seconds, 0 at elapsed 0. The first sample per key, of equal times that with the smallest
    counter, is a partial-aggregated min."""
    first = df.groupBy(*key_cols).agg(
        F.min(F.when(F.col(ts_col).isNotNull(), F.struct(F.col(ts_col).alias("__t0"), F.col(counter_col).alias("__c0")))).alias("__first"))
    d = df.join(first, key_cols, "inner")
    elapsed = (F.unix_micros(F.col(ts_col).cast("timestamp"))
               - F.unix_micros(F.col("__first.__t0").cast("timestamp"))) / 1e6
    return (d.withColumn("elapsed_s", elapsed)
             .withColumn("requests_per_sec",
                         F.when(F.col("elapsed_s") > 0, (F.col(counter_col) - F.col("__first.__c0")) / F.col("elapsed_s"))
                          .otherwise(F.lit(0.0)))
             .drop("__first"))


# ------------------------------------------------------------------------------ W6
def failure_streaks(df: DataFrame, threshold: int = 5, key_col: str = "key", ts_col: str = "ts",
                    seq_col: str = "seq", success_col: str = "success", chunks: int | None = None) -> DataFrame:
    """Consecutive failures per key in (ts, seq) order; a success resets the count to 0;
    ``tripped`` when the streak reaches ``threshold``.

    A segmented scan over chunks of equal row count: a chunk of a key is summed up as its number
    of rows, whether it has a success, and the rows since the last one. Two such chunks one after
    the other are summed up the same way, so the streak carried into a chunk is the rows since the
    last success of any earlier one. In the chunk the streak is the rows since its last success
    or, before its first, those plus the carried ones."""
    keys, order = [key_col], [ts_col, seq_col]
    d = row_chunks(df, keys, order, chunks)
    w = _in_chunk(keys, order)
    place, good = F.struct(*order), F.coalesce(F.col(success_col), F.lit(False))
    sums = d.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"), F.max(F.when(good, place)).alias("__last"))
    # only keys in several chunks carry anything: at most two rows per chunk
    several = sums.withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("__of > 1").drop("__of")
    beyond = _with_carry(d, several.select(*keys, "__chunk", "__last", F.lit(True).alias("__several")), keys)
    since = (beyond.filter(F.col("__several") & (F.col("__last").isNull() | (place > F.col("__last"))))
             .groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__since")))
    several = _with_carry(several, since, keys)
    upto = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("__n").over(upto)
    reset = F.when(F.col("__last").isNotNull(), end - F.coalesce(F.col("__since"), F.lit(0)))
    carry = (several.withColumn("__reset", reset)
             .withColumn("__off", F.sum("__n").over(_earlier(keys)) - F.coalesce(F.max("__reset").over(_earlier(keys)), F.lit(0)))
             .select(*keys, "__chunk", "__off").filter("__off > 0"))
    d = (d.withColumn("__pos", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
          .withColumn("__succ", F.max(F.when(good, F.col("__pos"))).over(w)))
    d = _with_carry(d, carry, keys)
    streak = F.col("__pos") - F.coalesce(F.col("__succ"), -F.coalesce(F.col("__off"), F.lit(0)))
    return (d.withColumn("streak", streak.cast("long")).withColumn("tripped", F.col("streak") >= threshold)
             .drop("__chunk", "__pos", "__succ", "__off"))


# ------------------------------------------------------------------------------ W7
def running_gauge(df: DataFrame, key_col: str = "name", ts_col: str = "ts", seq_col: str = "seq",
                  delta_col: str = "delta") -> DataFrame:
    """Current gauge value from +1/-1 deltas, a running sum per key."""
    return prefix_agg(df, [key_col], [ts_col, seq_col], F.col(delta_col), out="gauge")

"""Structured Streaming forms of the online operators (ST1-ST8).

Each function takes a streaming DataFrame and returns a streaming DataFrame (or starts a
query for the sinks). Windowed results come in append mode: a watermark closes a window, its
row is emitted once and its state dropped, so state is bounded by the lateness and results do
not depend on how rows are grouped into micro-batches. Rows later than the watermark are
dropped and counted (:class:`StreamRun`). Tables that streams keep up to date (ST7, ST8) are
written per micro-batch into the batch's own folder, so a replayed batch replaces its output.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.changes import insert_unique
from ..operators.predicates import threshold_alerts
from ..session import scratch_path


# ---------------------------------------------------------------------------- ST1
def rolling_metric_stats(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                         lateness: str = "10 minutes", ts_col: str = "ts", name_col: str = "name") -> DataFrame:
    """ST1: per metric and sliding window: count, min, max, avg, sum. In append mode a window's row
    is emitted once, when the watermark has passed its end, and its state is dropped."""
    return (samples.withWatermark(ts_col, lateness)
            .groupBy(F.window(ts_col, window, slide).alias("window"), name_col)
            .agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
                 F.avg("value").alias("avg"), F.sum("value").alias("sum")))


# ---------------------------------------------------------------------------- ST2
def stream_threshold_alerts(snapshots: DataFrame, **kw) -> DataFrame:
    """ST2: P7 applied to a stream (stateless, append)."""
    return threshold_alerts(snapshots, **kw)


# ---------------------------------------------------------------------------- ST3
RATE_OUT = T.StructType([T.StructField("client_id", T.StringType()), T.StructField("request_id", T.LongType()),
                         T.StructField("ts", T.TimestampType()), T.StructField("n_in_window", T.LongType()),
                         T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])
OUT_ROWS = 1 << 16  # rows handed back by a worker at once
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limit_stream(requests: DataFrame, limit: int = 60, window_seconds: int = 60,
                      lateness: str = "2 minutes", bucket_windows: int = 16) -> DataFrame:
    """ST3: the sliding-window limiter (W1), exact for requests that arrive out of order within
    ``lateness``. Like W1 a client is cut into buckets of ``bucket_windows`` window lengths: event-time windows,
    each of which begins one window length early, so that a bucket's first requests see those before them. Spark's
    own state holds a (client, bucket)'s requests until the watermark has passed its end; then they come out at once
    and are counted, many buckets of an Arrow batch together. Later requests whose bucket is still open count."""
    win, span = int(window_seconds), int(window_seconds) * int(bucket_windows)
    win_us, wide = win * 1_000_000, (span + 2 * win + 1) * 1_000_000
    bucket = F.window("ts", f"{span + win} seconds", f"{span} seconds", f"{span - win} seconds")
    request = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("request_id").cast("long").alias("id"))
    kept = (requests.withWatermark("ts", lateness).groupBy("client_id", bucket.alias("bucket"))
            .agg(F.collect_list(request).alias("rows"))
            .select("client_id", F.unix_micros(F.col("bucket.start").cast("timestamp")).alias("start"), "rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            of = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
            flat = rows.flatten()
            us, ids = flat.field(0).to_numpy(), flat.field(1)
            order = np.lexsort((pc.fill_null(ids, -1).to_numpy(), us, of))
            us, of, ids = us[order], of[order], ids.take(pa.array(order))
            since = us - batch.column(1).to_numpy()[of]
            place = of * wide + since
            n = np.arange(1, len(us) + 1) - np.searchsorted(place, place - win_us, "right")
            own = np.flatnonzero(since >= win_us)
            for a in range(0, len(own), OUT_ROWS):
                at = own[a:a + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of[at])), ids.take(pa.array(at)), pa.array(us[at]).cast(pa.timestamp("us", tz="UTC")),
                     pa.array(n[at]), pa.array(n[at] <= limit), pa.array(np.maximum(limit - n[at], 0))], names=RATE_OUT.names)

    return kept.mapInArrow(count, RATE_OUT)


# ---------------------------------------------------------------------------- ST4
STATE_BUCKETS = 1024  # groups of keys that share a state: a key costs no call and no state row of its own
TTL_STATE = T.StructType([T.StructField("expires", T.BinaryType())])  # a bucket's keys and when they expire


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[ns]").astype(np.int64) // 1000


def _misses(state, keys: np.ndarray, us: np.ndarray, ttl_us: int) -> np.ndarray:
    """Which rows, sorted by key and time, come after their key's entry expired or has none; each stores a new
    entry. The entries are the bucket's state, without those that the watermark has passed."""
    expires = pickle.loads(state.get[0]) if state.exists else {}
    out, key, until = np.zeros(len(us), bool), object(), None
    for i, (k, t) in enumerate(zip(keys.tolist(), us.tolist(), strict=True)):
        if k != key:
            key, until = k, expires.get(k)
        if until is None or t > until:
            until = expires[k] = t + ttl_us
            out[i] = True
    passed = state.getCurrentWatermarkMs() * 1000
    expires = {k: t for k, t in expires.items() if t >= passed}
    if expires:
        state.update((pickle.dumps(expires),))
        state.setTimeoutTimestamp(max(expires.values()) // 1000 + 1)
    elif state.exists:
        state.remove()
    return out


def _key_bucket(*key_cols: str):
    return F.pmod(F.xxhash64(*key_cols), F.lit(STATE_BUCKETS))


def dedup_within_ttl(stream: DataFrame, key_cols: list[str], ttl: str = "300 seconds", ts_col: str = "ts") -> DataFrame:
    """ST4 as de-duplication: the requests that :func:`ttl_cache_stream` counts as misses, with all
    their columns. Per key in the order of time, then of the other columns, a row is dropped until
    more than ``ttl`` after the last one kept, however the rows are grouped into micro-batches. Rows
    later than the watermark, ``ttl`` behind, are dropped; a null time is never kept. Keys share states
    by hash (:data:`STATE_BUCKETS`)."""
    ttl_us = int(pd.Timedelta(ttl).value // 1000)
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType)]
    null = {c: f"__null_{c}" for c in whole}  # pandas has no null in whole numbers
    order = [ts_col]
    for f in stream.schema.fields:
        if f.name != ts_col and isinstance(f.dataType, (T.NumericType, T.StringType)):
            order += [null[f.name], f.name] if f.name in null else [f.name]
    sent = stream.withWatermark(ts_col, ttl).select(
        *[F.coalesce(F.col(c), F.lit(0).cast(stream.schema[c].dataType)).alias(c) if c in null else F.col(c) for c in stream.columns],
        *[F.col(c).isNull().alias(n) for c, n in null.items()],
        F.to_json(F.struct(*key_cols)).alias("__key"), _key_bucket(*key_cols).alias("__bucket"))
    names = [c for c in sent.columns if c not in ("__key", "__bucket")]

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(pdfs), ignore_index=True).dropna(subset=[ts_col])
        batch = batch.sort_values(["__key", *order], kind="stable")
        yield batch[_misses(state, batch["__key"].to_numpy(), _micros(batch[ts_col]), ttl_us)][names]

    kept = (sent.groupBy("__bucket")
            .applyInPandasWithState(step, sent.select(names).schema, TTL_STATE, "append", GroupStateTimeout.EventTimeTimeout))
    return kept.select(*[F.when(~F.col(null[c]), F.col(c)).alias(c) if c in null else F.col(c) for c in stream.columns])


def ttl_cache_stream(requests: DataFrame, key_col: str, ttl_seconds: int = 300, ts_col: str = "ts",
                     id_col: str = "request_id", lateness: str = "10 minutes") -> DataFrame:
    """ST4 (exact): per key in (time, id) order, a request is a cache miss when no entry exists
    or the entry has expired (time > expiry, strict); a miss stores a new entry expiring
    ``ttl_seconds`` later, a hit leaves it. Emits every request with ``cache_hit``. Keys share states by hash
    (:data:`STATE_BUCKETS`); a key's entry is dropped from its state once the watermark has passed its expiry."""
    ttl_us = int(ttl_seconds) * 1_000_000
    out_schema = T.StructType([T.StructField(key_col, T.StringType()), T.StructField(id_col, T.LongType()),
                               T.StructField(ts_col, T.TimestampType()), T.StructField("cache_hit", T.BooleanType())])

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values([key_col, ts_col, id_col], kind="stable")
        missed = _misses(state, batch[key_col].to_numpy(), _micros(batch[ts_col]), ttl_us)
        yield batch[[key_col, id_col, ts_col]].assign(cache_hit=~missed)

    return (requests.withWatermark(ts_col, lateness).select(key_col, id_col, ts_col, _key_bucket(key_col).alias("__bucket"))
            .groupBy("__bucket")
            .applyInPandasWithState(step, out_schema, TTL_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ---------------------------------------------------------------------------- ST5
BREAKER_OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()),
                            T.StructField("ts", T.TimestampType()), T.StructField("decision", T.StringType()),
                            T.StructField("state", T.StringType()), T.StructField("failure_count", T.LongType())])
BREAKER_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("failures", T.LongType()),
                              T.StructField("last_failure_us", T.LongType())])


def breaker_step(state: str, failures: int, last_us: int, t_us: int, success: bool,
                 threshold: int, timeout_us: int):
    """One call through the breaker: returns (decision, state, failures, last_failure_us)."""
    if state == "OPEN":
        if t_us - last_us > timeout_us:
            state = "HALF_OPEN"
        else:
            return "rejected", state, failures, last_us
    if success:
        return "allowed", "CLOSED", 0, last_us
    failures += 1
    last_us = t_us
    if failures >= threshold:
        state = "OPEN"
    return "allowed", state, failures, last_us


def circuit_breaker_stream(calls: DataFrame, threshold: int = 5, timeout_seconds: float = 60.0,
                           lateness: str = "2 minutes") -> DataFrame:
    """ST5: CLOSED -> OPEN after ``threshold`` straight failures -> HALF_OPEN once more than
    ``timeout_seconds`` passed -> CLOSED on success / OPEN on failure; calls while OPEN are
    rejected and do not count. A key's state is kept however long the key is idle: no timeout is
    ever set, and the watermark only drops calls later than ``lateness``."""
    timeout_us = int(timeout_seconds * 1_000_000)

    def step(key, pdfs, state):
        st, fails, last = state.get if state.exists else ("CLOSED", 0, 0)
        # a key's calls of a micro-batch as three arrays, and its decisions in frames of OUT_ROWS
        parts = [(p["ts"].to_numpy("datetime64[ns]"), p["seq"].to_numpy(np.int64), p["success"].eq(True).to_numpy(bool)) for p in pdfs]
        ts, seq, ok = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, ts, np.isnat(ts)))
        for a in range(0, len(order), OUT_ROWS):
            at = order[a:a + OUT_ROWS]
            out = []
            for t, success in zip((ts[at].astype(np.int64) // 1000).tolist(), ok[at].tolist(), strict=True):
                decision, st, fails, last = breaker_step(st, int(fails), int(last), t, success, threshold, timeout_us)
                out.append((decision, st, int(fails)))
            if a + OUT_ROWS >= len(order):
                state.update((st, int(fails), int(last)))
            decisions, states, failures = zip(*out, strict=True)
            yield pd.DataFrame({"key": key[0], "seq": seq[at], "ts": ts[at], "decision": decisions, "state": states, "failure_count": failures})

    return (calls.withWatermark("ts", lateness).groupBy("key")
            .applyInPandasWithState(step, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# ---------------------------------------------------------------------------- ST6
def daily_trend_stream(generations: DataFrame, lateness: str = "1 day", ts_col: str = "created_at") -> DataFrame:
    """ST6: A4 online – tumbling one-day windows: count, average time, successes; in append mode a
    day is emitted once it is over by the watermark."""
    return (generations.withWatermark(ts_col, lateness)
            .groupBy(F.window(ts_col, "1 day").alias("window"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg("generation_time_ms").alias("avg_time"),
                 F.count_if(F.col("status") == "completed").alias("successful")))


# ---------------------------------------------------------------------------- ST7
def upsert_latest(samples: DataFrame, table_dir: str, checkpoint: str | None = None, compact_every: int = 50,
                  trigger: dict | None = None):
    """ST7: the latest value and the number of values per metric, kept in the table of
    :func:`latest_values`.

    A micro-batch is reduced to one row per name and written to its own folder ``batch=<id>``;
    these rows merge in any order (the newest by time and sequence, the sum of counts), so the
    stream needs no state, late rows need no watermark and a replayed batch changes nothing.
    Every ``compact_every`` batches what is there is merged into ``base=<id>`` and the folders
    that it covers are dropped."""
    spark = samples.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "latest-ckpt")

    def write_batch(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        if batch_id in _versions(s, table_dir, "base"):
            return  # replayed after it was merged
        newest = F.max(F.struct("ts", "seq", "value"))
        (batch.groupBy("name").agg(newest.alias("newest"), F.count(F.lit(1)).alias("total_values"))
         .write.mode("overwrite").parquet(f"{table_dir}/batch={batch_id}"))
        if (batch_id + 1) % compact_every == 0:
            _merged(s, table_dir).write.mode("overwrite").parquet(f"{table_dir}/base={batch_id}")
            _drop_versions(s, table_dir, [v for v in _versions(s, table_dir) if v <= batch_id])
            _drop_versions(s, table_dir, [v for v in _versions(s, table_dir, "base") if v < batch_id], "base")

    w = samples.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _merged(spark: SparkSession, table_dir: str, version: int | None = None) -> DataFrame:
    upto = float("inf") if version is None else version
    bases = [v for v in _versions(spark, table_dir, "base") if v <= upto]
    folders = [f"{table_dir}/base={v}" for v in bases[-1:]]
    folders += [f"{table_dir}/batch={v}" for v in _versions(spark, table_dir) if v <= upto and not (bases and v <= bases[-1])]
    if not folders:
        raise ValueError(f"nothing has been written to {table_dir} at version {version}")
    rows = spark.read.parquet(*folders)
    return rows.groupBy("name").agg(F.max("newest").alias("newest"), F.sum("total_values").alias("total_values"))


def latest_values(spark: SparkSession, table_dir: str, version: int | None = None) -> DataFrame:
    """The table that ST7 keeps: name, value, latest_ts, total_values, after the given batch (any
    that has not been merged into a later base) or after all."""
    return _merged(spark, table_dir, version).select("name", "newest.value", F.col("newest.ts").alias("latest_ts"), "total_values")


# ---------------------------------------------------------------------------- ST8
KEY_BUCKETS = 64


def continuous_ingest(stream: DataFrame, table_dir: str, key: str = "image_path", order_col: str | None = None,
                      checkpoint: str | None = None, trigger: dict | None = None, buckets: int = KEY_BUCKETS):
    """ST8: append each micro-batch's new keys (D1 against everything already written).

    Rows go to ``table_dir/run=<checkpoint>/batch=<id>`` and their keys, alone, to the key table
    ``table_dir``-keys, which is partitioned by key bucket. A micro-batch looks its keys up in the
    buckets that it touches: the scan joins those buckets, which prunes all others, and reads
    no other column of the table. A retried batch replaces its own folders and does not
    meet its own keys, so the sink stays exactly-once; a stream with another checkpoint has
    folders of its own."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ingest-checkpoint")
    table_dir = table_dir.rstrip("/")
    keys_dir, run = f"{table_dir}-keys", f"{zlib.crc32(checkpoint.encode()):08x}"

    def write_batch(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            if _exists(s, keys_dir):
                schema = T.StructType([batch.schema[key], T.StructField("run", T.StringType()),
                                       T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
                # at most ``buckets`` rows; the comparison marks them as a selection that prunes partitions
                touched = batch.select(bucket.alias("bucket")).distinct().filter("bucket >= 0")
                existing = (s.read.schema(schema).parquet(keys_dir)
                            .filter(~((F.col("run") == run) & (F.col("batch") == batch_id)))
                            .join(F.broadcast(touched), "bucket", "left_semi").select(key))
            else:
                existing = s.createDataFrame([], T.StructType([batch.schema[key]]))
            new, _rejected = insert_unique(existing, batch, key, order_col)
            out = f"{table_dir}/run={run}/batch={batch_id}"
            new.write.mode("overwrite").parquet(out)
            written = s.read.schema(batch.schema).parquet(out).select(key, bucket.alias("bucket"))
            written.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys_dir}/run={run}/batch={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


# ---------------------------------------------------------------------------- runners
@dataclass(frozen=True)
class StreamRun:
    """What a finished streaming query wrote, in how many micro-batches, and how many rows its
    stateful operators dropped as later than the watermark."""

    rows: DataFrame
    batches: int
    late_rows: int


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, outside the executors' heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def run_stream(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
               checkpoint: str | None = None, rocksdb: bool = False) -> StreamRun:
    """Run a streaming query over everything available. Its rows are read back from a folder
    under the shared checkpoint root: ``append`` has one folder per micro-batch, ``complete``
    rewrites one. ``rocksdb``: with its state in RocksDB, else in the store that the session names."""
    out = scratch_path(spark, f"{name}-out")

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else batch_id}")

    with rocksdb_state(spark) if rocksdb else nullcontext():
        q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    rows = spark.read.schema(stream.schema).parquet(out) if _versions(spark, out) else spark.createDataFrame([], stream.schema)
    batches = [p["batchId"] for p in q.recentProgress]
    return StreamRun(rows, len(set(batches)), dropped_late_rows(q))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", **kw) -> DataFrame:
    """The rows of :func:`run_stream`."""
    return run_stream(spark, stream, name, mode, **kw).rows


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


REPLAY_ROWS = 1_000_000


def replay(rows: DataFrame, name: str, ts_col: str = "ts", files: int = 3, closing: str | None = "1 day",
           jitter: str | None = None) -> DataFrame:
    """A table as a stream of one file per micro-batch, or several of about ``REPLAY_ROWS`` rows where that
    is not enough: cut into ``files`` by time (quantiles of
    ``ts_col``), the last followed by a closing row ``closing`` after the newest, null but for its
    time, which moves the watermark past every window. ``jitter`` moves rows into another file
    than their time's by up to so much, to arrive out of order."""
    spark = rows.sparkSession
    path = scratch_path(spark, f"{name}-replay")
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    if jitter:
        at = at + F.pmod(F.xxhash64(*rows.columns), F.lit(int(pd.Timedelta(jitter).value // 1000)))
    cuts = rows.select(at.alias("at")).approxQuantile("at", [i / files for i in range(1, files)], 0.001) if files > 1 else []
    each = max(1, ceil(rows.count() / (files * REPLAY_ROWS)))  # files of a micro-batch, written by a task each
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        some = rows
        some = some if low is None else some.filter(at > int(low))
        some = some if high is None else some.filter(at <= int(high))
        (some.coalesce(1) if each == 1 else some.repartition(each)).write.mode("append").parquet(path)
    if closing:
        last = rows.agg((F.max(ts_col) + F.expr(f"INTERVAL {closing}")).alias(ts_col))
        last.select(*[F.col(f.name) if f.name == ts_col else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in rows.schema.fields]).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, rows.schema, max_files=each)


# ---------------------------------------------------------------------------- ST3, distributed
def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def _versions(spark: SparkSession, root: str, kind: str = "batch") -> list[int]:
    """Ids of the complete ``root/<kind>=<id>`` folders (a directory listing, no data read)."""
    path, fs = _path(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith(f"{kind}=") and _exists(spark, f"{st.getPath()}/_SUCCESS"):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def _drop_versions(spark: SparkSession, root: str, ids: list[int], kind: str = "batch") -> None:
    for i in ids:
        path, fs = _path(spark, f"{root.rstrip('/')}/{kind}={i}")
        fs.delete(path, True)


def rate_limit_micro_batches(requests: DataFrame, out_dir: str, limit: int = 60, window_seconds: int = 60,
                             state_dir: str | None = None, checkpoint: str | None = None,
                             trigger: dict | None = None, client_col: str = "client_id", ts_col: str = "ts",
                             id_col: str = "request_id", lateness_seconds: int = 0):
    """ST3 without per-key state: every micro-batch is scored by the batch limiter
    together with the requests carried over from the previous batch, so a hot client is split
    like in batch. What is carried is a parquet table versioned by batch id; a replayed batch
    reads the same previous version and overwrites its own output and state, so results are
    exactly-once.

    ``lateness_seconds`` = 0: requests arrive in time order across batches (any order inside one),
    the last window is carried, and every request is scored in its own batch. More: requests may
    come out of order by so much; those newer than the newest less the lateness are held back in
    the carried table until no earlier one can come, and requests later than that are written to
    ``out_dir``-late/batch=<id> instead."""
    from ..operators.windows import rate_limit

    spark = requests.sparkSession
    state_dir = state_dir or scratch_path(spark, "rate-state")
    checkpoint = checkpoint or scratch_path(spark, "rate-ckpt")
    cols = [client_col, ts_col, id_col]

    def run(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        cur = batch.select(*cols).withColumn("__new", F.lit(True))
        earlier = [v for v in _versions(s, state_dir) if v < batch_id]
        back = F.expr(f"INTERVAL {int(lateness_seconds)} SECONDS")
        window = F.expr(f"INTERVAL {int(window_seconds)} SECONDS")
        done = None  # up to here everything has been scored
        if earlier:
            prev = s.read.parquet(f"{state_dir}/batch={earlier[-1]}").select(*cols).withColumn("__new", F.lit(False))
            if lateness_seconds:
                done = prev.agg(F.max(ts_col) - back).first()[0]
                cur.filter(F.col(ts_col) <= F.lit(done)).drop("__new").write.mode("overwrite") \
                    .parquet(f"{out_dir.rstrip('/')}-late/batch={batch_id}")
                cur = cur.filter(F.col(ts_col) > F.lit(done))
            rows = cur.unionByName(prev)
        else:
            rows = cur
        rows = rows.persist()  # one micro-batch, read by the scoring and the state write
        try:
            upto = rows.agg(F.max(ts_col) - back).first()[0]
            ready = rows.filter(F.col(ts_col) <= F.lit(upto)) if lateness_seconds else rows
            scored = rate_limit(ready, limit=limit, window_seconds=window_seconds, client_col=client_col,
                                ts_col=ts_col, id_col=id_col)
            if not lateness_seconds:
                scored = scored.filter("__new")
            elif done is not None:
                scored = scored.filter(F.col(ts_col) > F.lit(done))
            scored.drop("__new").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
            rows.filter(F.col(ts_col) > F.lit(upto) - window).select(*cols) \
                .write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")
        finally:
            rows.unpersist()
        _drop_versions(s, state_dir, earlier[:-1])

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def dropped_late_rows(query) -> int:
    """Rows the stateful operators dropped as later than the watermark, summed over the
    recorded progress of a streaming query."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else []:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total

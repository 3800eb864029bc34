"""Catalogue entries: streaming operators run with ``availableNow`` over the test tables read as
a file stream; results are written under the shared checkpoint root and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..streaming import online as S
from .catalog import register, ts_text
from .q_windows import _w1_sql


def replayed_events(spark, sf, name, **kw):
    """The events as a stream of three files in time order, then a closing row."""
    ev = A.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.replay(ev, name, **kw)


def event_stream(spark, sf):
    schema = A.read_table(spark, sf, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def sample_stream(spark, sf, name, **kw):
    return replayed_events(spark, sf, name, **kw).select(F.col("event_type").alias("name"), "value", "ts",
                                                         F.col("event_id").alias("seq"))


def request_stream(events):
    return events.select(F.col("event_id").alias("request_id"),
                         F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("client_id"), "ts")


@register("st1_rolling_metric_stats", """
WITH s AS (SELECT event_type AS name, value, CAST(ts AS TIMESTAMP) AS ts FROM events),
w AS (SELECT name, value, time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS window_start
      FROM s, (SELECT unnest(generate_series(0, 4)) AS k) g)
SELECT name, strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS count, min(value) AS min, max(value) AS max,
       round(avg(value), 6) AS avg, round(sum(value), 6) AS sum FROM w GROUP BY name, window_start""")
def st1_rolling_metric_stats(spark, sf):
    """Rolling windows in append mode over several micro-batches, rows out of order within the lateness."""
    samples = sample_stream(spark, sf, "st1", jitter="5 minutes")
    r = S.run_to_table(spark, S.rolling_metric_stats(samples), "st1")
    return r.select("name", ts_text(F.col("window.start")).alias("window_start"), "count", "min", "max",
                    F.round("avg", 6).alias("avg"), F.round("sum", 6).alias("sum"))


@register("st2_threshold_alerts", A.with_views("""
SELECT id, alert FROM (
  SELECT id, 'high_memory' AS alert FROM sysmetrics WHERE memory_mb > 1024
  UNION ALL SELECT id, 'high_cpu' AS alert FROM sysmetrics WHERE cpu_percent > 80) t""", "sysmetrics"))
def st2_threshold_alerts(spark, sf):
    ev = event_stream(spark, sf)
    k = F.get_json_object("props", "$.k").try_cast("double")
    snaps = ev.select(F.col("event_id").alias("id"), (k * 20.48).alias("memory_mb"),
                      (F.col("value") % 100).alias("cpu_percent"))
    r = S.run_to_table(spark, S.stream_threshold_alerts(snaps), "st2", mode="append")
    return r.select("id", "alert")


@register("st3_rate_limit", _w1_sql(60, 60))
def st3_rate_limit(spark, sf):
    """The limiter on a stream of several micro-batches, requests out of order within the lateness."""
    requests = request_stream(replayed_events(spark, sf, "st3", closing="3 days", jitter="100 seconds"))
    # clients make few requests here, so a bucket is a day and not 16 minutes
    r = S.run_to_table(spark, S.rate_limit_stream(requests, 60, 60, bucket_windows=1440), "st3", rocksdb=True)
    return r.select("request_id", "client_id", "n_in_window", "allowed", "remaining")


@register("st3_rate_limit_micro_batches", _w1_sql(60, 60))
def st3_rate_limit_micro_batches(spark, sf):
    """ST3 as micro-batches scored by the batch limiter, requests held back until none earlier can come."""
    from ..session import scratch_path
    requests = request_stream(replayed_events(spark, sf, "st3b", jitter="100 seconds"))
    out = scratch_path(spark, "st3b-out")
    S.rate_limit_micro_batches(requests, out, 60, 60, lateness_seconds=120).awaitTermination()
    return spark.read.parquet(out).select("request_id", "client_id", "n_in_window", "allowed",
                                          F.col("remaining").cast("long").alias("remaining"))


@register("st4_ttl_cache", """
WITH RECURSIVE c AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS query_key, event_id AS request_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT DISTINCT query_key, 0 AS rn, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS cache_hit,
         CAST(NULL AS BIGINT) AS expires FROM c
  UNION ALL
  SELECT c.query_key, c.rn, c.request_id,
         r.expires IS NOT NULL AND NOT (c.t > r.expires),
         CASE WHEN r.expires IS NOT NULL AND NOT (c.t > r.expires) THEN r.expires ELSE c.t + 86400000000 END
  FROM r JOIN c ON c.query_key = r.query_key AND c.rn = r.rn + 1)
SELECT query_key, request_id, cache_hit FROM r WHERE rn > 0""")
def st4_ttl_cache(spark, sf):
    """Repeated (user, event type) requests within a day-long cache TTL are cache hits."""
    ev = event_stream(spark, sf)
    req = ev.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("query_key"),
                    F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    r = S.run_to_table(spark, S.ttl_cache_stream(req, "query_key", ttl_seconds=86400), "st4", mode="append")
    return r.select("query_key", "request_id", "cache_hit")


@register("st4_dedup_within_ttl")
def st4_dedup_within_ttl(spark, sf):
    """Repeated (user, event type) requests within 300 seconds of the one kept are dropped; the tests
    compare the rows with the misses of the ST4 SQL."""
    ev = event_stream(spark, sf).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    r = S.run_to_table(spark, S.dedup_within_ttl(ev, ["user_id", "event_type"], "300 seconds"), "st4w", mode="append")
    return r.select("event_id", "user_id", "event_type")


ST5_SQL = """
WITH RECURSIVE c AS (
  SELECT 'svc' || CAST(user_id % 7 AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) AS t,
         event_type <> 'error' AS success,
         row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT DISTINCT key, 0 AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS decision,
         'CLOSED' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS last FROM c
  UNION ALL
  SELECT c.key, c.rn, c.seq,
         CASE WHEN r.state = 'OPEN' AND c.t - r.last <= 60000000 THEN 'rejected' ELSE 'allowed' END,
         CASE WHEN r.state = 'OPEN' AND c.t - r.last <= 60000000 THEN 'OPEN'
              WHEN c.success THEN 'CLOSED'
              WHEN r.failures + 1 >= 3 THEN 'OPEN'
              WHEN r.state = 'OPEN' THEN 'HALF_OPEN' ELSE r.state END,
         CASE WHEN r.state = 'OPEN' AND c.t - r.last <= 60000000 THEN r.failures
              WHEN c.success THEN 0 ELSE r.failures + 1 END,
         CASE WHEN r.state = 'OPEN' AND c.t - r.last <= 60000000 THEN r.last
              WHEN c.success THEN r.last ELSE c.t END
  FROM r JOIN c ON c.key = r.key AND c.rn = r.rn + 1)
SELECT key, seq, decision, state, failures AS failure_count FROM r WHERE rn > 0"""


@register("st5_circuit_breaker", ST5_SQL)
def st5_circuit_breaker(spark, sf):
    """Breaker decisions per service key; the oracle replays the state machine with a
    recursive query, one call per step."""
    ev = event_stream(spark, sf)
    calls = ev.select(F.col("event_id").alias("seq"),
                      F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("key"),
                      (F.col("event_type") != "error").alias("success"), F.col("ts").cast("timestamp").alias("ts"))
    r = S.run_to_table(spark, S.circuit_breaker_stream(calls, threshold=3, timeout_seconds=60), "st5", mode="append")
    return r.select("key", "seq", "decision", "state", "failure_count")


@register("st6_daily_trend", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS count, round(avg(value), 6) AS avg_time,
       count(*) FILTER (WHERE event_type <> 'error') AS successful
FROM events GROUP BY 1""")
def st6_daily_trend(spark, sf):
    """Days emitted in append mode once they are over by the watermark, from several micro-batches."""
    ev = replayed_events(spark, sf, "st6", closing="3 days", jitter="6 hours")
    g = ev.select(F.col("ts").alias("created_at"), F.col("value").alias("generation_time_ms"),
                  F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    r = S.run_to_table(spark, S.daily_trend_stream(g), "st6")
    return r.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "count",
                    F.round("avg_time", 6).alias("avg_time"), "successful")


@register("st7_latest_value", """
SELECT event_type AS name, arg_max(value, (ts, event_id)) AS value,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest_ts,
       count(*) AS total_values FROM events GROUP BY 1""")
def st7_latest_value(spark, sf):
    """The keyed table after several micro-batches that arrive out of order by days."""
    from ..session import scratch_path
    samples = sample_stream(spark, sf, "st7", files=5, closing=None, jitter="3 days")
    table = scratch_path(spark, "st7-table")
    S.upsert_latest(samples, table, compact_every=3).awaitTermination()
    return S.latest_values(spark, table).select("name", "value", ts_text("latest_ts").alias("latest_ts"), "total_values")


@register("st8_continuous_ingest", """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS image_path, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS n
FROM documents GROUP BY 1""")
def st8_continuous_ingest(spark, sf):
    """Every document streamed in under its own path, in several micro-batches and then once more by
    a second stream with its own checkpoint: each is inserted once."""
    from ..session import scratch_path
    docs = A.read_table(spark, sf, "documents")
    rows = docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
                       "doc_id", F.timestamp_micros(F.col("doc_id")).alias("ts"))
    stream = S.replay(rows, "st8", closing=None)
    table = scratch_path(spark, "st8-table")
    for _ in range(2):
        S.continuous_ingest(stream, table, key="image_path", order_col="doc_id").awaitTermination()
    return spark.read.parquet(table).groupBy("image_path").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))

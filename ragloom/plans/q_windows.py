"""Catalogue entries: window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_views
from ..operators import windows as W
from .catalog import register


def _w1_sql(limit, window_s):
    return with_views(f"""
SELECT request_id, client_id, n_in_window, n_in_window <= {limit} AS allowed,
       greatest({limit} - n_in_window, 0) AS remaining FROM (
  SELECT request_id, client_id,
         count(*) OVER (PARTITION BY client_id ORDER BY epoch_us(ts)
                        RANGE BETWEEN {window_s * 1_000_000 - 1} PRECEDING AND CURRENT ROW)
         - (count(*) OVER (PARTITION BY client_id, ts)
            - row_number() OVER (PARTITION BY client_id, ts ORDER BY request_id)) AS n_in_window
  FROM requests) t""", "requests")


def _w1(spark, sf, limit, window_s):
    r = W.rate_limit(A.requests(spark, sf), limit=limit, window_seconds=window_s)
    return r.select("request_id", "client_id", "n_in_window", "allowed", F.col("remaining").cast("long").alias("remaining"))


@register("w1_rate_limit", _w1_sql(60, 60))
def w1_rate_limit(spark, sf):
    """Every request scored by the 60-per-60 s sliding limiter, clients split by time bucket."""
    return _w1(spark, sf, 60, 60)


@register("w1_rate_limit_hourly", _w1_sql(2, 3600))
def w1_rate_limit_hourly(spark, sf):
    """The same operator with a limit that denies: 2 requests per hour per client."""
    return _w1(spark, sf, 2, 3600)


@register("w2_last_n_per_key", with_views("""
SELECT name, seq FROM (SELECT name, seq, row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) AS rn
                       FROM samples) t WHERE rn <= 100""", "samples"))
def w2_last_n_per_key(spark, sf):
    return W.last_n_per_key(A.metric_samples(spark, sf), 100).select("name", "seq")


@register("w3_lru_evict", with_views("""
SELECT cache_key, model_type, freed_before FROM (
  SELECT cache_key, model_type,
         CAST(coalesce(sum(size_bytes) OVER (PARTITION BY model_type ORDER BY last_accessed, cache_key
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before
  FROM cache) t WHERE freed_before < 5000000""", "cache"))
def w3_lru_evict(spark, sf):
    e = W.lru_evict(A.cache_entries(spark, sf), 5_000_000, partition_cols=["model_type"])
    return e.select("cache_key", "model_type", F.col("freed_before").cast("long").alias("freed_before"))


@register("w4_evict_oldest", with_views("""
SELECT cache_key, model_type FROM (
  SELECT cache_key, model_type, row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, cache_key DESC) AS rn
  FROM cache) t WHERE rn > 2899""", "cache"))
def w4_evict_oldest(spark, sf):
    return W.evict_oldest(A.cache_entries(spark, sf), 2900, partition_cols=["model_type"]).select("cache_key", "model_type")


@register("w5_counter_rate", with_views("""
SELECT name, seq, round(CASE WHEN el > 0 THEN (seq - s0) / el ELSE 0 END, 6) AS requests_per_sec FROM (
  SELECT name, seq, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY name))) / 1e6 AS el,
         first_value(seq) OVER (PARTITION BY name ORDER BY ts, seq) AS s0 FROM samples) t""", "samples"))
def w5_counter_rate(spark, sf):
    s = A.metric_samples(spark, sf).withColumn("total_requests", F.col("seq"))
    r = W.counter_rate(s, ["name"], counter_col="total_requests")
    return r.select("name", "seq", F.round("requests_per_sec", 6).alias("requests_per_sec"))


@register("w6_failure_streaks", with_views("""
, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS pos FROM calls),
d AS (SELECT *, max(CASE WHEN success THEN pos ELSE 0 END)
                OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last_succ FROM c)
SELECT key, seq, pos - last_succ AS streak, pos - last_succ >= 3 AS tripped FROM d""", "calls"))
def w6_failure_streaks(spark, sf):
    s = W.failure_streaks(A.calls(spark, sf), threshold=3)
    return s.select("key", "seq", "streak", "tripped")


@register("w7_running_gauge", """
SELECT key, seq, CAST(sum(delta) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gauge
FROM (SELECT 'svc' || CAST(user_id % 7 AS VARCHAR) AS key, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
             CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE -1 END AS delta FROM events) t""")
def w7_running_gauge(spark, sf):
    ev = A.read_table(spark, sf, "events")
    d = ev.select(F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("key"),
                  F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                  F.when(F.col("event_type").isin("click", "view", "signup"), 1).otherwise(-1).alias("delta"))
    g = W.running_gauge(d, key_col="key")
    return g.select("key", "seq", F.col("gauge").cast("long").alias("gauge"))

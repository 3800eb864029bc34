"""Catalogue entries: aggregations (A1-A15), O3 and D-style reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_views
from ..functions import registry as R
from ..functions.text import prometheus_labels
from ..operators import aggregates as G
from ..operators import predicates as P
from .catalog import register, ts_text
from .q_relational import DEFAULT_REGISTRY_SQL, GEN_ASOF, P10_SQL, latest, max_ts


def _r(c, n=6):
    return F.round(c, n)


@register("a1_summarize_annotations", with_views("""
, named AS (SELECT a.image_id, c.name FROM coco_ann a JOIN coco_cat c ON c.id = a.category_id),
per AS (SELECT image_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS categories,
               count(*) AS num_objects FROM named GROUP BY image_id)
SELECT i.id, coalesce(p.categories, '') AS categories, coalesce(p.num_objects, 0) AS num_objects
FROM coco_images i LEFT JOIN per p ON p.image_id = i.id""", "coco_images", "coco_ann", "coco_cat"))
def a1_summarize_annotations(spark, sf):
    s = G.summarize_annotations(A.coco_images(spark, sf), A.coco_annotations(spark, sf), A.coco_categories(spark, sf))
    return s.select("id", F.array_join("categories", ",").alias("categories"), "num_objects")


@register("a2_table_counts", with_views("""
SELECT 'images' AS "table", count(*) AS rows FROM images
UNION ALL SELECT 'embeddings', count(*) FROM vectors
UNION ALL SELECT 'generations', count(*) FROM generations
UNION ALL SELECT 'model_cache', count(*) FROM cache""", "images", "vectors", "generations", "cache"))
def a2_table_counts(spark, sf):
    return G.table_counts({"images": A.images(spark, sf), "embeddings": A.embeddings(spark, sf),
                           "generations": A.generations(spark, sf), "model_cache": A.cache_entries(spark, sf)})


@register("a3_success_rate", with_views("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status = 'completed') / count(*) * 100 ELSE 0 END, 6)
       AS success_rate
FROM generations""", "generations"))
def a3_success_rate(spark, sf):
    s = G.success_rate(A.generations(spark, sf))
    return s.select("total", "completed", _r(F.col("success_rate")).alias("success_rate"))


A4_SQL = f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS count,
       coalesce(avg(generation_time_ms), 0) AS avg_time,
       count(*) FILTER (WHERE status = 'completed') AS successful
FROM generations WHERE created_at > {GEN_ASOF} - INTERVAL 30 DAYS GROUP BY 1"""


@register("a4_generation_trends", with_views(f"""
SELECT strftime(date, '%Y-%m-%d') AS date, count, round(avg_time, 6) AS avg_time, successful,
       round(CASE WHEN count > 0 THEN successful / count * 100 ELSE 0 END, 6) AS success_rate
FROM ({A4_SQL}) t ORDER BY date""", "generations"))
def a4_generation_trends(spark, sf):
    """Daily generation trends over the last 30 days before the latest generation."""
    g = A.generations(spark, sf)
    t = G.generation_trends(g, 30, as_of=latest(g))
    return t.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count",
                    _r(F.col("avg_time")).alias("avg_time"), "successful",
                    _r(F.col("success_rate")).alias("success_rate"))


@register("a5_trends_summary", with_views(f"""
SELECT CAST(sum(count) AS BIGINT) AS total_generations, round(avg(count), 6) AS average_daily, max(count) AS peak_day,
       round(avg(avg_time), 6) AS average_generation_time, count(*) AS days
FROM ({A4_SQL}) t""", "generations"))
def a5_trends_summary(spark, sf):
    g = A.generations(spark, sf)
    s = G.trends_summary(G.generation_trends(g, 30, as_of=latest(g)))
    return s.select(F.col("total_generations").cast("long").alias("total_generations"),
                    _r(F.col("average_daily")).alias("average_daily"), "peak_day",
                    _r(F.col("average_generation_time")).alias("average_generation_time"), "days")


A6_SQL = """SELECT model_type, model_name, count(*) AS usage_count,
       round(avg((epoch_us((SELECT max(created_at) FROM vectors)) - epoch_us(created_at)) / 3.6e9), 6) AS hours_ago
FROM vectors GROUP BY model_type, model_name"""


@register("a6_embedding_model_usage", with_views(A6_SQL, "vectors"))
def a6_embedding_model_usage(spark, sf):
    v = A.embeddings(spark, sf)
    u = G.embedding_model_usage(v, as_of=max_ts(v))
    return u.select("model_type", "model_name", "usage_count", _r(F.col("hours_ago")).alias("hours_ago"))


@register("o3_top_models", with_views(f"""
SELECT * FROM ({A6_SQL}) t ORDER BY usage_count DESC, model_type, model_name LIMIT 5""", "vectors"))
def o3_top_models(spark, sf):
    v = A.embeddings(spark, sf)
    u = G.embedding_model_usage(v, as_of=max_ts(v))
    u = u.select("model_type", "model_name", "usage_count", _r(F.col("hours_ago")).alias("hours_ago"))
    return u.orderBy(F.col("usage_count").desc(), "model_type", "model_name").limit(5)


@register("a7_generation_model_usage", with_views("""
SELECT model_config ->> 'k' AS model_name, count(*) AS usage_count FROM generations
WHERE model_config IS NOT NULL AND model_config ->> 'k' IS NOT NULL GROUP BY 1""", "generations"))
def a7_generation_model_usage(spark, sf):
    return G.generation_model_usage(A.generations(spark, sf), key="k")


@register("a8_database_stats", with_views("""
SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM vectors) AS embeddings,
       (SELECT count(*) FROM generations) AS generations, (SELECT count(*) FROM cache) AS cache_entries,
       least((SELECT count(*) FROM generations), 5) AS recent_generations,
       round((SELECT coalesce(avg(generation_time_ms), 0) FROM generations), 6) AS avg_generation_time_ms""",
                                           "images", "vectors", "generations", "cache"))
def a8_database_stats(spark, sf):
    s = G.database_stats(A.images(spark, sf), A.embeddings(spark, sf), A.generations(spark, sf),
                         A.cache_entries(spark, sf))
    return s.withColumn("avg_generation_time_ms", _r(F.col("avg_generation_time_ms")))


@register("a9_latest_metric_values", with_views("""
SELECT name, arg_max(value, (ts, seq)) AS latest_value, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest_ts,
       '{user="' || arg_max(label_user, (ts, seq)) || '"}' AS latest_labels, count(*) AS total_values
FROM samples GROUP BY name""", "samples"))
def a9_latest_metric_values(spark, sf):
    l = G.latest_metric_values(A.metric_samples(spark, sf))
    return l.select("name", "latest_value", ts_text("latest_ts").alias("latest_ts"), prometheus_labels("latest_labels").alias("latest_labels"),
                    "total_values")


@register("a10_metric_window_stats", with_views(f""", {DEFAULT_REGISTRY_SQL},
reg AS (SELECT name FROM registry UNION SELECT DISTINCT name FROM samples),
recent AS (SELECT * FROM samples WHERE ts >= (SELECT max(ts) FROM samples) - INTERVAL 1440 MINUTES),
st AS (SELECT name, count(*) AS count, min(value) AS min, max(value) AS max, avg(value) AS avg, sum(value) AS sum
       FROM recent GROUP BY name)
SELECT r.name, coalesce(st.count, 0) AS count, st.min, st.max, round(st.avg, 6) AS avg,
       round(coalesce(st.sum, 0), 6) AS sum, 1440 AS window_minutes
FROM reg r LEFT JOIN st ON st.name = r.name""", "samples"))
def a10_metric_window_stats(spark, sf):
    samples = A.metric_samples(spark, sf)
    reg = R.effective_registry(R.default_registry(spark), samples)
    s = G.metric_window_stats(samples, reg, minutes=1440, as_of=latest(samples, "ts"))
    return s.select("name", "count", "min", "max", _r(F.col("avg")).alias("avg"), _r(F.col("sum")).alias("sum"),
                    "window_minutes")


def _perf_cols(prefix=""):
    return (f"count(*) AS n, round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration, "
            f"min(duration) AS min_duration, round(avg(memory_after - memory_before), 6) AS avg_memory_delta, "
            f"round(max(memory_after - memory_before), 6) AS max_memory_delta, round(avg(cpu_percent), 6) AS avg_cpu, "
            f"round(max(cpu_percent), 6) AS max_cpu")


@register("a11_performance_summary", with_views(f"""
SELECT 'overall' AS level, CAST(NULL AS VARCHAR) AS component, {_perf_cols()} FROM operations
UNION ALL
SELECT 'component' AS level, component, {_perf_cols()} FROM operations GROUP BY component""", "operations"))
def a11_performance_summary(spark, sf):
    """Overall and per-component operation summary in one grouping-sets pass."""
    s = G.performance_summary(A.operations(spark, sf))
    return s.select("level", "component", "n", _r(F.col("avg_duration")).alias("avg_duration"), "max_duration",
                    "min_duration", _r(F.col("avg_memory_delta")).alias("avg_memory_delta"),
                    _r(F.col("max_memory_delta")).alias("max_memory_delta"), _r(F.col("avg_cpu")).alias("avg_cpu"),
                    _r(F.col("max_cpu")).alias("max_cpu"))


@register("a12_error_stats", with_views("""
, e AS (SELECT component || '_' || operation AS component_operation, * FROM errors),
t1 AS (SELECT component_operation, error_type, count(*) AS n FROM e GROUP BY ALL),
t2 AS (SELECT component_operation, severity, count(*) AS n FROM e GROUP BY ALL)
SELECT b.component_operation, b.total, strftime(b.last_error, '%Y-%m-%d %H:%M:%S.%f') AS last_error,
  (SELECT string_agg(error_type || ':' || n, ',' ORDER BY error_type) FROM t1 WHERE t1.component_operation = b.component_operation) AS by_error_type,
  (SELECT string_agg(severity || ':' || n, ',' ORDER BY severity) FROM t2 WHERE t2.component_operation = b.component_operation) AS by_severity
FROM (SELECT component_operation, count(*) AS total, max(ts) AS last_error FROM e GROUP BY 1) b""", "errors"))
def a12_error_stats(spark, sf):
    s = G.error_stats(A.error_events(spark, sf))

    def flat(c):
        return F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")

    return s.select("component_operation", "total", ts_text("last_error").alias("last_error"), flat(F.col("by_error_type")).alias("by_error_type"),
                    flat(F.col("by_severity")).alias("by_severity"))


@register("a13_cache_stats", with_views("""
SELECT model_type, count(*) AS misses, CAST(sum(access_count) AS BIGINT) AS hits,
       CAST(sum(CASE WHEN device = 'cpu' THEN size_bytes ELSE 0 END) AS BIGINT) AS cpu_bytes,
       CAST(sum(CASE WHEN device <> 'cpu' THEN size_bytes ELSE 0 END) AS BIGINT) AS gpu_bytes,
       array_to_string(list_sort(list_distinct(list(model_name))), ',') AS model_names,
       CAST(sum(access_count) + count(*) AS BIGINT) AS requests,
       round(sum(access_count) / (sum(access_count) + count(*)), 6) AS hit_rate,
       round(sum(access_count) / (sum(access_count) + count(*)) * 100, 6) AS hit_rate_percent
FROM cache GROUP BY model_type""", "cache"))
def a13_cache_stats(spark, sf):
    s = G.cache_stats(A.cache_entries(spark, sf))
    return s.select("model_type", "misses", "hits", "cpu_bytes", "gpu_bytes",
                    F.array_join("model_names", ",").alias("model_names"), "requests",
                    _r(F.col("hit_rate")).alias("hit_rate"), _r(F.col("hit_rate_percent")).alias("hit_rate_percent"))


@register("a13_cache_model_names", with_views("""
SELECT DISTINCT model_type, model_name FROM cache WHERE model_name IS NOT NULL""", "cache"))
def a13_cache_model_names(spark, sf):
    return G.cache_model_names(A.cache_entries(spark, sf))


STATUS_COLS = ["system_status", "memory_status", "cpu_status", "disk_status", "gpu_status", "cache_status"]


@register("a14_health_rollup", f"""
WITH p AS (SELECT * FROM ({P10_SQL}) x),
comp AS (SELECT p.id, s.component FROM p JOIN ({A.SYSTEM_METRICS_SQL}) s ON s.id = p.id),
l AS (SELECT c.component, unnest([p.system_status, p.memory_status, p.cpu_status, p.disk_status, p.gpu_status,
                                  p.cache_status]) AS status FROM p JOIN comp c ON c.id = p.id)
SELECT component, count(*) AS total_checks,
       count(*) FILTER (WHERE status = 'healthy') AS healthy_checks,
       count(*) FILTER (WHERE status = 'warning') AS warning_checks,
       count(*) FILTER (WHERE status = 'critical') AS critical_checks,
       count(*) FILTER (WHERE status = 'unknown') AS unknown_checks,
       CASE max(CASE status WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'healthy' THEN 1 ELSE 0 END)
            WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'healthy' ELSE 'unknown' END AS overall_status
FROM l GROUP BY component""")
def a14_health_rollup(spark, sf):
    c = P.classify_thresholds(A.system_metrics(spark, sf))
    long = G.checks_long(c, STATUS_COLS, ["component"])
    return G.health_rollup(long, ["component"])


@register("a15_table_health", with_views(f""",
req AS (SELECT * FROM (VALUES ('images'), ('embeddings'), ('generations'), ('model_cache'), ('system_metrics'),
                              ('user_sessions')) v("table")),
stats AS (
  SELECT 'images' AS "table", count(*) AS rows,
         count(*) FILTER (WHERE created_at > {GEN_ASOF} - INTERVAL 24 HOURS) AS recent_rows FROM images
  UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (WHERE created_at > {GEN_ASOF} - INTERVAL 24 HOURS) FROM vectors
  UNION ALL SELECT 'generations', count(*), count(*) FILTER (WHERE created_at > {GEN_ASOF} - INTERVAL 24 HOURS) FROM generations
  UNION ALL SELECT 'model_cache', count(*), count(*) FILTER (WHERE last_accessed > {GEN_ASOF} - INTERVAL 24 HOURS) FROM cache
  UNION ALL SELECT 'system_metrics', count(*), count(*) FILTER (WHERE created_at > {GEN_ASOF} - INTERVAL 24 HOURS) FROM sysmetrics),
t AS (SELECT r."table", s.rows, s.recent_rows, s.rows IS NOT NULL AS "exists",
        CASE WHEN s.rows IS NULL THEN 'missing table'
             WHEN r."table" = 'images' AND s.rows = 0 THEN 'no images: run the ingest'
             WHEN s.recent_rows = 0 THEN 'no activity in the last 24 hours' END AS issue
      FROM req r LEFT JOIN stats s ON s."table" = r."table")
SELECT *, count(issue) OVER () AS failed_checks,
       CASE WHEN count(issue) OVER () = 0 THEN 'healthy' WHEN count(issue) OVER () <= 2 THEN 'warning' ELSE 'critical' END
       AS overall_status
FROM t""", "images", "vectors", "generations", "cache", "sysmetrics"))
def a15_table_health(spark, sf):
    g = A.generations(spark, sf)
    as_of = max_ts(g)
    cutoff = as_of - P.interval(24, "hours")
    tables = {"images": (A.images(spark, sf), "created_at"), "embeddings": (A.embeddings(spark, sf), "created_at"),
              "generations": (g, "created_at"), "model_cache": (A.cache_entries(spark, sf), "last_accessed"),
              "system_metrics": (A.system_metrics(spark, sf), "created_at")}
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts) > cutoff).alias("recent_rows"))
             .select(F.lit(name).alias("table"), "rows", "recent_rows") for name, (df, ts) in tables.items()]
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    required = spark.createDataFrame([(t,) for t in G.REQUIRED_TABLES], "table string")
    return G.table_health(required, stats)

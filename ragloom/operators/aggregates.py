"""Aggregations (A1-A16). All are hash aggregates with a partial (map-side) phase, so a hot
group is reduced inside each task before anything is shuffled; collected arrays are
only ever built over bounded domains (category names, error types, model names)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hours_between
from .joins import annotate_categories
from .predicates import CRITICAL, HEALTHY, UNKNOWN, WARNING, as_of_col, cutoff, filter_recent


# ------------------------------------------------------------------------------ A1
def summarize_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """A1: per image, the sorted distinct category names and the number of annotations;
    images without annotations get an empty list and 0 (J2 + J3)."""
    named = annotate_categories(annotations, categories)
    per_image = named.groupBy("image_id").agg(
        F.sort_array(F.collect_set("category_name")).alias("categories"),
        F.count(F.lit(1)).alias("num_objects"))
    return (images.join(per_image.withColumnRenamed("image_id", "id"), "id", "left")
            .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
            .withColumn("num_objects", F.coalesce("num_objects", F.lit(0))))


# ------------------------------------------------------------------------------ A2
def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A2: COUNT(*) per named table as (table, rows)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------------------ A3
def success_rate(df: DataFrame, status_col: str = "status") -> DataFrame:
    """A3: completed / total x 100; 0 when there are no rows."""
    total = F.count(F.lit(1))
    ok = F.count_if(F.col(status_col) == "completed")
    return df.agg(total.alias("total"), ok.alias("completed")).withColumn(
        "success_rate", F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100).otherwise(F.lit(0.0)))


# ------------------------------------------------------------------------------ A4/A5
def generation_trends(df: DataFrame, days: int = 30, as_of=None, ts_col: str = "created_at",
                      time_col: str = "generation_time_ms", status_col: str = "status") -> DataFrame:
    """A4: per calendar day of the last ``days`` days (strict cutoff): count, average time
    (null -> 0), successes, success rate %; ordered by date; empty days are absent."""
    recent = filter_recent(df, days, "days", as_of, ts_col)
    agg = recent.groupBy(F.to_date(ts_col).alias("date")).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.avg(time_col), F.lit(0.0)).alias("avg_time"),
        F.count_if(F.col(status_col) == "completed").alias("successful"))
    return agg.withColumn("success_rate", F.when(F.col("count") > 0, F.col("successful") / F.col("count") * 100)
                          .otherwise(F.lit(0.0))).orderBy("date")


def trends_summary(trends: DataFrame) -> DataFrame:
    """A5: total, mean per present day, peak day count, unweighted mean of the daily averages."""
    return trends.agg(
        F.sum("count").alias("total_generations"),
        F.avg("count").alias("average_daily"),
        F.max("count").alias("peak_day"),
        F.avg("avg_time").alias("average_generation_time"),
        F.count(F.lit(1)).alias("days"))


# ------------------------------------------------------------------------------ A6/A7
def embedding_model_usage(df: DataFrame, as_of=None) -> DataFrame:
    """By (model_type, model_name): count and average age in hours; most used first."""
    return (df.groupBy("model_type", "model_name")
              .agg(F.count(F.lit(1)).alias("usage_count"),
                   F.avg(hours_between(as_of_col(as_of), F.col("created_at"))).alias("hours_ago"))
              .orderBy(F.col("usage_count").desc(), "model_type", "model_name"))


def generation_model_usage(df: DataFrame, key: str = "model_name", config_col: str = "model_config") -> DataFrame:
    """By ``model_config ->> key`` over rows with a config; null names dropped; most used first."""
    name = F.get_json_object(F.col(config_col), f"$.{key}")
    return (df.filter(F.col(config_col).isNotNull())
              .groupBy(name.alias("model_name")).agg(F.count(F.lit(1)).alias("usage_count"))
              .filter(F.col("model_name").isNotNull())
              .orderBy(F.col("usage_count").desc(), "model_name"))


# ------------------------------------------------------------------------------ A8
def database_stats(images: DataFrame, embeddings: DataFrame, generations: DataFrame,
                   cache: DataFrame, recent_limit: int = 5) -> DataFrame:
    """Four table counts, min(5, n) recent generations and the average generation time
    (null -> 0), as one row."""
    spark = images.sparkSession

    def n(d):
        return d.select(F.count(F.lit(1))).scalar()

    avg_time = generations.select(F.coalesce(F.avg("generation_time_ms"), F.lit(0.0))).scalar()
    return spark.range(1).select(
        n(images).alias("images"), n(embeddings).alias("embeddings"), n(generations).alias("generations"),
        n(cache).alias("cache_entries"), F.least(n(generations), F.lit(recent_limit)).alias("recent_generations"),
        avg_time.alias("avg_generation_time_ms"))


# ------------------------------------------------------------------------------ A9
def latest_metric_values(samples: DataFrame, name_col: str = "name", ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """Per metric the latest sample (by time, then arrival sequence) and the number of samples."""
    latest = F.max_by(F.struct(F.col("value"), F.col(ts_col).alias("latest_ts"), F.col("labels")),
                      F.struct(F.col(ts_col), F.col(seq_col)))
    return (samples.groupBy(name_col).agg(latest.alias("__l"), F.count(F.lit(1)).alias("total_values"))
            .select(name_col, F.col("__l.value").alias("latest_value"), F.col("__l.latest_ts").alias("latest_ts"),
                    F.col("__l.labels").alias("latest_labels"), "total_values"))


# ------------------------------------------------------------------------------ A10
def metric_window_stats(samples: DataFrame, registry: DataFrame, minutes: int = 5, as_of=None,
                        name_col: str = "name") -> DataFrame:
    """A10: per registered metric, count/min/max/avg/sum of all samples with ts >= as_of - minutes;
    no samples -> count 0, sum 0, others null.

    The time filter runs first (it reaches the scan); every aggregate has a map-side phase.
    Names missing from the registry get ``error`` = 'Metric … not found'."""
    recent = samples.filter(F.col("ts") >= cutoff(as_of, minutes, "minutes"))
    stats = recent.groupBy(name_col).agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("avg"), F.sum("value").alias("sum"))
    out = registry.select(name_col).join(stats, name_col, "left")
    return (out.withColumn("count", F.coalesce("count", F.lit(0)))
               .withColumn("sum", F.coalesce("sum", F.lit(0.0)))
               .withColumn("window_minutes", F.lit(minutes)))


def unknown_metric_errors(requested: DataFrame, registry: DataFrame, name_col: str = "name") -> DataFrame:
    """A10 error rows for requested names that are not registered."""
    return (requested.select(name_col).distinct().join(registry.select(name_col), name_col, "left_anti")
            .withColumn("error", F.concat(F.lit("Metric "), F.col(name_col), F.lit(" not found"))))


# ------------------------------------------------------------------------------ A11
def _perf_aggs():
    d = F.col("memory_after") - F.col("memory_before")
    return [F.count(F.lit(1)).alias("n"),
            F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration"),
            F.min("duration").alias("min_duration"),
            F.avg(d).alias("avg_memory_delta"), F.max(d).alias("max_memory_delta"),
            F.avg("cpu_percent").alias("avg_cpu"), F.max("cpu_percent").alias("max_cpu")]


def performance_summary(ops: DataFrame, component_col: str = "component") -> DataFrame:
    """Overall and per-component summary of all records: n, avg/max/min duration, avg/max memory
    delta (after - before), avg/max cpu; ``level`` is 'overall' or 'component'. Both levels come
    from one pass (grouping sets)."""
    g = ops.groupingSets([[component_col], []], component_col).agg(*_perf_aggs(), F.grouping_id().alias("__gid"))
    return (g.withColumn("level", F.when(F.col("__gid") == 0, F.lit("component")).otherwise(F.lit("overall")))
             .drop("__gid"))


# ------------------------------------------------------------------------------ A12
def _counts_by(cells: Column, field: str) -> Column:
    """Map field value -> summed count over the (error_type, severity, n) cells of one key."""
    values = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c[field])))
    return F.map_from_entries(F.transform(values, lambda v: F.struct(
        v.alias("key"),
        F.aggregate(F.filter(cells, lambda c: c[field] == v), F.lit(0).cast("long"),
                    lambda acc, c: acc + c["n"]).alias("value"))))


def error_stats(errors: DataFrame) -> DataFrame:
    """Per ``component_operation``: total, counts by error type, counts by severity, last time.

    One scan: a partial aggregation to (key, type, severity) cells, then one row per key whose
    cell list is bounded by (#types x #severities); the two count maps are folded from it."""
    e = errors.withColumn("component_operation", F.concat_ws("_", "component", "operation"))
    cells = e.groupBy("component_operation", "error_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    g = cells.groupBy("component_operation").agg(
        F.sum("n").alias("total"), F.max("last").alias("last_error"),
        F.collect_list(F.struct("error_type", "severity", "n")).alias("__cells"))
    return (g.withColumn("by_error_type", _counts_by(F.col("__cells"), "error_type"))
             .withColumn("by_severity", _counts_by(F.col("__cells"), "severity"))
             .drop("__cells"))


# ------------------------------------------------------------------------------ A13
def cache_stats(entries: DataFrame, group_col: str = "model_type") -> DataFrame:
    """Per cache group: entries (each loaded once = a miss), hits (later accesses),
    requests, hit rate as a fraction and as a percent, bytes per tier (device) and the
    sorted model names (as rows: :func:`cache_model_names`)."""
    g = entries.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("misses"),
        F.sum("access_count").alias("hits"),
        F.sum(F.when(F.col("device") == "cpu", F.col("size_bytes")).otherwise(0)).alias("cpu_bytes"),
        F.sum(F.when(F.col("device") != "cpu", F.col("size_bytes")).otherwise(0)).alias("gpu_bytes"),
        F.sort_array(F.collect_set("model_name")).alias("model_names"))
    req = F.col("hits") + F.col("misses")
    return (g.withColumn("requests", req)
             .withColumn("hit_rate", F.when(req > 0, F.col("hits") / req).otherwise(F.lit(0.0)))
             .withColumn("hit_rate_percent", F.col("hit_rate") * 100))


def cache_model_names(entries: DataFrame, group_col: str = "model_type") -> DataFrame:
    """The model names of each cache group, a row each."""
    return entries.select(group_col, "model_name").filter("model_name is not null").distinct()


# ------------------------------------------------------------------------------ A14
SEVERITY_RANK = {CRITICAL: 3, WARNING: 2, HEALTHY: 1, UNKNOWN: 0}


def _rank(c: Column) -> Column:
    expr = F.lit(0)
    for s, r in SEVERITY_RANK.items():
        expr = F.when(c == s, F.lit(r)).otherwise(expr)
    return expr


def health_rollup(results: DataFrame, group_cols: list[str] | None = None, status_col: str = "status") -> DataFrame:
    """Counts per status and the overall status (critical > warning > healthy > unknown;
    no results -> unknown), per group or over everything."""
    s = F.col(status_col)
    aggs = [F.count(F.lit(1)).alias("total_checks")] + [
        F.count_if(s == st).alias(f"{st}_checks") for st in (HEALTHY, WARNING, CRITICAL, UNKNOWN)] + [
        F.max(_rank(s)).alias("__worst")]
    g = results.groupBy(*(group_cols or [])).agg(*aggs)
    overall = (F.when(F.col("__worst") == 3, F.lit(CRITICAL)).when(F.col("__worst") == 2, F.lit(WARNING))
                .when(F.col("__worst") == 1, F.lit(HEALTHY)).otherwise(F.lit(UNKNOWN)))
    return g.withColumn("overall_status", overall).drop("__worst")


def checks_long(df: DataFrame, status_cols: list[str], keep: list[str]) -> DataFrame:
    """Wide status columns -> (keep…, check, status) rows (a bounded explode per row)."""
    entries = F.array(*[F.struct(F.lit(c.replace("_status", "")).alias("check"), F.col(c).alias("status"))
                        for c in status_cols])
    return df.select(*keep, F.inline(entries))


# ------------------------------------------------------------------------------ A15
# fixed values: the tables a healthy deployment must have
REQUIRED_TABLES = ["images", "embeddings", "generations", "model_cache", "system_metrics", "user_sessions"]


def table_health(required: DataFrame, stats: DataFrame) -> DataFrame:
    """Per required table: exists, rows, rows in the last 24 h, recommendation; plus
    ``failed`` checks and the overall status (0 failed -> healthy, <= 2 -> warning, else critical).

    ``stats`` holds (table, rows, recent_rows) of the tables that exist (A2 + P4)."""
    t = required.join(stats, "table", "left")
    issue = (F.when(F.col("rows").isNull(), F.lit("missing table"))
              .when((F.col("table") == "images") & (F.col("rows") == 0), F.lit("no images: run the ingest"))
              .when(F.col("recent_rows") == 0, F.lit("no activity in the last 24 hours")))
    t = t.withColumn("exists", F.col("rows").isNotNull()).withColumn("issue", issue)
    failed = F.count_if(F.col("issue").isNotNull()).over(Window.partitionBy())
    status = (F.when(failed == 0, F.lit(HEALTHY)).when(failed <= 2, F.lit(WARNING)).otherwise(F.lit(CRITICAL)))
    return t.withColumn("failed_checks", failed).withColumn("overall_status", status)


# ------------------------------------------------------------------------------ A16
def log_performance_stats(logs: DataFrame) -> DataFrame:
    """JSON-log rows flagged ``performance_metric`` grouped by operation and component."""
    perf = logs.filter(F.coalesce(F.col("performance_metric"), F.lit(False)))
    return perf.groupBy("operation", "component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"), F.avg("memory_mb").alias("avg_memory_mb"))

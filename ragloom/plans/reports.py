"""Reports as long DataFrames (section, key, value) that a sink writes as JSON
lines or text. Every value is computed by a DataFrame job; only the final small report
rows are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as G


def _text(df: DataFrame, c: str):
    """A report value as text; doubles are rounded to 6 places for display."""
    col = F.col(c)
    if dict(df.dtypes)[c] in ("double", "float"):
        col = F.round(col, 6)
    return col.cast("string")


def _long(df: DataFrame, section: str, key_cols: list[str], value_cols: list[str]) -> DataFrame:
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in key_cols]) if key_cols else F.lit("")
    entries = F.array(*[F.struct(F.lit(v).alias("metric"), _text(df, v).alias("value")) for v in value_cols])
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(entries))


def analytics_report(images, embeddings, generations, cache, as_of=None, days: int = 30) -> DataFrame:
    """Basic stats, success rate, daily trends and their summary, model usage (top 5)."""
    basic = G.table_counts({"images": images, "embeddings": embeddings, "generations": generations,
                            "model_cache": cache})
    rate = G.success_rate(generations)
    trends = G.generation_trends(generations, days, as_of)
    summary = G.trends_summary(trends)
    usage = G.embedding_model_usage(embeddings, as_of).orderBy(F.col("usage_count").desc(), "model_type", "model_name").limit(5)
    parts = [
        _long(basic, "basic_stats", ["table"], ["rows"]),
        _long(rate, "success_rate", [], ["total", "completed", "success_rate"]),
        _long(trends, "generation_trends", ["date"], ["count", "avg_time", "successful", "success_rate"]),
        _long(summary, "trends_summary", [], ["total_generations", "average_daily", "peak_day",
                                              "average_generation_time"]),
        _long(usage, "top_models", ["model_type", "model_name"], ["usage_count", "hours_ago"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def monitor_report(operations: DataFrame, health_long: DataFrame, cache: DataFrame) -> DataFrame:
    """Performance summary, health roll-up and cache statistics in one report."""
    perf = G.performance_summary(operations)
    health = G.health_rollup(health_long)
    cstats = G.cache_stats(cache)
    parts = [
        _long(perf, "performance", ["level", "component"], ["n", "avg_duration", "max_duration", "min_duration",
                                                             "avg_memory_delta", "max_memory_delta", "avg_cpu",
                                                             "max_cpu"]),
        _long(health, "health", [], ["total_checks", "healthy_checks", "warning_checks", "critical_checks",
                                     "unknown_checks", "overall_status"]),
        _long(cstats, "cache", ["model_type"], ["requests", "hits", "misses", "hit_rate", "hit_rate_percent"]),
    ]
    return reduce(DataFrame.unionByName, parts)

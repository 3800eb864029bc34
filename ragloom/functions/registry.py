"""User hooks: metric registry (U3) and health-check registry.

The metric registry is a small dimension DataFrame (name, type, description, unit, labels);
registering again overwrites (last registration wins)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("reg_seq", T.LongType(), False),
])

METRIC_TYPES = ("counter", "gauge", "histogram", "timer")

# fixed values: the default metric definitions (name, type, description, unit), in registration order
DEFAULT_METRICS = [
    ("api_requests_total", "counter", "Total number of API requests", "requests"),
    ("api_request_duration_seconds", "histogram", "API request duration", "seconds"),
    ("api_requests_active", "gauge", "Number of active API requests", "requests"),
    ("embedding_generation_total", "counter", "Total number of embedding generations", "embeddings"),
    ("embedding_generation_duration_seconds", "histogram", "Embedding generation duration", "seconds"),
    ("image_generation_total", "counter", "Total number of image generations", "images"),
    ("image_generation_duration_seconds", "histogram", "Image generation duration", "seconds"),
    ("cache_hits_total", "counter", "Total number of cache hits", "hits"),
    ("cache_misses_total", "counter", "Total number of cache misses", "misses"),
    ("database_connections_active", "gauge", "Number of active database connections", "connections"),
    ("database_query_duration_seconds", "histogram", "Database query duration", "seconds"),
    ("memory_usage_bytes", "gauge", "Memory usage in bytes", "bytes"),
    ("cpu_usage_percent", "gauge", "CPU usage percentage", "percent"),
]


def default_registry(spark: SparkSession) -> DataFrame:
    rows = [(n, t, d, u, {}, i) for i, (n, t, d, u) in enumerate(DEFAULT_METRICS)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def register_metric(registry: DataFrame, name: str, metric_type: str, description: str,
                    unit: str = "", labels: dict | None = None) -> DataFrame:
    """Add or overwrite one definition (keeps its registration position when overwriting)."""
    if metric_type not in METRIC_TYPES:
        raise ValueError(f"unknown metric type {metric_type}")
    spark = registry.sparkSession
    nxt = registry.select(F.coalesce(F.max("reg_seq") + 1, F.lit(0))).scalar()
    row = spark.createDataFrame([(name, metric_type, description, unit, labels or {}, 0)], REGISTRY_SCHEMA)
    return register_metrics(registry, row.withColumn("reg_seq", nxt))


def register_metrics(registry: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions merged into the registry by name, as one aggregation: of equal names the one
    with the highest ``reg_seq`` wins and keeps the lowest. Replaying a merge changes nothing."""
    value = F.struct("type", "description", "unit", "labels")
    merged = registry.unionByName(definitions).groupBy("name").agg(
        F.max_by(value, "reg_seq").alias("d"), F.min("reg_seq").alias("reg_seq"))
    return merged.select("name", "d.*", "reg_seq")


def effective_registry(registry: DataFrame, samples: DataFrame, name_col: str = "name",
                       ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """Registry plus the sampled names it lacks, auto-registered as gauges at their first
    sample (J8 + union). The ranking window runs over one row per name only."""
    base = registry.select(F.coalesce(F.max("reg_seq") + 1, F.lit(0))).scalar()
    first = (samples.groupBy(F.col(name_col).alias("name"))
             .agg(F.min(F.struct(F.col(ts_col), F.col(seq_col))).alias("__first")))
    missing = first.join(registry.select("name"), "name", "left_anti")
    auto = missing.select(
        "name", F.lit("gauge").alias("type"),
        F.concat(F.lit("Auto-registered metric: "), F.col("name")).alias("description"),
        F.lit("").alias("unit"), F.create_map().cast("map<string,string>").alias("labels"),
        (base + F.row_number().over(Window.orderBy("__first", "name")) - 1).cast("long").alias("reg_seq"))
    return registry.unionByName(auto)


# ------------------------------------------------------------------ health checks
class CheckRegistry:
    """Named user checks, each a Column expression yielding a status string.
    A check that fails to evaluate reports 'unknown': null for a row, or an error, which makes
    it unknown for every row and leaves the others as they are."""

    def __init__(self):
        self._checks: dict[str, Column] = {}

    def register_check(self, name: str, rule: Column) -> None:
        self._checks[name] = rule

    def unregister(self, name: str) -> None:
        self._checks.pop(name, None)

    @property
    def checks(self) -> dict[str, Column]:
        return dict(self._checks)

    def evaluate(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Long form: (``keep`` columns, check, status) per input row. All checks run in one pass,
        written under the checkpoint folder; only if that fails does each run in its own."""
        keep = keep or []
        if not self._checks:
            return df.select(*keep, F.lit(None).cast("string").alias("check"),
                             F.lit(None).cast("string").alias("status")).limit(0)
        try:
            return self._written(df, keep, self._checks)
        except PySparkException:
            parts = []
            for name, rule in self._checks.items():
                try:
                    parts.append(self._written(df, keep, {name: rule}))
                except PySparkException:
                    parts.append(df.select(*keep, F.lit(name).alias("check"), F.lit("unknown").alias("status")))
            return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _written(df: DataFrame, keep: list[str], checks: dict[str, Column]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(r.cast("string"), F.lit("unknown")).alias("status"))
                            for n, r in checks.items()])
        out = df.select(*keep, F.inline(entries))
        path = scratch_path(df.sparkSession, "checks")
        out.write.parquet(path)
        return df.sparkSession.read.schema(out.schema).parquet(path)

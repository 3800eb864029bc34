"""Projections, filters and predicates (P1-P11). Every filter is a plain Catalyst predicate,
so equality and range conditions on stored columns reach the parquet scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

# fixed values: log level ordinals (Python logging)
LOG_LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def as_of_col(as_of=None) -> Column:
    """``as_of`` as a Column: None -> current timestamp; a datetime/str -> literal; a Column as is."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    if isinstance(as_of, dt.datetime):
        return F.lit(as_of).cast("timestamp")
    if isinstance(as_of, DataFrame):
        return as_of.select(F.col(as_of.columns[0])).scalar()
    raise TypeError(f"unsupported as_of {as_of!r}")


def interval(amount: int, unit: str) -> Column:
    return F.expr(f"INTERVAL {int(amount)} {unit.upper()}")


def cutoff(as_of, amount: int, unit: str) -> Column:
    """as_of - interval. ``as_of`` may also be a one-row DataFrame holding the anchor (e.g.
    ``df.agg(F.max("ts"))``): the cutoff then becomes one scalar subquery, which Spark can
    push into the parquet scan as a runtime filter."""
    if isinstance(as_of, DataFrame):
        return as_of.select(F.col(as_of.columns[0]) - interval(amount, unit)).scalar()
    return as_of_col(as_of) - interval(amount, unit)


# ------------------------------------------------------------------------ P1
def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """A row whose ``key`` equals ``value``; the key is unique in the tables it is for."""
    return df.filter(F.col(key) == value).limit(1)


# ------------------------------------------------------------------------ P2
def has_all_tags(tags_col, tags: list[str]) -> Column:
    """Row contains every tag (AND); an empty list selects everything."""
    if not tags:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [F.array_contains(F.col(tags_col), t) for t in tags])


def filter_by_tags(df: DataFrame, tags: list[str], limit: int | None = None,
                   tags_col: str = "tags", order_col: str = "id") -> DataFrame:
    """Rows containing every tag; optional limit in id order."""
    out = df.filter(has_all_tags(tags_col, tags))
    if limit is not None:
        out = out.orderBy(order_col).limit(limit)
    return out


# ------------------------------------------------------------------------ P3/P4
def bound(value, kind) -> Column:
    """A bound as a literal of the column's own type: a one-row DataFrame is read once, a datetime or
    text is cast. A literal of another type would cast the column and keep the scan from
    pruning row groups."""
    if isinstance(value, DataFrame):
        value = value.first()[0]
    return value if isinstance(value, Column) else F.lit(value).cast(kind)


def filter_by_date_range(df: DataFrame, start, end, ts_col: str = "created_at") -> DataFrame:
    """Start <= ts <= end (inclusive both ends). Bounds are resolved into literals, so both
    comparisons reach the scan and prune row groups."""
    kind = df.schema[ts_col].dataType
    return df.filter((F.col(ts_col) >= bound(start, kind)) & (F.col(ts_col) <= bound(end, kind)))


def filter_recent(df: DataFrame, amount: int, unit: str = "hours", as_of=None,
                  ts_col: str = "created_at") -> DataFrame:
    """Ts > as_of - interval (strict)."""
    return df.filter(F.col(ts_col) > cutoff(as_of, amount, unit))


# ------------------------------------------------------------------------ P5
def filter_status(df: DataFrame, status: str | None = None, status_col: str = "status") -> DataFrame:
    """P5: optional equality filter."""
    return df if status is None else df.filter(F.col(status_col) == status)


# ------------------------------------------------------------------------ P7
MEMORY_ALERT_MB = 1024.0
CPU_ALERT_PERCENT = 80.0


def threshold_alerts(df: DataFrame, memory_col: str = "memory_mb", cpu_col: str = "cpu_percent",
                     memory_mb: float = MEMORY_ALERT_MB, cpu_percent: float = CPU_ALERT_PERCENT) -> DataFrame:
    """One output row per fired alert (memory > 1024 MB, cpu > 80 %, both strict).
    Stateless, so the same function runs on a batch or a stream."""
    alerts = F.array_compact(F.array(
        F.when(F.col(memory_col) > memory_mb, F.lit("high_memory")),
        F.when(F.col(cpu_col) > cpu_percent, F.lit("high_cpu")),
    ))
    return df.withColumn("alert", F.explode(alerts))


# ------------------------------------------------------------------------ P8
def _between(c: Column, lo, hi) -> Column:
    return (c >= lo) & (c <= hi)


def _sanitized_not_empty(c: str) -> Column:
    return F.length(normalize_text(c)) > 0


# Length limits apply to the text as sent; the text must also survive sanitising (F1).
SEARCH_RULES = {
    "query_length": lambda: _between(F.length("query"), 1, 500),
    "query_empty_after_sanitize": lambda: _sanitized_not_empty("query"),
    "k_range": lambda: _between(F.col("k"), 1, 50),
    "threshold_range": lambda: _between(F.col("threshold"), 0.0, 1.0),
}

GENERATION_RULES = {
    "prompt_length": lambda: _between(F.length("prompt"), 1, 1000),
    "prompt_empty_after_sanitize": lambda: _sanitized_not_empty("prompt"),
    "num_images_range": lambda: _between(F.col("num_images"), 1, 10),
    "seed_non_negative": lambda: F.col("seed") >= 0,
    "width_range": lambda: _between(F.col("width"), 256, 1024) & (F.col("width") % 8 == 0),
    "height_range": lambda: _between(F.col("height"), 256, 1024) & (F.col("height") % 8 == 0),
    "format_allowed": lambda: F.col("format").isin("png", "jpeg", "webp"),
}

RAG_RULES = {
    "prompt_length": lambda: _between(F.length("prompt"), 1, 1000),
    "prompt_empty_after_sanitize": lambda: _sanitized_not_empty("prompt"),
    "examples_range": lambda: _between(F.col("similar_examples_count"), 1, 10),
}

PAGE_RULES = {
    "limit_range": lambda: _between(F.col("limit"), 1, 100),
    "offset_non_negative": lambda: F.col("offset") >= 0,
}

UPLOAD_RULES = {
    "content_type_image": lambda: F.col("content_type").startswith("image/"),
    "size_limit": lambda: F.col("size_bytes") <= 10 * 1024 * 1024,
}

SCORE_RULES = {"score_range": lambda: _between(F.col("similarity_score"), 0.0, 1.0)}


def validate_requests(df: DataFrame, rules: dict) -> DataFrame:
    """Adds ``violations`` (names of failed rules, in rule order) and ``accepted``.
    A null field (optional and absent) does not violate its rule."""
    checks = [F.when(~F.coalesce(rule(), F.lit(True)), F.lit(name)) for name, rule in rules.items()]
    return (df.withColumn("violations", F.array_compact(F.array(*checks)))
              .withColumn("accepted", F.size("violations") == 0))


def split_accepted(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    v = validate_requests(df, rules)
    return v.filter("accepted"), v.filter(~F.col("accepted"))


# ------------------------------------------------------------------------ P9
def _step(seg: Column) -> Column:
    return F.when(seg == "..", F.lit(-1)).when((seg == ".") | (seg == ""), F.lit(0)).otherwise(F.lit(1))


def join_stays_under_base(c, base: str | None = None) -> Column:
    """P9 (join form): NUL characters are dropped, then base/part is normalised; the part is safe
    when no prefix of it climbs above the base and, if absolute, it lies under ``base``.
    (Symlink resolution needs the file system and is not modelled.)"""
    c = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "\u0000", "")
    segs = F.split(c, "/")
    walk = F.aggregate(segs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("lo")),
                       lambda acc, s: F.struct((acc["d"] + _step(s)).alias("d"),
                                               F.least(acc["lo"], acc["d"] + _step(s)).alias("lo")))
    relative_ok = ~c.startswith("/") & (walk["lo"] >= 0)
    if base is None:
        return c.isNotNull() & relative_ok
    b = base.rstrip("/") + "/"
    return c.isNotNull() & (relative_ok | (c.startswith(b) & (walk["lo"] >= 0)))


def index_path_ok(c) -> Column:
    """P9 (index save/load form): no '..' anywhere and no NUL."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~c.contains("..") & ~c.contains("\u0000")


def path_is_safe(c, base: str | None = None) -> Column:
    """Both forms hold."""
    return index_path_ok(c) & join_stays_under_base(c, base)


def path_safety_filter(df: DataFrame, path_col: str = "path", base: str | None = None) -> DataFrame:
    return df.filter(path_is_safe(path_col, base))


# ------------------------------------------------------------------------ P10
HEALTHY, WARNING, CRITICAL, UNKNOWN = "healthy", "warning", "critical", "unknown"

# fixed values: (critical above, warning above) per resource check, all strict
RESOURCE_THRESHOLDS = {
    "memory": (85.0, 70.0),
    "cpu": (90.0, 80.0),
    "disk": (90.0, 80.0),
    "gpu": (95.0, 80.0),
}
CACHE_HIT_RATE_WARNING = 50.0


def classify_level(value: Column, critical: float, warning: float) -> Column:
    """critical if > critical, warning if > warning, else healthy; null reading -> unknown."""
    return (F.when(value.isNull() | F.isnan(value), F.lit(UNKNOWN))
             .when(value > critical, F.lit(CRITICAL))
             .when(value > warning, F.lit(WARNING))
             .otherwise(F.lit(HEALTHY)))


def classify_cache(hit_rate: Column, requests: Column) -> Column:
    """Zero requests -> healthy; missing rate -> unknown; rate < 50 -> warning."""
    return (F.when(requests == 0, F.lit(HEALTHY))
             .when(hit_rate.isNull() | F.isnan(hit_rate), F.lit(UNKNOWN))
             .when(hit_rate < CACHE_HIT_RATE_WARNING, F.lit(WARNING))
             .otherwise(F.lit(HEALTHY)))


def classify_system(memory: Column, cpu: Column, disk: Column) -> Column:
    """System check: any over its critical level -> critical, any over its warning -> warning."""
    vals = [(memory, RESOURCE_THRESHOLDS["memory"]), (cpu, RESOURCE_THRESHOLDS["cpu"]),
            (disk, RESOURCE_THRESHOLDS["disk"])]
    any_null = reduce(lambda a, b: a | b, [v.isNull() for v, _ in vals])
    crit = reduce(lambda a, b: a | b, [v > t[0] for v, t in vals])
    warn = reduce(lambda a, b: a | b, [v > t[1] for v, t in vals])
    return (F.when(any_null, F.lit(UNKNOWN)).when(crit, F.lit(CRITICAL))
             .when(warn, F.lit(WARNING)).otherwise(F.lit(HEALTHY)))


def classify_thresholds(df: DataFrame, memory_col="memory_percent", cpu_col="cpu_percent",
                        disk_col="disk_usage_percent", gpu_col="gpu_utilization",
                        cache_rate_col="cache_hit_rate", cache_requests_col="cache_requests",
                        extra_checks: dict | None = None) -> DataFrame:
    """P10: one status column per check; ``extra_checks`` (U2) maps name -> Column rule
    returning a status string; a rule that yields null counts as unknown."""
    out = (df.withColumn("system_status", classify_system(F.col(memory_col), F.col(cpu_col), F.col(disk_col)))
             .withColumn("memory_status", classify_level(F.col(memory_col), *RESOURCE_THRESHOLDS["memory"]))
             .withColumn("cpu_status", classify_level(F.col(cpu_col), *RESOURCE_THRESHOLDS["cpu"]))
             .withColumn("disk_status", classify_level(F.col(disk_col), *RESOURCE_THRESHOLDS["disk"]))
             .withColumn("gpu_status", classify_level(F.col(gpu_col), *RESOURCE_THRESHOLDS["gpu"]))
             .withColumn("cache_status", classify_cache(F.col(cache_rate_col), F.col(cache_requests_col))))
    for name, rule in (extra_checks or {}).items():
        out = out.withColumn(f"{name}_status", F.coalesce(rule, F.lit(UNKNOWN)))
    return out


MAX_RULES = 1000


def threshold_rules(spark) -> DataFrame:
    """The resource thresholds as a small dimension table (check, column, critical, warning)."""
    cols = {"memory": "memory_percent", "cpu": "cpu_percent", "disk": "disk_usage_percent", "gpu": "gpu_utilization"}
    rows = [(name, cols[name], crit, warn) for name, (crit, warn) in RESOURCE_THRESHOLDS.items()]
    return spark.createDataFrame(rows, "check string, column string, critical double, warning double")


def classify_with_rules(df: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """P10 with the thresholds as data: one (id, check, status) row per reading and rule.

    Readings are unpivoted into (column, value) pairs and joined to the rule table, which is
    broadcast: at most ``MAX_RULES`` rules are read to name the columns, more are an error. The
    classification is the same strict critical > warning > healthy order, null readings are unknown."""
    named = rules.limit(MAX_RULES + 1).collect()
    if len(named) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    value_cols = sorted({r["column"] for r in named})
    rules = df.sparkSession.createDataFrame(named, rules.schema)
    long = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in value_cols])).alias("r"))
    j = long.select(id_col, "r.column", "r.value").join(F.broadcast(rules), "column")
    status = (F.when(F.col("value").isNull() | F.isnan("value"), F.lit(UNKNOWN))
               .when(F.col("value") > F.col("critical"), F.lit(CRITICAL))
               .when(F.col("value") > F.col("warning"), F.lit(WARNING))
               .otherwise(F.lit(HEALTHY)))
    return j.select(id_col, "check", status.alias("status"))


# ------------------------------------------------------------------------ P11
def level_ordinal(c) -> Column:
    c = F.upper(F.col(c) if isinstance(c, str) else c)
    expr = F.lit(None).cast("int")
    for name, n in sorted(LOG_LEVELS.items(), key=lambda kv: kv[1]):
        expr = F.when(c == name, F.lit(n)).otherwise(expr)
    return expr


def log_level_filter(df: DataFrame, min_level: str = "ERROR", level_col: str = "level") -> DataFrame:
    """Rows whose level is at or above ``min_level``."""
    return df.filter(level_ordinal(level_col) >= LOG_LEVELS[min_level.upper()])

"""Thin views that present the driver's test tables in the shapes the operators expect.

Each view exists twice: as a DataFrame (what the library runs) and as DuckDB SQL
text (what the correctness oracle runs). Both columns lists are kept side by side
so they cannot drift apart.

Event-time columns keep the stored type (timestamp without time zone), so range filters
on them reach the parquet scan as pushed filters.

Mapping (documents -> images, events -> generations / metric samples / requests /
operations / errors / calls, orders -> cache entries and COCO images, lineitem ->
COCO annotations, part -> COCO categories).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table_path

EPOCH_2024_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC in microseconds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _ts_from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


# --------------------------------------------------------------------------- images
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_path"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
        (F.lit(256) + F.pmod("n_chars", F.lit(7)) * 128).cast("int").alias("width"),
        (F.lit(256) + F.pmod("doc_id", F.lit(7)) * 128).cast("int").alias("height"),
        _ts_from_micros(F.lit(EPOCH_2024_US) + F.col("doc_id") * 60_000_000).alias("created_at"),
    )


IMAGES_SQL = f"""SELECT doc_id AS id,
       source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS image_path,
       text AS description,
       [lang, source] AS tags,
       CAST(256 + (n_chars % 7) * 128 AS INTEGER) AS width,
       CAST(256 + (doc_id % 7) * 128 AS INTEGER) AS height,
       make_timestamp({EPOCH_2024_US} + doc_id * 60000000) AS created_at
FROM documents"""


# ------------------------------------------------------------------- embeddings
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("vec_id").alias("image_id"),
        "embedding",
        "label",
        F.when(F.col("label") % 2 == 0, "sentence_transformer").otherwise("clip").alias("model_type"),
        F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_name"),
        F.when(F.col("label") < 7, "text").otherwise("image").alias("embedding_type"),
        _ts_from_micros(F.lit(EPOCH_2024_US) + F.col("vec_id") * 420_000_000).alias("created_at"),
    )


EMBEDDINGS_SQL = f"""SELECT vec_id AS id, vec_id AS image_id, embedding, label,
       CASE WHEN label % 2 = 0 THEN 'sentence_transformer' ELSE 'clip' END AS model_type,
       'model-' || CAST(label AS VARCHAR) AS model_name,
       CASE WHEN label < 7 THEN 'text' ELSE 'image' END AS embedding_type,
       make_timestamp({EPOCH_2024_US} + vec_id * 420000000) AS created_at
FROM embeddings"""


# ------------------------------------------------------------------ generations
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("prompt "), F.col("user_id").cast("string")).alias("prompt"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("generation_time_ms"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("props").alias("model_config"),
        F.col("user_id").alias("seed"),
    )


GENERATIONS_SQL = """SELECT event_id AS id, 'prompt ' || CAST(user_id AS VARCHAR) AS prompt,
       CAST(ts AS TIMESTAMP) AS created_at, value AS generation_time_ms,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       props AS model_config, user_id AS seed
FROM events"""


# -------------------------------------------------------------- metric samples
def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("name"),
        "value",
        F.col("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
    )


METRIC_SAMPLES_SQL = """SELECT event_type AS name, value, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq,
       CAST(user_id AS VARCHAR) AS label_user
FROM events"""


# --------------------------------------------------------------------- requests
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("client_id"),
        F.col("ts").alias("ts"),
    )


REQUESTS_SQL = """SELECT event_id AS request_id, '10.0.0.' || CAST(user_id AS VARCHAR) AS client_id,
       CAST(ts AS TIMESTAMP) AS ts
FROM events"""


# ------------------------------------------------------------ operation records
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("op"), (F.col("user_id") % 5).cast("string")).alias("operation"),
        F.col("event_type").alias("component"),
        F.col("value").alias("duration"),
        (k * 10).alias("memory_before"),
        (k * 10 + F.col("value") / 4).alias("memory_after"),
        (F.col("value") % 100).alias("cpu_percent"),
        F.col("ts").alias("ts"),
    )


OPERATIONS_SQL = """SELECT event_id AS seq, 'op' || CAST(user_id % 5 AS VARCHAR) AS operation,
       event_type AS component, value AS duration,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 AS memory_before,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 + value / 4 AS memory_after,
       fmod(value, 100) AS cpu_percent,
       CAST(ts AS TIMESTAMP) AS ts
FROM events"""


# ---------------------------------------------------------------- error events
# fixed values: error severities of the reference's error handler, lowest first
SEVERITIES = ["low", "medium", "high", "critical"]
ERROR_TYPES = ["ValueError", "TimeoutError", "ConnectionError"]


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("component"),
        F.concat(F.lit("op"), (F.col("user_id") % 3).cast("string")).alias("operation"),
        F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (k % 4 + 1).cast("int")).alias("severity"),
        F.try_element_at(F.array(*[F.lit(s) for s in ERROR_TYPES]), (k % 3 + 1).cast("int")).alias("error_type"),
        F.col("ts").alias("ts"),
    )


ERROR_EVENTS_SQL = """SELECT event_id AS seq, 'svc' || CAST(user_id % 5 AS VARCHAR) AS component,
       'op' || CAST(user_id % 3 AS VARCHAR) AS operation,
       (['low', 'medium', 'high', 'critical'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1] AS severity,
       (['ValueError', 'TimeoutError', 'ConnectionError'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1] AS error_type,
       CAST(ts AS TIMESTAMP) AS ts
FROM events WHERE event_type = 'error'"""


# ---------------------------------------------------------------- service calls
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per service key with a success flag (failure = an error event)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("key"),
        (F.col("event_type") != "error").alias("success"),
        F.col("ts").alias("ts"),
    )


CALLS_SQL = """SELECT event_id AS seq,
       'svc' || CAST(user_id % 7 AS VARCHAR) AS key,
       event_type <> 'error' AS success, CAST(ts AS TIMESTAMP) AS ts
FROM events"""


# ---------------------------------------------------------------- system metrics
def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("component"),
        (F.col("value") % 100).alias("cpu_percent"),
        (k * 20.48).alias("memory_mb"),
        k.alias("memory_percent"),
        ((k * 7) % 100).alias("disk_usage_percent"),
        ((F.col("value") * 3) % 100).alias("gpu_utilization"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise((k * 13) % 100).alias("cache_hit_rate"),
        (F.col("user_id") % 4).alias("cache_requests"),
        F.col("ts").alias("created_at"),
    )


SYSTEM_METRICS_SQL = """SELECT event_id AS id, event_type AS component,
       fmod(value, 100) AS cpu_percent,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) * 20.48 AS memory_mb,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory_percent,
       fmod(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 7, 100) AS disk_usage_percent,
       fmod(value * 3, 100) AS gpu_utilization,
       CASE WHEN event_type = 'view' THEN NULL
            ELSE fmod(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 13, 100) END AS cache_hit_rate,
       user_id % 4 AS cache_requests,
       CAST(ts AS TIMESTAMP) AS created_at
FROM events"""


# ----------------------------------------------------------------- cache entries
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("cache_key"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("model_type"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 10).cast("string")).alias("model_name"),
        F.when(F.col("o_orderstatus") == "F", "cpu").otherwise("cuda").alias("device"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        (F.col("o_custkey") % 50).alias("access_count"),
        F.col("o_orderdate").alias("last_accessed"),
        (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"),
    )


CACHE_ENTRIES_SQL = """SELECT 'key-' || CAST(o_orderkey AS VARCHAR) AS cache_key, o_orderkey AS id,
       o_orderpriority AS model_type, 'model-' || CAST(o_custkey % 10 AS VARCHAR) AS model_name,
       CASE WHEN o_orderstatus = 'F' THEN 'cpu' ELSE 'cuda' END AS device,
       CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_custkey % 50 AS access_count,
       CAST(o_orderdate AS TIMESTAMP) AS last_accessed,
       CAST(o_orderdate AS TIMESTAMP) - INTERVAL 30 DAYS AS created_at,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAYS END AS expires_at
FROM orders"""


# ------------------------------------------------------------------------ COCO
def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".jpg")).alias("file_name"),
        (F.lit(320) + (F.col("o_custkey") % 5) * 64).cast("int").alias("width"),
        (F.lit(240) + (F.col("o_orderkey") % 4) * 80).cast("int").alias("height"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "val").otherwise("train").alias("split"),
    )


COCO_IMAGES_SQL = """SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.jpg' AS file_name,
       CAST(320 + (o_custkey % 5) * 64 AS INTEGER) AS width,
       CAST(240 + (o_orderkey % 4) * 80 AS INTEGER) AS height,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'val' ELSE 'train' END AS split
FROM orders"""


def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))


COCO_ANNOTATIONS_SQL = "SELECT l_orderkey AS image_id, l_partkey AS category_id FROM lineitem"


def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))


COCO_CATEGORIES_SQL = "SELECT p_partkey AS id, p_brand AS name FROM part"


ADAPTER_SQL = {
    "images": IMAGES_SQL,
    "vectors": EMBEDDINGS_SQL,
    "generations": GENERATIONS_SQL,
    "samples": METRIC_SAMPLES_SQL,
    "requests": REQUESTS_SQL,
    "operations": OPERATIONS_SQL,
    "errors": ERROR_EVENTS_SQL,
    "calls": CALLS_SQL,
    "sysmetrics": SYSTEM_METRICS_SQL,
    "cache": CACHE_ENTRIES_SQL,
    "coco_images": COCO_IMAGES_SQL,
    "coco_ann": COCO_ANNOTATIONS_SQL,
    "coco_cat": COCO_CATEGORIES_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the adapter views it uses as CTEs."""
    ctes = ",\n".join(f"{n} AS ({ADAPTER_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"

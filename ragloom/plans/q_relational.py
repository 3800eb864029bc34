"""Catalogue entries: predicates (P), ordering (O), joins (J2-J6, J8) and table changes (D)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_views
from ..functions import registry as R
from ..functions.text import normalize_text
from ..operators import changes as D
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import predicates as P
from ..session import ensure_parallelism
from .catalog import register, ts_text


def max_ts(df, col="created_at"):
    """as_of anchor: the table's latest timestamp as a scalar subquery."""
    return df.select(F.max(col)).scalar()


def latest(df, col="created_at"):
    """as_of anchor as a one-row DataFrame, so cutoffs become pushable scalar subqueries."""
    return df.agg(F.max(col))


GEN_ASOF = "(SELECT max(created_at) FROM generations)"

# F1 in DuckDB (RE2): NUL dropped, outer whitespace trimmed, control characters -> space,
# whitespace collapsed, trimmed.
F1_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(0), ''), "
          "'^\\s+|\\s+$', '', 'g'), '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g')")


# ------------------------------------------------------------------------- predicates
@register("p1_lookup", with_views("""
SELECT id, image_path, width FROM images
WHERE image_path = (SELECT image_path FROM images WHERE id = (SELECT max(id) FROM images))""", "images"))
def p1_lookup(spark, sf):
    imgs = A.images(spark, sf)
    path = imgs.filter(F.col("id") == imgs.select(F.max("id")).scalar()).select("image_path").scalar()
    return P.lookup(imgs, "image_path", path).select("id", "image_path", "width")


@register("p2_filter_by_tags", with_views("""
SELECT id, image_path FROM images WHERE list_contains(tags, 'en') AND list_contains(tags, 'src7')""", "images"))
def p2_filter_by_tags(spark, sf):
    return P.filter_by_tags(A.images(spark, sf), ["en", "src7"]).select("id", "image_path")


@register("p3_filter_by_date_range", with_views(f"""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, status FROM generations
WHERE created_at BETWEEN {GEN_ASOF} - INTERVAL 7 DAYS AND {GEN_ASOF} - INTERVAL 3 DAYS""", "generations"))
def p3_filter_by_date_range(spark, sf):
    g = A.generations(spark, sf)
    end = latest(g).first()[0]
    return P.filter_by_date_range(g, end - dt.timedelta(days=7), end - dt.timedelta(days=3)) \
        .select("id", ts_text("created_at").alias("created_at"), "status")


@register("p4_filter_recent", with_views(f"""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM generations
WHERE created_at > {GEN_ASOF} - INTERVAL 24 HOURS""", "generations"))
def p4_filter_recent(spark, sf):
    g = A.generations(spark, sf)
    return P.filter_recent(g, 24, "hours", as_of=latest(g)).select("id", ts_text("created_at").alias("created_at"))


@register("p5_filter_status", with_views("""
SELECT id, seed FROM generations WHERE status = 'failed'""", "generations"))
def p5_filter_status(spark, sf):
    return P.filter_status(A.generations(spark, sf), "failed").select("id", "seed")


@register("p7_threshold_alerts", with_views("""
SELECT id, alert FROM (
  SELECT id, 'high_memory' AS alert FROM sysmetrics WHERE memory_mb > 1024
  UNION ALL SELECT id, 'high_cpu' AS alert FROM sysmetrics WHERE cpu_percent > 80) t""", "sysmetrics"))
def p7_threshold_alerts(spark, sf):
    return P.threshold_alerts(A.system_metrics(spark, sf)).select("id", "alert")


def _prompt_requests(spark, sf):
    c = A.read_table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.col("text").alias("prompt"),
        (F.col("turn") + 1).alias("num_images"), (F.col("turn") - 1).alias("seed"),
        (F.lit(256) + (F.col("conv_id") % 10) * 100).alias("width"), F.lit(512).alias("height"),
        F.when(F.col("role") == "user", "png").when(F.col("role") == "assistant", "jpeg").otherwise("gif").alias("format"))


@register("p8_validate_requests", f"""
WITH r AS (SELECT conv_id, turn, text AS prompt, turn + 1 AS num_images, turn - 1 AS seed,
                  256 + (conv_id % 10) * 100 AS width, 512 AS height,
                  CASE WHEN role = 'user' THEN 'png' WHEN role = 'assistant' THEN 'jpeg' ELSE 'gif' END AS format
           FROM conversations),
v AS (SELECT conv_id, turn, list_filter([
        CASE WHEN NOT (length(prompt) BETWEEN 1 AND 1000) THEN 'prompt_length' END,
        CASE WHEN NOT (length({F1_SQL.format(c='prompt')}) > 0) THEN 'prompt_empty_after_sanitize' END,
        CASE WHEN NOT (num_images BETWEEN 1 AND 10) THEN 'num_images_range' END,
        CASE WHEN NOT (seed >= 0) THEN 'seed_non_negative' END,
        CASE WHEN NOT (width BETWEEN 256 AND 1024 AND width % 8 = 0) THEN 'width_range' END,
        CASE WHEN NOT (height BETWEEN 256 AND 1024 AND height % 8 = 0) THEN 'height_range' END,
        CASE WHEN NOT (format IN ('png', 'jpeg', 'webp')) THEN 'format_allowed' END], lambda x: x IS NOT NULL) AS vs
      FROM r)
SELECT conv_id, turn, array_to_string(vs, ',') AS violations, len(vs) = 0 AS accepted FROM v""")
def p8_validate_requests(spark, sf):
    v = P.validate_requests(_prompt_requests(spark, sf), P.GENERATION_RULES)
    return v.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"), "accepted")


def _checks_sql(checks, frm, key):
    cases = ", ".join(f"CASE WHEN NOT ({cond}) THEN '{name}' END" for name, cond in checks.items())
    return (f"SELECT {key}, array_to_string(vs, ',') AS violations, len(vs) = 0 AS accepted FROM ("
            f"SELECT {key}, list_filter([{cases}], lambda x: x IS NOT NULL) AS vs FROM ({frm}) r) v")


def _violations(df, rules, key):
    return P.validate_requests(df, rules).select(key, F.array_join("violations", ",").alias("violations"), "accepted")


@register("p8_validate_search", _checks_sql(
    {"query_length": "length(query) BETWEEN 1 AND 500", "query_empty_after_sanitize": f"length({F1_SQL.format(c='query')}) > 0",
     "k_range": "k BETWEEN 1 AND 50", "threshold_range": "threshold BETWEEN 0.0 AND 1.0"},
    "SELECT doc_id, text AS query, doc_id % 60 AS k, n_chars / 1000.0 AS threshold FROM documents", "doc_id"))
def p8_validate_search(spark, sf):
    d = A.read_table(spark, sf, "documents")
    return _violations(d.select("doc_id", F.col("text").alias("query"), (F.col("doc_id") % 60).alias("k"),
                                (F.col("n_chars") / 1000.0).alias("threshold")), P.SEARCH_RULES, "doc_id")


@register("p8_validate_rag", _checks_sql(
    {"prompt_length": "length(prompt) BETWEEN 1 AND 1000", "prompt_empty_after_sanitize": f"length({F1_SQL.format(c='prompt')}) > 0",
     "examples_range": "similar_examples_count BETWEEN 1 AND 10"},
    "SELECT doc_id, text AS prompt, doc_id % 12 AS similar_examples_count FROM documents", "doc_id"))
def p8_validate_rag(spark, sf):
    d = A.read_table(spark, sf, "documents")
    return _violations(d.select("doc_id", F.col("text").alias("prompt"), (F.col("doc_id") % 12).alias("similar_examples_count")),
                       P.RAG_RULES, "doc_id")


@register("p8_validate_page", _checks_sql(
    {"limit_range": "\"limit\" BETWEEN 1 AND 100", "offset_non_negative": "\"offset\" >= 0"},
    "SELECT event_id, user_id % 150 AS \"limit\", event_id % 7 - 1 AS \"offset\" FROM events", "event_id"))
def p8_validate_page(spark, sf):
    e = A.read_table(spark, sf, "events")
    return _violations(e.select("event_id", (F.col("user_id") % 150).alias("limit"), (F.col("event_id") % 7 - 1).alias("offset")),
                       P.PAGE_RULES, "event_id")


@register("p8_validate_upload", _checks_sql(
    {"content_type_image": "starts_with(content_type, 'image/')", "size_limit": "size_bytes <= 10485760"},
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'text/plain' WHEN page_id % 3 = 1 THEN 'image/png' END AS content_type,
       strlen(html) * 4000 AS size_bytes FROM pages""", "page_id"))
def p8_validate_upload(spark, sf):
    p = A.read_table(spark, sf, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "text/plain").when(F.col("page_id") % 3 == 1, "image/png")
    return _violations(p.select("page_id", kind.alias("content_type"), (F.octet_length("html").cast("long") * 4000).alias("size_bytes")),
                       P.UPLOAD_RULES, "page_id")


@register("p8_validate_score", _checks_sql(
    {"score_range": "similarity_score BETWEEN 0.0 AND 1.0"},
    "SELECT vec_id, embedding[1]::DOUBLE AS similarity_score FROM embeddings", "vec_id"))
def p8_validate_score(spark, sf):
    e = A.read_table(spark, sf, "embeddings")
    return _violations(e.select("vec_id", F.col("embedding")[0].cast("double").alias("similarity_score")), P.SCORE_RULES, "vec_id")


P9_STEPS = "list_transform(string_split(p, '/'), lambda s: CASE WHEN s = '..' THEN -1 WHEN s IN ('.', '') THEN 0 ELSE 1 END)"


@register("p9_path_safety", f"""
WITH t AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1) AS p FROM pages),
s AS (SELECT page_id, p, {P9_STEPS} AS steps FROM t)
SELECT page_id,
       p NOT LIKE '%..%' AND strpos(p, chr(0)) = 0 AS index_ok,
       p NOT LIKE '/%' AND coalesce(list_min(list_transform(range(1, len(steps) + 1),
                                    lambda i: list_sum(list_slice(steps, 1, i)))), 0) >= 0 AS join_ok
FROM s""")
def p9_path_safety(spark, sf):
    """URL paths of the crawled pages checked as relative file paths (both P9 forms)."""
    pages = A.read_table(spark, sf, "pages")
    p = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/?(.*)$", 1).alias("p"))
    return p.select("page_id", P.index_path_ok("p").alias("index_ok"), P.join_stays_under_base("p").alias("join_ok"))


def _level_sql(v, crit, warn):
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN 'unknown' WHEN {v} > {crit} THEN 'critical' "
            f"WHEN {v} > {warn} THEN 'warning' ELSE 'healthy' END")


P10_SQL = with_views(f"""
SELECT id,
  CASE WHEN memory_percent IS NULL OR cpu_percent IS NULL OR disk_usage_percent IS NULL THEN 'unknown'
       WHEN memory_percent > 85 OR cpu_percent > 90 OR disk_usage_percent > 90 THEN 'critical'
       WHEN memory_percent > 70 OR cpu_percent > 80 OR disk_usage_percent > 80 THEN 'warning'
       ELSE 'healthy' END AS system_status,
  {_level_sql('memory_percent', 85, 70)} AS memory_status,
  {_level_sql('cpu_percent', 90, 80)} AS cpu_status,
  {_level_sql('disk_usage_percent', 90, 80)} AS disk_status,
  {_level_sql('gpu_utilization', 95, 80)} AS gpu_status,
  CASE WHEN cache_requests = 0 THEN 'healthy' WHEN cache_hit_rate IS NULL OR isnan(cache_hit_rate) THEN 'unknown'
       WHEN cache_hit_rate < 50 THEN 'warning' ELSE 'healthy' END AS cache_status
FROM sysmetrics""", "sysmetrics")


@register("p10_classify_thresholds", P10_SQL)
def p10_classify_thresholds(spark, sf):
    c = P.classify_thresholds(A.system_metrics(spark, sf))
    return c.select("id", "system_status", "memory_status", "cpu_status", "disk_status", "gpu_status", "cache_status")


@register("p10_classify_with_rules", with_views("""
, rules AS (SELECT * FROM (VALUES ('memory', 85.0, 70.0), ('cpu', 90.0, 80.0), ('disk', 90.0, 80.0),
                                  ('gpu', 95.0, 80.0)) v("check", critical, warning)),
long AS (SELECT id, 'memory' AS "check", memory_percent AS value FROM sysmetrics
         UNION ALL SELECT id, 'cpu', cpu_percent FROM sysmetrics
         UNION ALL SELECT id, 'disk', disk_usage_percent FROM sysmetrics
         UNION ALL SELECT id, 'gpu', gpu_utilization FROM sysmetrics)
SELECT l.id, l."check", CASE WHEN value IS NULL OR isnan(value) THEN 'unknown' WHEN value > critical THEN 'critical'
                             WHEN value > warning THEN 'warning' ELSE 'healthy' END AS status
FROM long l JOIN rules r ON r."check" = l."check"
""", "sysmetrics"))
def p10_classify_with_rules(spark, sf):
    """The resource checks with their thresholds supplied as a (broadcast) rule table."""
    return P.classify_with_rules(A.system_metrics(spark, sf), P.threshold_rules(spark))


LEVEL_OF_EVENT = {"error": "ERROR", "view": "DEBUG", "signup": "WARNING", "purchase": "CRITICAL", "click": "INFO"}


def log_lines(spark, sf):
    """Log rows derived from events: level by event type, message = props."""
    ev = A.read_table(spark, sf, "events")
    lvl = F.lit("INFO")
    for k, v in LEVEL_OF_EVENT.items():
        lvl = F.when(F.col("event_type") == k, F.lit(v)).otherwise(lvl)
    return ev.select(F.col("event_id"), F.col("ts").cast("timestamp").alias("timestamp"), lvl.alias("level"),
                     F.lit("app").alias("logger"), F.col("props").alias("message"))


@register("p11_log_level_filter", """
SELECT event_id, level FROM (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'WARNING'
                   WHEN 'purchase' THEN 'CRITICAL' ELSE 'INFO' END AS level FROM events) t
WHERE level IN ('ERROR', 'CRITICAL')""")
def p11_log_level_filter(spark, sf):
    return P.log_level_filter(log_lines(spark, sf), "ERROR").select("event_id", "level")


# ------------------------------------------------------------------------- ordering
@register("o1_paginate", with_views("""
SELECT id, image_path FROM images ORDER BY id LIMIT 20 OFFSET 40""", "images"))
def o1_paginate(spark, sf):
    return O.paginate(A.images(spark, sf), limit=20, offset=40).select("id", "image_path")


@register("o1_page_info", with_views("""
SELECT count(*) AS total, 20 AS "limit", 40 AS "offset", CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages,
       3 AS page, 60 < count(*) AS has_next, true AS has_prev FROM images""", "images"))
def o1_page_info(spark, sf):
    return O.page_info(A.images(spark, sf), limit=20, offset=40)


@register("o1_keyset_page", with_views("""
SELECT id, image_path FROM images WHERE id > (SELECT max(id) FROM images) / 2 ORDER BY id LIMIT 20""", "images"))
def o1_keyset_page(spark, sf):
    imgs = A.images(spark, sf)
    return O.paginate_after(imgs, imgs.select(F.max("id") / 2).scalar(), 20).select("id", "image_path")


@register("o2_recent", with_views("""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, status FROM generations
ORDER BY created_at DESC, id DESC LIMIT 100""", "generations"))
def o2_recent(spark, sf):
    return O.recent(A.generations(spark, sf), 100).select("id", ts_text("created_at").alias("created_at"), "status")


@register("o4_head_n", with_views("""
SELECT id, file_name FROM coco_images ORDER BY id LIMIT 25""", "coco_images"))
def o4_head_n(spark, sf):
    return O.head_n(A.coco_images(spark, sf), 25).select("id", "file_name")


# ------------------------------------------------------------------------- joins
@register("j2_annotate_categories", with_views("""
SELECT c.name AS category_name, count(*) AS n FROM coco_ann a JOIN coco_cat c ON c.id = a.category_id
GROUP BY c.name""", "coco_ann", "coco_cat"))
def j2_annotate_categories(spark, sf):
    named = J.annotate_categories(A.coco_annotations(spark, sf), A.coco_categories(spark, sf))
    return named.groupBy("category_name").agg(F.count(F.lit(1)).alias("n"))


@register("j3_images_left_annotations", with_views("""
SELECT i.id, count(a.category_id) AS n_annotations FROM coco_images i LEFT JOIN coco_ann a ON a.image_id = i.id
GROUP BY i.id""", "coco_images", "coco_ann"))
def j3_images_left_annotations(spark, sf):
    j = J.images_with_annotations(A.coco_images(spark, sf), A.coco_annotations(spark, sf))
    return j.groupBy("id").agg(F.count("category_id").alias("n_annotations"))


def _listing(spark, sf):
    """The file listing: images whose document carries a quality label of 1 are on disk."""
    imgs = A.images(spark, sf)
    labels = A.read_table(spark, sf, "labels").filter(F.col("quality") == 1)
    return imgs.join(labels.select(F.col("doc_id").alias("id")), "id", "left_semi") \
        .select(F.concat(F.lit("./"), F.col("image_path")).alias("path"))


@register("j4_keep_existing_files", with_views("""
SELECT id, image_path FROM images
WHERE image_path IN (SELECT i.image_path FROM images i JOIN labels l ON l.doc_id = i.id WHERE l.quality = 1)""",
                                               "images"))
def j4_keep_existing_files(spark, sf):
    return J.keep_existing_files(A.images(spark, sf), _listing(spark, sf)).select("id", "image_path")


@register("j5_zip_by_position", """
SELECT e.label, count(*) AS migrated FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
WHERE len(e.embedding) = 64 GROUP BY e.label""")
def j5_zip_by_position(spark, sf):
    vecs = A.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", "label")
    meta = A.read_table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "source")
    return J.zip_by_position(vecs, meta, dim=64).groupBy("label").agg(F.count(F.lit(1)).alias("migrated"))


DEFAULT_REGISTRY_SQL = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{t}', {i})" for i, (n, t, _d, _u) in enumerate(R.DEFAULT_METRICS)) + ") v(name, type, reg_seq))"


@register("j6_registry_latest", with_views(f""", {DEFAULT_REGISTRY_SQL},
firsts AS (SELECT name, min(ts) AS t0, arg_min(seq, ts) AS s0 FROM samples GROUP BY name),
auto AS (SELECT name, 'gauge' AS type, {len(R.DEFAULT_METRICS)} + row_number() OVER (ORDER BY t0, s0, name) - 1 AS reg_seq
         FROM firsts WHERE name NOT IN (SELECT name FROM registry)),
reg AS (SELECT * FROM registry UNION ALL SELECT * FROM auto),
latest AS (SELECT name, arg_max(value, (ts, seq)) AS latest_value, count(*) AS total_values FROM samples GROUP BY name)
SELECT r.name, r.type, CAST(r.reg_seq AS BIGINT) AS reg_seq, l.latest_value, coalesce(l.total_values, 0) AS total_values
FROM reg r LEFT JOIN latest l ON l.name = r.name""", "samples"))
def j6_registry_latest(spark, sf):
    from ..operators.aggregates import latest_metric_values
    samples = A.metric_samples(spark, sf)
    reg = R.effective_registry(R.default_registry(spark), samples)
    out = J.registry_with_latest(reg, latest_metric_values(samples))
    return out.select("name", "type", "reg_seq", "latest_value",
                      F.coalesce("total_values", F.lit(0)).alias("total_values"))


@register("j8_unregistered_names", with_views(f""", {DEFAULT_REGISTRY_SQL}
SELECT DISTINCT name FROM samples WHERE name NOT IN (SELECT name FROM registry)""", "samples"))
def j8_unregistered_names(spark, sf):
    return J.unregistered_names(A.metric_samples(spark, sf), R.default_registry(spark))


@register("j8_missing_tables", """
SELECT name FROM (VALUES ('images'), ('embeddings'), ('generations'), ('model_cache'), ('system_metrics'),
                         ('user_sessions')) r(name)
WHERE name NOT IN (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'system_metrics' WHEN 'view' THEN 'images'
                   WHEN 'click' THEN 'generations' ELSE 'embeddings' END FROM events)""")
def j8_missing_tables(spark, sf):
    """Required tables that no event type feeds (event type -> table it writes)."""
    spark_required = spark.createDataFrame([(t,) for t in _required_tables()], "name string")
    ev = A.read_table(spark, sf, "events")
    present = ev.select(F.when(F.col("event_type") == "error", "system_metrics")
                        .when(F.col("event_type") == "view", "images")
                        .when(F.col("event_type") == "click", "generations")
                        .otherwise("embeddings").alias("name"))
    return J.missing_names(spark_required, present)


def _required_tables():
    from ..operators.aggregates import REQUIRED_TABLES
    return REQUIRED_TABLES


# ------------------------------------------------------------------------- changes
def _conv_paths(spark, sf):
    """Conversation images: a long user turn (over 200 characters) has already stored one."""
    c = A.read_table(spark, sf, "conversations")
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image_path"),
                    "turn", F.when((F.col("role") == "user") & (F.length("text") > 200), "user").otherwise("other")
                    .alias("role"))


@register("d1_insert_unique", """
WITH c AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.jpg' AS image_path, turn,
                  CASE WHEN role = 'user' AND length(text) > 200 THEN 'user' ELSE 'other' END AS role FROM conversations),
firsts AS (SELECT image_path, min(turn) AS turn FROM c WHERE role <> 'user' GROUP BY image_path)
SELECT image_path, turn FROM firsts WHERE image_path NOT IN (SELECT image_path FROM c WHERE role = 'user')""")
def d1_insert_unique(spark, sf):
    c = _conv_paths(spark, sf)
    target = c.filter(F.col("role") == "user").select("image_path")
    new = c.filter(F.col("role") != "user").select("image_path", "turn")
    to_insert, _rejected = D.insert_unique(target, new, "image_path", order_col="turn")
    return to_insert.select("image_path", "turn")


@register("d1_insert_rejected", """
WITH c AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '.jpg' AS image_path, turn,
                  CASE WHEN role = 'user' AND length(text) > 200 THEN 'user' ELSE 'other' END AS role FROM conversations),
new AS (SELECT image_path, turn FROM c WHERE role <> 'user'),
firsts AS (SELECT image_path, min(turn) AS first_turn FROM new GROUP BY image_path)
SELECT reason, count(*) AS n FROM (
  SELECT 'exists' AS reason FROM firsts WHERE image_path IN (SELECT image_path FROM c WHERE role = 'user')
  UNION ALL SELECT 'duplicate' FROM new JOIN firsts USING (image_path) WHERE turn <> first_turn) t
GROUP BY reason""")
def d1_insert_rejected(spark, sf):
    c = _conv_paths(spark, sf)
    target = c.filter(F.col("role") == "user").select("image_path")
    new = c.filter(F.col("role") != "user").select("image_path", "turn")
    _ins, rejected = D.insert_unique(target, new, "image_path", order_col="turn")
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("d2_delete_by_ids", with_views("""
SELECT id FROM images WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", "images"))
def d2_delete_by_ids(spark, sf):
    ids = A.read_table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return D.delete_by_ids(A.images(spark, sf), ids).select("id")


@register("d2_deleted_found", with_views("""
SELECT l.doc_id AS id, l.doc_id IN (SELECT id FROM images) AS found FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l""",
                                         "images"))
def d2_deleted_found(spark, sf):
    ids = A.read_table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return D.deleted_found(A.images(spark, sf), ids)


@register("d3_retain_since", with_views(f"""
SELECT id FROM generations WHERE created_at >= {GEN_ASOF} - INTERVAL 7 DAYS""", "generations"))
def d3_retain_since(spark, sf):
    g = A.generations(spark, sf)
    return D.retain_since(g, 7, "days", as_of=latest(g)).select("id")


@register("d3_cache_retention_removed", with_views("""
SELECT model_type, count(*) AS removed FROM cache
WHERE last_accessed < (SELECT max(last_accessed) FROM cache) - INTERVAL 30 DAYS GROUP BY model_type""", "cache"))
def d3_cache_retention_removed(spark, sf):
    c = A.cache_entries(spark, sf)
    gone = D.removed_before(c, 30, "days", as_of=latest(c, "last_accessed"), ts_col="last_accessed")
    return gone.groupBy("model_type").agg(F.count(F.lit(1)).alias("removed"))


@register("d4_expire_ttl", with_views("""
SELECT device, count(*) AS n FROM cache
WHERE expires_at IS NULL OR NOT ((SELECT max(last_accessed) FROM cache) > expires_at) GROUP BY device""", "cache"))
def d4_expire_ttl(spark, sf):
    c = A.cache_entries(spark, sf)
    return D.expire_ttl(c, as_of=max_ts(c, "last_accessed")).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


@register("d5_clear_by_type", with_views("""
SELECT model_type, count(*) AS n FROM cache WHERE model_type <> '1-URGENT' OR model_type IS NULL GROUP BY model_type""",
                                         "cache"))
def d5_clear_by_type(spark, sf):
    return D.clear_by_type(A.cache_entries(spark, sf), "1-URGENT").groupBy("model_type").agg(F.count(F.lit(1)).alias("n"))


@register("d6_distinct_tags", """
SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tags FROM part""")
def d6_distinct_tags(spark, sf):
    p = A.read_table(spark, sf, "part").select(F.split("p_name", " ").alias("tags"))
    return D.distinct_values(p, "tags")


@register("d6_distinct_per_group", """
SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS tags FROM part""")
def d6_distinct_per_group(spark, sf):
    p = A.read_table(spark, sf, "part").select("p_brand", F.split("p_name", " ").alias("tags"))
    return D.distinct_values(p, "tags", ["p_brand"])


@register("f1_normalize_text", f"""
SELECT doc_id, length({F1_SQL.format(c='text')}) AS n_norm, md5({F1_SQL.format(c='text')}) AS h FROM documents""")
def f1_normalize_text(spark, sf):
    d = ensure_parallelism(A.read_table(spark, sf, "documents"))
    n = normalize_text("text")
    return d.select("doc_id", F.length(n).cast("long").alias("n_norm"), F.md5(n).alias("h"))

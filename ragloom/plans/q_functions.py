"""Catalogue entries: scalar functions (F2-F15), export lines (K4/F14) and encoder rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_views
from ..functions import registry as R
from ..functions import text as T
from ..functions.encoders import HashingEncoder
from ..operators import aggregates as G
from ..operators import vectors as V
from ..sources.sinks import prometheus_lines
from .catalog import register, ts_text
from .q_relational import DEFAULT_REGISTRY_SQL


def f2_sql(x: str) -> str:
    """F2 in DuckDB for the expression ``x``."""
    s = (f"regexp_replace(regexp_replace(regexp_replace(regexp_extract(replace({x}, chr(0), ''), '([^/]*)$', 1), "
         f"'[^a-zA-Z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g')")
    return f"(CASE WHEN {s} = '' OR {s} IS NULL THEN 'unnamed' ELSE substr({s}, 1, 255) END)"


def ext_sql(x: str) -> str:
    """os.path.splitext extension (lower-cased) of the base name of ``x``."""
    return f"lower(regexp_extract(regexp_replace(regexp_extract({x}, '([^/]*)$', 1), '^\\.+', ''), '(\\.[^.]*)$', 1))"


ALLOWED_SQL = "('.jpg', '.jpeg', '.png', '.gif', '.webp', '.bmp')"


@register("f2_sanitize_filename", f"SELECT conv_id, turn, {f2_sql('text')} AS safe_name FROM conversations")
def f2_sanitize_filename(spark, sf):
    c = A.read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.sanitize_filename("text").alias("safe_name"))


@register("f3_split_upload_tags", f"""
SELECT conv_id, turn, array_to_string(list_slice(list_transform(list_filter(list_transform(string_split(text, ','),
         lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''),
         lambda t: substr({f2_sql('t')}, 1, 100)), 1, 50), '|') AS tags
FROM conversations""")
def f3_split_upload_tags(spark, sf):
    c = A.read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(T.split_upload_tags("text"), "|").alias("tags"))


@register("f3_split_tags", """
SELECT p_partkey, array_to_string(string_split(p_type || ',' || p_brand, ','), '|') AS tags, len(string_split(p_type || ',' || p_brand, ',')) AS n
FROM part""")
def f3_split_tags(spark, sf):
    p = A.read_table(spark, sf, "part").select("p_partkey", F.concat_ws(",", "p_type", "p_brand").alias("t"))
    tags = T.split_tags("t")
    return p.select("p_partkey", F.array_join(tags, "|").alias("tags"), F.size(tags).cast("long").alias("n"))


def _upload_inputs(d):
    ct = (F.when(F.col("lang") == "en", "image/PNG; charset=binary").when(F.col("lang") == "de", "image/jpeg")
          .when(F.col("lang") == "fr", "image/tiff"))
    orig = F.when(F.col("lang") == "es", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".WEBP")))) \
        .otherwise(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".tiff"))))
    return ct, orig


@register("f4_storage_name", f"""
SELECT doc_id, 'upload_' || md5(CAST(doc_id AS VARCHAR)) ||
  coalesce(CASE lower(trim(split_part(ct, ';', 1))) WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.png'
             WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' WHEN 'image/bmp' THEN '.bmp' END,
           CASE WHEN {ext_sql(f2_sql('orig'))} IN {ALLOWED_SQL} THEN {ext_sql(f2_sql('orig'))} END, '.bin') AS storage_name
FROM (SELECT doc_id,
        CASE lang WHEN 'en' THEN 'image/PNG; charset=binary' WHEN 'de' THEN 'image/jpeg' WHEN 'fr' THEN 'image/tiff' END AS ct,
        CASE WHEN lang = 'es' THEN source || '/' || CAST(doc_id AS VARCHAR) || '.WEBP'
             ELSE source || '/' || CAST(doc_id AS VARCHAR) || '.tiff' END AS orig
      FROM documents) t""")
def f4_storage_name(spark, sf):
    d = A.read_table(spark, sf, "documents")
    ct, orig = _upload_inputs(d)
    return d.select("doc_id", T.storage_name(ct, orig, key=F.col("doc_id")).alias("storage_name"))


@register("f5_allowed_extension", f"""
SELECT page_id, {ext_sql('url')} AS ext, {ext_sql('url')} IN {ALLOWED_SQL} AS allowed FROM pages""")
def f5_allowed_extension(spark, sf):
    p = A.read_table(spark, sf, "pages")
    ext = T.file_extension("url")
    return p.select("page_id", ext.alias("ext"), T.is_allowed_image_extension(ext).alias("allowed"))


@register("f6_metadata_text_csv", """
SELECT p_partkey, concat_ws(' | ',
    CASE WHEN p_name IS NOT NULL AND p_name <> '' THEN 'Description: ' || p_name END,
    CASE WHEN p_type IS NOT NULL AND p_type <> '' THEN 'Tags: ' || p_type END,
    CASE WHEN p_brand IS NOT NULL AND p_brand <> '' THEN 'Style: ' || p_brand END,
    'Category: ' || CAST(p_size AS VARCHAR)) AS text
FROM part""")
def f6_metadata_text_csv(spark, sf):
    p = A.read_table(spark, sf, "part")
    return p.select("p_partkey", T.metadata_text_csv("p_name", "p_type", "p_brand", "p_size").alias("text"))


@register("f6_metadata_text_db", with_views("""
SELECT id, md5(text) AS h, length(text) AS n FROM (
  SELECT id, CASE WHEN len(parts) = 0 THEN 'No description available' ELSE array_to_string(parts, ' | ') END AS text
  FROM (SELECT id, list_filter(list_concat([CASE WHEN description <> '' THEN description END], tags,
               [CASE WHEN width <> 0 AND height <> 0 THEN 'Size: ' || width || 'x' || height END]),
               lambda x: x IS NOT NULL) AS parts FROM images) a) b""", "images"))
def f6_metadata_text_db(spark, sf):
    i = A.images(spark, sf)
    t = T.metadata_text_db("description", "tags", "width", "height")
    return i.select("id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


@register("f6_metadata_text_coco", with_views("""
, named AS (SELECT a.image_id, c.name FROM coco_ann a JOIN coco_cat c ON c.id = a.category_id),
per AS (SELECT image_id, list_sort(list_distinct(list(name))) AS cats FROM named GROUP BY image_id)
SELECT i.id, concat_ws(' | ', CASE WHEN len(coalesce(p.cats, [])) > 0 THEN 'Objects: ' || array_to_string(p.cats, ', ') END,
                       'Size: ' || i.width || 'x' || i.height) AS text
FROM coco_images i LEFT JOIN per p ON p.image_id = i.id""", "coco_images", "coco_ann", "coco_cat"))
def f6_metadata_text_coco(spark, sf):
    s = G.summarize_annotations(A.coco_images(spark, sf), A.coco_annotations(spark, sf), A.coco_categories(spark, sf))
    return s.select("id", T.metadata_text_coco("categories", "width", "height").alias("text"))


@register("f8_client_id", """
SELECT event_id, coalesce(CASE WHEN ff IS NOT NULL AND ff <> '' THEN trim(split_part(ff, ',', 1)) END, host, 'unknown') AS client_id
FROM (SELECT event_id,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE ' 10.1.' || CAST(user_id AS VARCHAR) || '.1 , 10.0.0.1' END AS ff,
        CASE WHEN user_id % 5 = 0 THEN NULL ELSE '192.168.0.' || CAST(user_id AS VARCHAR) END AS host FROM events) t""")
def f8_client_id(spark, sf):
    ev = A.read_table(spark, sf, "events")
    ff = F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" 10.1."), F.col("user_id").cast("string"), F.lit(".1 , 10.0.0.1")))
    host = F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("192.168.0."), F.col("user_id").cast("string")))
    return ev.select("event_id", T.client_id(ff, host).alias("client_id"))


@register("f9_cache_key", with_views("""
SELECT cache_key, md5(model_type || ':' || model_name) AS hashed FROM cache""", "cache"))
def f9_cache_key(spark, sf):
    c = A.cache_entries(spark, sf)
    return c.select("cache_key", T.cache_key("model_type", "model_name").alias("hashed"))


@register("f9_cache_key_params", """
SELECT event_id, md5(event_type || ':m' || CAST(user_id % 5 AS VARCHAR) || ':{"device":"gpu","user":"' || CAST(user_id AS VARCHAR)
           || '"' || CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '' ELSE ',"z":"' || json_extract_string(props, '$.k') || '"' END
           || '}') AS hashed FROM events""")
def f9_cache_key_params(spark, sf):
    """Parameters, given in another order, take part sorted by key."""
    ev = A.read_table(spark, sf, "events")
    params = F.create_map(F.lit("z"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"),
                          F.lit("device"), F.lit("gpu"))
    params = F.map_filter(params, lambda k, v: v.isNotNull())
    return ev.select("event_id", T.cache_key("event_type", F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")), params).alias("hashed"))


@register("f10_json_text", with_views("SELECT id, model_config ->> 'k' AS k FROM generations", "generations"))
def f10_json_text(spark, sf):
    g = A.generations(spark, sf)
    return g.select("id", T.json_text("model_config", "k").alias("k"))


@register("f11_time_functions", with_views("""
SELECT id, strftime(created_at, '%Y-%m-%d') AS day,
       round((epoch_us((SELECT max(created_at) FROM generations)) - epoch_us(created_at)) / 3.6e9, 6) AS hours_ago,
       strftime(make_timestamp(CAST(floor(generation_time_ms * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS from_epoch,
       generation_time_ms / 1000.0 AS seconds
FROM generations""", "generations"))
def f11_time_functions(spark, sf):
    g = A.generations(spark, sf)
    as_of = g.select(F.max("created_at")).scalar()
    return g.select("id", F.date_format(F.to_date("created_at"), "yyyy-MM-dd").alias("day"),
                    F.round(T.hours_between(as_of, F.col("created_at")), 6).alias("hours_ago"),
                    ts_text(T.epoch_seconds_to_ts(F.col("generation_time_ms"))).alias("from_epoch"),
                    T.ms_to_seconds(F.col("generation_time_ms")).alias("seconds"))


@register("f12_coco_description", with_views("""
, named AS (SELECT a.image_id, c.name FROM coco_ann a JOIN coco_cat c ON c.id = a.category_id),
per AS (SELECT image_id, list_sort(list_distinct(list(name))) AS cats FROM named GROUP BY image_id)
SELECT i.id, array_to_string(coalesce(p.cats, []), ' ') AS description
FROM coco_images i LEFT JOIN per p ON p.image_id = i.id""", "coco_images", "coco_ann", "coco_cat"))
def f12_coco_description(spark, sf):
    s = G.summarize_annotations(A.coco_images(spark, sf), A.coco_annotations(spark, sf), A.coco_categories(spark, sf))
    return s.select("id", T.coco_description("categories").alias("description"))


@register("f13_output_name", with_views("""
SELECT id, printf('%s_%s_%02d.%s', 'gen', CAST(seed AS VARCHAR), CAST(id % 4 + 1 AS INTEGER), 'png') AS output_path
FROM generations""", "generations"))
def f13_output_name(spark, sf):
    g = A.generations(spark, sf)
    return g.select("id", T.output_name(F.lit("gen"), F.col("seed").cast("string"), F.col("id") % 4, F.lit(".PNG"))
                    .alias("output_path"))


@register("k4_export_prometheus", with_views(f""", {DEFAULT_REGISTRY_SQL},
firsts AS (SELECT name, min(ts) AS t0, arg_min(seq, ts) AS s0 FROM samples GROUP BY name),
auto AS (SELECT name, 'gauge' AS type, 'Auto-registered metric: ' || name AS description,
                {len(R.DEFAULT_METRICS)} + row_number() OVER (ORDER BY t0, s0, name) - 1 AS reg_seq
         FROM firsts WHERE name NOT IN (SELECT name FROM registry)),
latest AS (SELECT name, arg_max(value, (ts, seq)) AS v, arg_max(label_user, (ts, seq)) AS u FROM samples GROUP BY name)
SELECT CAST(a.reg_seq AS BIGINT) AS reg_seq, l.line_no, l.line FROM auto a JOIN latest s ON s.name = a.name,
  LATERAL (SELECT * FROM (VALUES (0, '# HELP ' || a.name || ' ' || a.description),
                                 (1, '# TYPE ' || a.name || ' ' || a.type),
                                 (2, a.name || '{{user="' || s.u || '"}} ' || CAST(s.v AS VARCHAR))) v(line_no, line)) l""",
                                              "samples"))
def k4_export_prometheus(spark, sf):
    samples = A.metric_samples(spark, sf)
    reg = R.effective_registry(R.default_registry(spark), samples)
    return prometheus_lines(reg, G.latest_metric_values(samples))


@register("f15_split_known_fields", """
SELECT event_id, json_extract_string(props, '$.k') AS k, '{}' AS extra_json FROM events""")
def f15_split_known_fields(spark, sf):
    ev = A.read_table(spark, sf, "events")
    m = F.from_json("props", "map<string,string>")
    return ev.select("event_id", *T.split_known_fields(m, ["k"]))


@register("f15_remainder", """
SELECT event_id, event_type AS description, CAST(NULL AS VARCHAR) AS tags, CAST(user_id AS VARCHAR) AS width,
       '{"k":"' || json_extract_string(props, '$.k') || '","source":"log ' || CAST(event_id % 3 AS VARCHAR) || '"}' AS extra_json
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def f15_remainder(spark, sf):
    """Known fields as columns (absent ones null), the others kept as JSON."""
    ev = A.read_table(spark, sf, "events").filter(F.get_json_object("props", "$.k").isNotNull())
    meta = F.create_map(F.lit("description"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"),
                        F.lit("width"), F.col("user_id").cast("string"),
                        F.lit("source"), F.concat(F.lit("log "), (F.col("event_id") % 3).cast("string")))
    known = T.split_known_fields(meta, ["description", "tags", "width"])
    return ev.select("event_id", *known)


REGISTRY_TEXT_SQL = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{t}', '{d}', {i})" for i, (n, t, d, _u) in enumerate(R.DEFAULT_METRICS)) + ") v(name, type, description, reg_seq))"


@register("k4_metrics_file", with_views(f""", {REGISTRY_TEXT_SQL},
named AS (SELECT CASE event_type WHEN 'click' THEN 'api_requests_total' WHEN 'error' THEN 'cpu_usage_percent' ELSE event_type END AS name,
                 value, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, CAST(user_id AS VARCHAR) AS u FROM events),
latest AS (SELECT name, arg_max(value, (ts, seq)) AS v, arg_max(u, (ts, seq)) AS u FROM named GROUP BY name)
SELECT row_number() OVER (ORDER BY reg_seq, n) AS n, line FROM (
  SELECT r.reg_seq, n, line FROM registry r JOIN latest l ON l.name = r.name,
    LATERAL (SELECT * FROM (VALUES (0, '# HELP ' || r.name || ' ' || r.description), (1, '# TYPE ' || r.name || ' ' || r.type),
             (2, r.name || '{{user="' || l.u || '"}} ' || CAST(l.v AS VARCHAR))) v(n, line)) x) t""", "samples"))
def k4_metrics_file(spark, sf):
    """Two registered metrics with samples, exported as one text file in registry order and read back."""
    from ..session import scratch_path
    from ..sources.sinks import export_prometheus
    named = F.when(F.col("name") == "click", "api_requests_total").when(F.col("name") == "error", "cpu_usage_percent").otherwise(F.col("name"))
    samples = A.metric_samples(spark, sf).withColumn("name", named)
    path = scratch_path(spark, "metrics-file")
    export_prometheus(R.default_registry(spark), G.latest_metric_values(samples), path)
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.select((F.col("at") + 1).alias("n"), F.col("value").alias("line"))


@register("u2_checks", with_views("""
SELECT id, unnest(['memory', 'broken', 'silent']) AS "check",
       unnest([CASE WHEN memory_mb > 1024 THEN 'critical' ELSE 'healthy' END, 'unknown',
               CASE WHEN cpu_percent > 80 THEN 'warning' ELSE 'unknown' END]) AS status FROM sysmetrics""", "sysmetrics"))
def u2_checks(spark, sf):
    """User checks over every reading: one that fails on some row is unknown, the others are answered."""
    checks = R.CheckRegistry()
    checks.register_check("memory", F.when(F.col("memory_mb") > 1024, "critical").otherwise("healthy"))
    checks.register_check("broken", F.when(F.concat(F.lit("n"), F.col("id").cast("string")).cast("int") > 0, "healthy"))
    checks.register_check("silent", F.when(F.col("cpu_percent") > 80, "warning"))
    return checks.evaluate(A.system_metrics(spark, sf), keep=["id"])


@register("u3_register_metrics", f"""
WITH {REGISTRY_TEXT_SQL},
fresh AS (SELECT 'metric_' || CAST(user_id AS VARCHAR) AS name, 'Seen ' || CAST(count(*) AS VARCHAR) AS description,
                 1000 + user_id AS reg_seq FROM events GROUP BY user_id)
SELECT name, type, description, CAST(reg_seq AS BIGINT) AS reg_seq FROM registry WHERE name <> 'cpu_usage_percent'
UNION ALL SELECT 'cpu_usage_percent', 'histogram', 'again', CAST(reg_seq AS BIGINT) FROM registry WHERE name = 'cpu_usage_percent'
UNION ALL SELECT name, 'gauge', description, CAST(reg_seq AS BIGINT) FROM fresh""")
def u3_register_metrics(spark, sf):
    """A definition per user merged into the registry, twice; then one default is registered again."""
    ev = A.read_table(spark, sf, "events").groupBy("user_id").count()
    fresh = ev.select(F.concat(F.lit("metric_"), F.col("user_id").cast("string")).alias("name"), F.lit("gauge").alias("type"),
                      F.concat(F.lit("Seen "), F.col("count").cast("string")).alias("description"), F.lit("").alias("unit"),
                      F.create_map().cast("map<string,string>").alias("labels"), (F.lit(1000) + F.col("user_id")).alias("reg_seq"))
    registry = R.register_metrics(R.register_metrics(R.default_registry(spark), fresh), fresh)
    registry = R.register_metric(registry, "cpu_usage_percent", "histogram", "again")
    return registry.select("name", "type", "description", "reg_seq")


U1_COUNTS_SQL = """
t AS (SELECT {id}, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\pL\\pN]+'),
                                      lambda x: x <> '')) AS tok FROM {table}),
h AS (SELECT {id}, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket,
             CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
c AS (SELECT {id}, bucket, sum(s)::DOUBLE AS n FROM h GROUP BY {id}, bucket HAVING sum(s) <> 0)"""


@register("u1_vectors", f"""WITH {U1_COUNTS_SQL.format(id='doc_id', text='text', table='documents')}
SELECT doc_id, bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM c""")
def u1_vectors(spark, sf):
    """The default encoder's unit vectors (md5 form) of every whole document, a row per nonzero component."""
    d = A.read_table(spark, sf, "documents").select("doc_id", "text")
    e = HashingEncoder(dim=384, hash_fn="md5").transform(d, "text")
    return (e.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).filter("value <> 0")
            .select("doc_id", "bucket", F.round(F.col("value").cast("double"), 5).alias("value")))


@register("u1_hashing_counts", """
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'),
                                             lambda x: x <> '')) AS tok FROM documents),
h AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket,
             CASE WHEN ('0x' || substr(md5(tok), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s FROM t)
SELECT doc_id, bucket, CAST(sum(s) AS BIGINT) AS count FROM h GROUP BY doc_id, bucket HAVING sum(s) <> 0""")
def u1_hashing_counts(spark, sf):
    """The hashing encoder (md5 form, 384 buckets) over every whole document, as signed token
    counts per bucket – the vector before normalisation."""
    d = A.read_table(spark, sf, "documents").select("doc_id", "text")
    return HashingEncoder(dim=384, hash_fn="md5").signed_counts(d, "text", "doc_id")


@register("u1_embed_text")
def u1_embed_text(spark, sf):
    """Rows-only: every document embedded by the default hashing encoder (whole texts)."""
    d = A.read_table(spark, sf, "documents").select("doc_id", "text")
    e = HashingEncoder(dim=384).transform(d, "text")
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm("embedding"), 4).alias("norm"))

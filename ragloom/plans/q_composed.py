"""Catalogue entries: composed jobs (X2 RAG, X4 generation ledger, X3/X5 reports) and the
approximate index (V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import aggregates as G
from ..operators import ann
from ..operators import predicates as P
from ..operators import vectors as V
from . import rag, reports
from .catalog import register
from .q_aggregates import STATUS_COLS
from .q_relational import P10_SQL

SCENES_SQL = "['indoor', 'outdoor', 'kitchen', 'living room', 'park', 'street', 'garden']"

RAG_SQL = A.with_views(f""",
q AS (SELECT b.item_id AS qid, b.text AS query, e.embedding::DOUBLE[] AS qv
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
scored AS (SELECT q.qid, c.id, list_distance(c.embedding::DOUBLE[], q.qv) ^ 2 AS d,
                  row_number() OVER (PARTITION BY q.qid ORDER BY list_distance(c.embedding::DOUBLE[], q.qv), c.id) AS rank
           FROM q, vectors c),
hits AS (SELECT qid, id, rank FROM scored WHERE rank <= 3 AND 1.0 / (1.0 + d) >= 0.1),
ex AS (SELECT h.qid, h.rank, h.id, i.description, i.tags FROM hits h JOIN images i ON i.id = h.id),
per AS (SELECT qid, list(description ORDER BY rank) AS descs, list(tags ORDER BY rank) AS tagss,
               array_to_string(list(CAST(id AS VARCHAR) ORDER BY rank), ',') AS retrieved, count(*) AS n
        FROM ex GROUP BY qid),
base AS (SELECT q.qid, q.query, coalesce(per.n, 0) AS n_examples, coalesce(per.retrieved, '') AS retrieved,
                coalesce(per.descs, []::VARCHAR[]) AS descs, coalesce(per.tagss, []::VARCHAR[][]) AS tagss
         FROM q LEFT JOIN per ON per.qid = q.qid),
s1 AS (SELECT *, flatten(list_transform(descs, lambda d: list_filter({SCENES_SQL},
                   lambda k: coalesce(contains(lower(d), k), false)))) AS sc_all,
              flatten(list_transform(tagss, lambda t: coalesce(t, []::VARCHAR[]))) AS ob_all FROM base),
s2 AS (SELECT *, list_filter(sc_all, lambda x, i: list_position(sc_all, x) = i) AS scenes,
              list_slice(list_filter(ob_all, lambda x, i: list_position(ob_all, x) = i), 1, 3) AS obj3 FROM s1),
s3 AS (SELECT *, list_filter(obj3, lambda o: NOT contains(lower(query), lower(o))) AS new_objs FROM s2),
s4 AS (SELECT *, CASE WHEN len(scenes) > 0 THEN 'in ' || array_to_string(list_slice(scenes, 1, 2), ', ') || ' setting' END AS sp,
              CASE WHEN len(new_objs) > 0 THEN 'with ' || array_to_string(new_objs, ', ') END AS op FROM s3),
out AS (SELECT qid, n_examples, retrieved,
           CASE WHEN n_examples = 0 THEN query WHEN sp IS NULL AND op IS NULL THEN query || ', in realistic style'
                ELSE concat_ws(', ', query, sp, op) END AS augmented_prompt FROM s4)
""", "vectors", "images")


def _rag(spark, sf):
    corpus = A.embeddings(spark, sf)
    bench = A.read_table(spark, sf, "benchmark")
    queries = bench.join(corpus.select(F.col("id").alias("item_id"), F.col("embedding").alias("query_vector")),
                         "item_id").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), "query_vector")
    return rag.rag_process(queries, corpus, A.images(spark, sf), n=3, threshold=0.1)


@register("x2_rag_process", RAG_SQL + "SELECT qid, augmented_prompt, n_examples FROM out")
def x2_rag_process(spark, sf):
    """Benchmark passages as prompts, their vectors as queries, documents as the image catalogue."""
    r = _rag(spark, sf)
    return r.select("qid", "augmented_prompt", F.col("n_examples").cast("long").alias("n_examples"))


@register("x4_record_generation", RAG_SQL + """
SELECT qid AS id, 'generated_r1_01.png' AS output_path, retrieved, 'completed' AS status FROM out""")
def x4_record_generation(spark, sf):
    led = rag.record_generations(_rag(spark, sf), run_id="r1")
    return led.select("id", "output_path",
                      F.array_join(F.transform("retrieved_examples", lambda e: e["image_id"].cast("string")), ",")
                      .alias("retrieved"), "status")


@register("x2_rag_from_text")
def x2_rag_from_text(spark, sf):
    """Rows-only: benchmark passages and whole documents both encoded by U1, then X2 (cosine)."""
    bench = A.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    docs = A.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    r = rag.rag_from_text(bench, docs, A.images(spark, sf), n=3, threshold=0.0)
    return r.select("qid", "augmented_prompt", "n_examples")


_INDEXES: dict[tuple[str, str], tuple[str, int]] = {}


def _ivf_index(spark, sf):
    """The stored index over every vector (lists = sqrt(n)) and its number of lists: written once
    per application and table, then searched by every query that asks for it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        from ..session import scratch_path
        corpus = A.embeddings(spark, sf)
        lists = max(2, int(corpus.count() ** 0.5))
        path = scratch_path(spark, "ivf-index")
        ann.ivf_store(corpus, path, lists=lists, max_iter=10)
        _INDEXES[key] = (path, lists)
    return _INDEXES[key]


def _ivf_all(spark, sf, k):
    path, lists = _ivf_index(spark, sf)
    corpus = A.embeddings(spark, sf)
    queries = corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    return ann.ivf_probe(queries, path, k=k, nprobe=max(1, lists * 3 // 5))


@register("v6_ivf_search")
def v6_ivf_search(spark, sf):
    """Every vector's approximate top-5 from the stored index; v6_recall measures it, v6_self_match
    checks its scores."""
    return _ivf_all(spark, sf, 5)


@register("v6_self_match", """
SELECT e.vec_id AS qid, min(o.vec_id) AS id, CAST(1.0 AS DOUBLE) AS score
FROM embeddings e JOIN embeddings o ON o.embedding = e.embedding GROUP BY e.vec_id""")
def v6_self_match(spark, sf):
    """A search with a stored vector finds it first, with score 1 (of equal vectors the smallest id)."""
    hits = _ivf_all(spark, sf, 1)
    return hits.select("qid", "id", F.round("score", 6).alias("score"))


@register("v6_recall", """
SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS at_least_nine_tenths FROM embeddings""")
def v6_recall(spark, sf):
    """The approximate top-5 of every vector against the exact one (V5)."""
    corpus = A.embeddings(spark, sf)
    queries = corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))
    rows = ann.recall_rows(_ivf_all(spark, sf, 5), V.batch_topk(queries, corpus, k=5, metric="cosine"))
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"),
                    (F.sum("found") >= 0.9 * F.sum("wanted")).alias("at_least_nine_tenths"))


X3_SQL = A.with_views("""
, anchor AS (SELECT max(created_at) AS t FROM generations),
trends AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS count, coalesce(avg(generation_time_ms), 0) AS avg_time,
                  count(*) FILTER (WHERE status = 'completed') AS successful
           FROM generations WHERE created_at > (SELECT t FROM anchor) - INTERVAL 30 DAYS GROUP BY 1),
usage AS (SELECT model_type, model_name, count(*) AS usage_count,
                 avg((epoch_us((SELECT t FROM anchor)) - epoch_us(created_at)) / 3.6e9) AS hours_ago
          FROM vectors GROUP BY 1, 2 ORDER BY usage_count DESC, model_type, model_name LIMIT 5)
SELECT 'basic_stats' AS section, t AS key, 'rows' AS metric, CAST(n AS VARCHAR) AS value FROM (
  SELECT 'images' AS t, count(*) AS n FROM images UNION ALL SELECT 'embeddings', count(*) FROM vectors
  UNION ALL SELECT 'generations', count(*) FROM generations UNION ALL SELECT 'model_cache', count(*) FROM cache) b
UNION ALL
SELECT 'success_rate', '', unnest(['total', 'completed', 'success_rate']),
       unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE status = 'completed') AS VARCHAR),
               CAST(round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status = 'completed') / count(*) * 100
                               ELSE 0 END, 6) AS VARCHAR)])
FROM generations
UNION ALL
SELECT 'generation_trends', CAST(date AS VARCHAR), unnest(['count', 'avg_time', 'successful', 'success_rate']),
       unnest([CAST(count AS VARCHAR), CAST(round(avg_time, 6) AS VARCHAR), CAST(successful AS VARCHAR),
               CAST(round(CASE WHEN count > 0 THEN successful / count * 100 ELSE 0 END, 6) AS VARCHAR)])
FROM trends
UNION ALL
SELECT 'trends_summary', '', unnest(['total_generations', 'average_daily', 'peak_day', 'average_generation_time']),
       unnest([CAST(CAST(sum(count) AS BIGINT) AS VARCHAR), CAST(round(avg(count), 6) AS VARCHAR),
               CAST(max(count) AS VARCHAR), CAST(round(avg(avg_time), 6) AS VARCHAR)])
FROM trends
UNION ALL
SELECT 'top_models', model_type || '/' || model_name, unnest(['usage_count', 'hours_ago']),
       unnest([CAST(usage_count AS VARCHAR), CAST(round(hours_ago, 6) AS VARCHAR)])
FROM usage""", "images", "vectors", "generations", "cache")


def _document_metadata(spark, sf):
    d = A.read_table(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))
                    .alias("image_filename"), F.col("text").alias("description"),
                    F.concat_ws(",", "lang", "source").alias("tags"), F.col("source").alias("style"),
                    F.col("lang").alias("category"))


@register("x1_ingest_documents", """
SELECT 'data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS image_path,
       md5(concat_ws(' | ', CASE WHEN text <> '' THEN 'Description: ' || text END, 'Tags: ' || lang || ',' || source,
                     'Style: ' || source, 'Category: ' || lang)) AS h,
       384 AS dim
FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND source <> 'src0'""")
def x1_ingest_documents(spark, sf):
    """X1 over the documents as a metadata table: files exist for documents with a quality label
    of 1, images of source src0 are already stored; new rows get F6 text and a U1 embedding."""
    from .ingest import csv_items, ingest
    d = A.read_table(spark, sf, "documents")
    items = csv_items(_document_metadata(spark, sf), "data")
    labels = A.read_table(spark, sf, "labels").filter(F.col("quality") == 1)
    files = d.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        F.concat(F.lit("data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    existing = items.filter(F.col("style") == "src0").select("image_path")
    imgs, emb, _rejected = ingest(items, files, existing)
    with_text = items.select("image_path", F.md5("text").alias("h"))
    return (imgs.select("id", "image_path").join(with_text, "image_path")
            .join(emb.select(F.col("image_id").alias("id"), F.size("embedding").alias("dim")), "id")
            .select("image_path", "h", "dim"))


@register("x1_ingest_all", """
SELECT 'data/' || source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS image_path,
       md5(concat_ws(' | ', CASE WHEN text <> '' THEN 'Description: ' || text END, 'Tags: ' || lang || ',' || source,
                     'Style: ' || source, 'Category: ' || lang)) AS h, 384 AS dim
FROM documents""")
def x1_ingest_all(spark, sf):
    """X1 over every document: all files exist and nothing is stored yet."""
    from .ingest import csv_items, ingest
    items = csv_items(_document_metadata(spark, sf), "data")
    imgs, emb, _rejected = ingest(items, items.select(F.col("image_path").alias("path")), items.select("image_path").limit(0))
    with_text = items.select("image_path", F.md5("text").alias("h"))
    return (imgs.select("id", "image_path").join(with_text, "image_path")
            .join(emb.select(F.col("image_id").alias("id"), F.size("embedding").alias("dim")), "id")
            .select("image_path", "h", "dim"))


@register("v6_ivf_search_stored")
def v6_ivf_search_stored(spark, sf):
    """One query (the lowest id's vector) probes a quarter of the stored lists; only those
    partitions are read."""
    path, lists = _ivf_index(spark, sf)
    q = A.embeddings(spark, sf).orderBy("id").select("embedding").first()["embedding"]  # one query vector
    return ann.ivf_search_one(spark, q, f"{path}/vectors", spark.read.parquet(f"{path}/centroids"), k=5,
                              nprobe=max(1, lists // 4))


@register("x3_analytics_report", X3_SQL)
def x3_analytics_report(spark, sf):
    """The sectioned analytics report (long form: section, key, metric, value as text)."""
    g = A.generations(spark, sf)
    as_of = g.select(F.max("created_at")).scalar()
    return reports.analytics_report(A.images(spark, sf), A.embeddings(spark, sf), g, A.cache_entries(spark, sf),
                                    as_of=as_of)


@register("k3_report_roundtrip", X3_SQL)
def k3_report_roundtrip(spark, sf):
    """The analytics report written as JSON lines by K3 and read back."""
    from ..session import scratch_path
    from ..sources.sinks import write_report
    path = scratch_path(spark, "report")
    write_report(x3_analytics_report(spark, sf), path, "json")
    return spark.read.schema("section string, key string, metric string, value string").json(path)


def _perf_sql():
    aggs = ("count(*) AS n, avg(duration) AS avg_duration, max(duration) AS max_duration, min(duration) AS min_duration, "
            "avg(memory_after - memory_before) AS avg_memory_delta, max(memory_after - memory_before) AS max_memory_delta, "
            "avg(cpu_percent) AS avg_cpu, max(cpu_percent) AS max_cpu")
    return (f"SELECT 'overall' AS level, CAST(NULL AS VARCHAR) AS component, {aggs} FROM operations "
            f"UNION ALL SELECT 'component', component, {aggs} FROM operations GROUP BY component")


def _r6(c):
    return f"CAST(round({c}, 6) AS VARCHAR)"


X5_SQL = A.with_views(f""",
perf AS ({_perf_sql()}),
checks AS (SELECT unnest([system_status, memory_status, cpu_status, disk_status, gpu_status, cache_status]) AS status
           FROM ({P10_SQL}) x),
health AS (SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'healthy') AS healthy_checks,
                  count(*) FILTER (WHERE status = 'warning') AS warning_checks,
                  count(*) FILTER (WHERE status = 'critical') AS critical_checks,
                  count(*) FILTER (WHERE status = 'unknown') AS unknown_checks,
                  CASE max(CASE status WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'healthy' THEN 1 ELSE 0 END)
                       WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'healthy' ELSE 'unknown' END
                       AS overall_status FROM checks),
cstats AS (SELECT model_type, count(*) AS misses, CAST(sum(access_count) AS BIGINT) AS hits,
                  CAST(sum(access_count) + count(*) AS BIGINT) AS requests,
                  sum(access_count) / (sum(access_count) + count(*)) AS hit_rate FROM cache GROUP BY model_type)
SELECT 'performance' AS section, concat_ws('/', level, component) AS key,
       unnest(['n', 'avg_duration', 'max_duration', 'min_duration', 'avg_memory_delta', 'max_memory_delta',
               'avg_cpu', 'max_cpu']) AS metric,
       unnest([CAST(n AS VARCHAR), {_r6('avg_duration')}, {_r6('max_duration')}, {_r6('min_duration')},
               {_r6('avg_memory_delta')}, {_r6('max_memory_delta')}, {_r6('avg_cpu')}, {_r6('max_cpu')}]) AS value
FROM perf
UNION ALL
SELECT 'health', '', unnest(['total_checks', 'healthy_checks', 'warning_checks', 'critical_checks', 'unknown_checks',
                             'overall_status']),
       unnest([CAST(total_checks AS VARCHAR), CAST(healthy_checks AS VARCHAR), CAST(warning_checks AS VARCHAR),
               CAST(critical_checks AS VARCHAR), CAST(unknown_checks AS VARCHAR), overall_status])
FROM health
UNION ALL
SELECT 'cache', model_type, unnest(['requests', 'hits', 'misses', 'hit_rate', 'hit_rate_percent']),
       unnest([CAST(requests AS VARCHAR), CAST(hits AS VARCHAR), CAST(misses AS VARCHAR), {_r6('hit_rate')},
               {_r6('hit_rate * 100')}])
FROM cstats""", "operations", "cache")


@register("x5_monitor_report", X5_SQL)
def x5_monitor_report(spark, sf):
    """Performance, health and cache sections in one report (long form, values as text)."""
    c = P.classify_thresholds(A.system_metrics(spark, sf))
    long = G.checks_long(c, STATUS_COLS, ["component"])
    return reports.monitor_report(A.operations(spark, sf), long, A.cache_entries(spark, sf))

"""Catalogue entries for vector search (V1-V9) and search joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_views
from ..operators import joins, vectors as V
from .catalog import register


def first_vector(corpus):
    """The query vector used by single-query entries: the vector of the lowest id, one
    partial-aggregated scalar subquery (no driver round trip)."""
    return corpus.select(F.min_by("embedding", "id")).scalar()


def first_unit_vector(corpus):
    """The same query vector scaled to unit length inside the same scalar subquery."""
    v = F.min_by("embedding", "id").cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return corpus.select(F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)).scalar()


Q_SQL = "q AS (SELECT embedding::DOUBLE[] AS qv FROM vectors WHERE id = (SELECT min(id) FROM vectors))"


def _v(sql):
    return with_views(sql, "vectors")


@register("v1_cosine_topk", _v(f""", {Q_SQL}
SELECT id, image_id, model_type,
       round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity_score
FROM vectors, q
ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, id LIMIT 5"""))
def v1_cosine_topk(spark, sf):
    """Top-5 cosine neighbours of the lowest id's vector over the whole corpus."""
    corpus = A.embeddings(spark, sf)
    hits = V.cosine_topk(corpus, first_unit_vector(corpus), k=5, query_is_unit=True)
    return hits.select("id", "image_id", "model_type", F.round("similarity_score", 6).alias("similarity_score"))


@register("v1_cosine_topk_threshold", _v(f""", {Q_SQL}
SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity_score
FROM vectors, q
WHERE list_cosine_similarity(embedding::DOUBLE[], qv) >= 0.2
ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, id LIMIT 20"""))
def v1_cosine_topk_threshold(spark, sf):
    corpus = A.embeddings(spark, sf)
    hits = V.cosine_topk(corpus, first_unit_vector(corpus), k=20, threshold=0.2, query_is_unit=True)
    return hits.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@register("p6_filter_model_topk", _v(f""", {Q_SQL}
SELECT id, model_type, embedding_type,
       round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity_score
FROM vectors, q
WHERE model_type = 'sentence_transformer' AND embedding_type = 'text'
ORDER BY list_cosine_similarity(embedding::DOUBLE[], qv) DESC, id LIMIT 5"""))
def p6_filter_model_topk(spark, sf):
    corpus = A.embeddings(spark, sf)
    hits = V.cosine_topk(corpus, first_vector(corpus), k=5, model_type="sentence_transformer",
                         embedding_type="text")
    return hits.select("id", "model_type", "embedding_type", F.round("similarity_score", 6).alias("similarity_score"))


@register("v2_zero_safe_cosine", _v(f""", {Q_SQL}
SELECT id, round(list_dot_product(embedding::DOUBLE[], qv)
             / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv)) + 1e-9), 6)
       AS similarity_score
FROM vectors, q
ORDER BY list_dot_product(embedding::DOUBLE[], qv)
             / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv)) + 1e-9) DESC, id
LIMIT 10"""))
def v2_zero_safe_cosine(spark, sf):
    corpus = A.embeddings(spark, sf)
    hits = V.zero_safe_cosine_topk(corpus, first_vector(corpus), k=10)
    return hits.select("id", F.round("similarity_score", 6).alias("similarity_score"))


@register("v3_l2_topk", _v(f""", {Q_SQL}
SELECT id, round(list_distance(embedding::DOUBLE[], qv) ^ 2, 6) AS distance,
       round(1.0 / (1.0 + list_distance(embedding::DOUBLE[], qv) ^ 2), 6) AS similarity_score
FROM vectors, q
ORDER BY list_distance(embedding::DOUBLE[], qv) ASC, id LIMIT 5"""))
def v3_l2_topk(spark, sf):
    corpus = A.embeddings(spark, sf)
    hits = V.l2_topk(corpus, first_vector(corpus), k=5)
    return hits.select("id", F.round("distance", 6).alias("distance"),
                       F.round("similarity_score", 6).alias("similarity_score"))


def _self_queries(corpus):
    return corpus.select(F.col("id").alias("qid"), F.col("embedding").alias("query_vector"))


@register("v5_batch_topk", _v("""
SELECT qid, id, round(score, 6) AS score, rank FROM (
  SELECT q.id AS qid, c.id AS id,
         list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, c.id) AS rank
  FROM vectors q, vectors c) t
WHERE rank <= 5"""))
def v5_batch_topk(spark, sf):
    """Every vector's top-5 cosine neighbours (broadcast block plan, per-task top-k)."""
    corpus = A.embeddings(spark, sf)
    hits = V.batch_topk(_self_queries(corpus), corpus, k=5, metric="cosine")
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("v5_batch_topk_blocked", _v("""
SELECT qid, id, round(score, 6) AS score, rank FROM (
  SELECT q.id AS qid, c.id AS id,
         list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, c.id) AS rank
  FROM vectors q, vectors c) t
WHERE rank <= 3"""))
def v5_batch_topk_blocked(spark, sf):
    """The blocked (non-broadcast) plan of V5, forced with a zero broadcast budget."""
    corpus = A.embeddings(spark, sf)
    hits = V.batch_topk(_self_queries(corpus), corpus, k=3, metric="dot", max_broadcast_bytes=0, block_rows=200)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("v4_retrieve", with_views("""
SELECT qid, id, round(score, 6) AS distance, round(1.0 / (1.0 + score), 6) AS similarity_score FROM (
  SELECT b.item_id AS qid, c.id AS id,
         list_distance(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) ^ 2 AS score,
         row_number() OVER (PARTITION BY b.item_id ORDER BY list_distance(c.embedding::DOUBLE[], e.embedding::DOUBLE[]), c.id) AS rank
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id, vectors c) t
WHERE rank <= 3 AND 1.0 / (1.0 + score) >= 0.1""", "vectors"))
def v4_retrieve(spark, sf):
    """Benchmark items' vectors as queries: L2 top-3, similarity 1/(1+d) >= 0.1."""
    corpus = A.embeddings(spark, sf)
    bench = A.read_table(spark, sf, "benchmark")
    queries = bench.join(corpus.select(F.col("id").alias("item_id"), "embedding"), "item_id") \
        .select(F.col("item_id").alias("qid"), F.col("embedding").alias("query_vector"))
    hits = V.retrieve(queries, corpus, n=3, threshold=0.1)
    return hits.select("qid", "id", F.round("score", 6).alias("distance"),
                       F.round("similarity_score", 6).alias("similarity_score"))


@register("v7_check_vectors", with_views("""
SELECT CAST(len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))
            AND NOT list_bool_and(list_transform(embedding, lambda x: x = 0)) AS BOOLEAN) AS valid,
       count(*) AS n
FROM vectors GROUP BY 1""", "vectors"))
def v7_check_vectors(spark, sf):
    checked = V.check_vectors(A.embeddings(spark, sf), dim=64)
    return checked.groupBy("valid").agg(F.count("*").alias("n"))


@register("v9_scorers", _v(f""", {Q_SQL}
SELECT id, round(list_inner_product(embedding::DOUBLE[], qv), 6) AS inner_product,
       round(list_distance(embedding::DOUBLE[], qv), 6) AS l2_distance,
       round(1 - list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS cosine_distance
FROM vectors, q"""))
def v9_scorers(spark, sf):
    corpus = A.embeddings(spark, sf)
    corpus, q = V.bind_query(corpus, first_vector(corpus))
    return corpus.select("id", F.round(V.dot("embedding", q), 6).alias("inner_product"),
                         F.round(V.l2("embedding", q), 6).alias("l2_distance"),
                         F.round(1 - V.cosine_similarity("embedding", q), 6).alias("cosine_distance"))


@register("j1_enrich_hits", with_views(f""", {Q_SQL},
hits AS (SELECT id AS image_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS s
         FROM vectors, q ORDER BY s DESC, id LIMIT 10)
SELECT h.image_id, i.image_path, i.width, i.height, round(h.s, 6) AS similarity_score
FROM hits h JOIN images i ON i.id = h.image_id""", "vectors", "images"))
def j1_enrich_hits(spark, sf):
    corpus = A.embeddings(spark, sf)
    hits = V.cosine_topk(corpus, first_unit_vector(corpus), k=10, query_is_unit=True) \
        .select("image_id", "similarity_score")
    out = joins.enrich_hits(hits, A.images(spark, sf), hits_bounded=True)
    return out.select("image_id", "image_path", "width", "height",
                      F.round("similarity_score", 6).alias("similarity_score"))


@register("j7_knn_join_l2", _v("""
SELECT qid, id, round(score, 6) AS distance, rank FROM (
  SELECT q.id AS qid, c.id AS id, list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) ^ 2 AS score,
         row_number() OVER (PARTITION BY q.id ORDER BY list_distance(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), c.id) AS rank
  FROM vectors q, vectors c) t
WHERE rank <= 4"""))
def j7_knn_join_l2(spark, sf):
    """Every vector against the whole corpus under squared L2."""
    corpus = A.embeddings(spark, sf)
    queries = _self_queries(corpus)
    hits = joins.knn_join(queries, corpus, k=4, metric="l2")
    return hits.select("qid", "id", F.round("score", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _projection_sql(in_dim=64, out_dim=16, seed=42):
    """The same seeded matrix, generated from its seed, as a DuckDB list of its columns."""
    m = V.projection_matrix(in_dim, out_dim, seed)
    cols = ", ".join("[" + ", ".join(repr(float(x)) for x in m[:, j]) + "]" for j in range(out_dim))
    return f"""
SELECT e.vec_id AS id, CAST(r.j - 1 AS INTEGER) AS j,
       round(list_dot_product(e.embedding::DOUBLE[], ([{cols}])[r.j]), 6) AS value
FROM embeddings e, (SELECT unnest(generate_series(1, {out_dim})) AS j) r"""


@register("v8_projection_values", _projection_sql())
def v8_projection_values(spark, sf):
    """Every vector projected 64 -> 16 by the seeded matrix, one row per output component."""
    corpus = A.embeddings(spark, sf).select("id", "embedding")
    p = V.project_vectors(corpus, out_dim=16, in_dim=64)
    return p.select("id", F.posexplode("projected").alias("j", "value")).select(
        "id", F.col("j").cast("int").alias("j"), F.round("value", 6).alias("value"))


@register("v8_project_vectors")
def v8_project_vectors(spark, sf):
    """Rows-only check: a seeded 64 -> 16 projection of every vector."""
    corpus = A.embeddings(spark, sf).select("id", "embedding")
    return V.project_vectors(corpus, out_dim=16, in_dim=64).select("id", F.size("projected").alias("dim"))

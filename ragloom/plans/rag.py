"""Retrieval-augmented prompt building as one Spark plan.

queries (qid, query text, query vector) -> V4 retrieval (top-n, threshold) -> J1 join to the
image rows -> examples per query (bounded by n) -> F7 augmentation. Queries without any hit
keep their text unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import HashingEncoder
from ..functions.prompt import augment_prompt
from ..operators.joins import enrich_hits
from ..operators.vectors import batch_topk, retrieve


def rag_process(queries: DataFrame, corpus: DataFrame, images: DataFrame, n: int = 3, threshold: float = 0.1,
                metric: str = "l2", query_col: str = "query", **kw) -> DataFrame:
    """(qid, original_query, augmented_prompt, similar_examples, n_examples) per query."""
    qv = queries.select("qid", "query_vector")
    if metric == "l2":
        hits = retrieve(qv, corpus, n=n, threshold=threshold, **kw)
    else:
        hits = batch_topk(qv, corpus, k=n, metric=metric, threshold=threshold, **kw) \
            .withColumn("similarity_score", F.col("score"))
    ex = enrich_hits(hits.select("qid", F.col("id").alias("image_id"), "rank", "similarity_score"), images)
    per_q = ex.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "image_id", "image_path", "description", "tags", "similarity_score"))).alias("similar_examples"))
    out = queries.select("qid", F.col(query_col).alias("original_query")).join(per_q, "qid", "left")
    return (out.withColumn("augmented_prompt", augment_prompt(F.col("original_query"), F.col("similar_examples")))
               .withColumn("n_examples", F.coalesce(F.size("similar_examples"), F.lit(0))))


def rag_from_text(queries: DataFrame, corpus_texts: DataFrame, images: DataFrame, encoder=None, n: int = 3,
                  threshold: float = 0.1) -> DataFrame:
    """X2 from text: queries (qid, query) and corpus (id, text) are encoded by U1, then X2 with
    cosine similarity (the encoder's vectors are unit length)."""
    enc = encoder or HashingEncoder(dim=384)
    q = enc.transform(queries, "query", "query_vector")
    c = enc.transform(corpus_texts, "text", "embedding")
    return rag_process(q, c, images, n=n, threshold=threshold, metric="cosine")


def record_generations(rag: DataFrame, run_id: str = "run") -> DataFrame:
    """One ledger row per prompt with its retrieved examples (no image model is run)."""
    return rag.select(
        F.col("qid").alias("id"),
        F.col("original_query").alias("prompt"),
        "augmented_prompt",
        F.format_string("%s_%s_%02d.%s", F.lit("generated"), F.lit(run_id), F.lit(1), F.lit("png")).alias("output_path"),
        F.lit(42).alias("seed"),
        F.coalesce(F.transform("similar_examples", lambda e: F.struct(e["image_id"].alias("image_id"),
                                                                      e["similarity_score"].alias("similarity_score"))),
                   F.array().cast("array<struct<image_id:bigint,similarity_score:double>>")).alias("retrieved_examples"),
        F.lit("completed").alias("status"),
    )


record_generation = record_generations  # X4 under its inventory name

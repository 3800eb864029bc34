"""V6: approximate search with an inverted-file (IVF) layout, cosine metric.

train: Spark ML KMeans over a sample of the unit vectors (``sample_per_list`` rows per list,
chosen by id hash) gives ``lists`` unit centroids. Their matrix is broadcast, so its size is
checked against ``MAX_CENTROID_BYTES``.

store: every vector goes to the list of its nearest centroid (largest inner product, ties to the
lower list) in one Arrow pass. :func:`ivf_store` writes the index once: vectors partitioned by
list, each list cut into parts of about ``LIST_ROWS`` vectors by its own size, beside the centroid
table and the table of list sizes.

search: each query probes its ``nprobe`` nearest lists. Blocks of queries meet shards, which hold several
lists, in groups; in a group each list is scored against its queries by a numpy product, and at most k
candidates per query and group come out; a final ``row_number() <= k`` per query finishes. The scan of the
vectors joins the probed lists, which prunes every other list's partition (dynamic partition pruning) before a
vector is read. A vector is always in its own first probe, so a search finds itself.

Vectors that are null, of another size than the first centroid, or that hold a null or
non-finite component are in no list and probe none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root, cut_lineage, scratch_path
from .vectors import TopK, _score_chunked, _scorable, _stack, block_count

MAX_CENTROID_BYTES = 64 << 20
LIST_ROWS = 20_000  # vectors of a list, or queries of a list, that meet in one task
SAMPLE_PER_LIST = 256


def _unit(vec_col: str):
    v = F.col(vec_col).cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def ivf_train(corpus: DataFrame, lists: int = 100, id_col: str = "id", vector_col: str = "embedding",
              seed: int = 42, max_iter: int = 20, sample_per_list: int = SAMPLE_PER_LIST) -> DataFrame:
    """Unit centroids (list_id, centroid) of KMeans over a sample of about ``lists`` x
    ``sample_per_list`` vectors, those whose id hash is smallest; all vectors where there are no more."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    checkpoint_root(spark)  # KMeans checkpoints into the shared folder
    rows = corpus.filter(_scorable(vector_col))
    n = rows.count()
    share = min(1.0, lists * sample_per_list / n) if n else 1.0
    some = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    size = rows.select(F.min_by(F.size(vector_col), F.col(id_col))).first()[0] or 0
    if lists * size * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"{lists} centroids of {size} components exceed the {MAX_CENTROID_BYTES} bytes that are broadcast")
    data = rows.filter(some & (F.size(vector_col) == size)).select(array_to_vector(_unit(vector_col)).alias("features"))
    model = KMeans(k=max(lists, 2), seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="list_id", initMode="k-means||").fit(data.cache())
    data.unpersist()
    cents = [np.asarray(c) for c in model.clusterCenters()]
    return spark.createDataFrame([(i, (c / (np.linalg.norm(c) or 1.0)).tolist()) for i, c in enumerate(cents)],
                                 "list_id int, centroid array<double>")


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of at most ``MAX_CENTROID_BYTES`` (checked when they were trained)."""
    rows = centroids.orderBy("list_id").collect()
    return (np.asarray([r["list_id"] for r in rows], dtype=np.int64),
            np.asarray([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), -1))


NEAR_BYTES = 32 << 20  # of scores, or of rows that are repeated, at once


def _nearest_lists(df: DataFrame, vec_col: str, centroids, nprobe: int, as_array: bool = False) -> DataFrame:
    """One row per row of ``df`` and list among its ``nprobe`` nearest, with ``list_id``; ``as_array``: one row
    per row of ``df`` with their array ``lists``."""
    bc = df.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids[1].shape[1]
    npr = min(nprobe, len(centroids[0]))
    added = T.StructField("lists", T.ArrayType(T.IntegerType())) if as_array else T.StructField("list_id", T.IntegerType())
    schema = T.StructType([*df.schema.fields, added])
    some = max(1, NEAR_BYTES // (8 * max(len(centroids[0]), 1 if as_array else dim * npr)))

    def near(batches):
        ids, mat = bc.value
        for batch in batches:
            for a in range(0, len(batch), some):
                pdf = batch.iloc[a:a + some]
                s = _stack(pdf[vec_col], dim) @ mat.T
                top = ids[np.argsort(-s, axis=1, kind="stable")[:, :npr] if npr > 1 else s.argmax(axis=1)[:, None]].astype(np.int32)
                if as_array:
                    yield pdf.assign(lists=list(top))
                else:
                    yield pdf.loc[pdf.index.repeat(npr)].reset_index(drop=True).assign(list_id=top.ravel())

    return df.filter(_scorable(vec_col) & (F.size(vec_col) == dim)).mapInPandas(near, schema)


def ivf_build(corpus: DataFrame, lists: int = 100, id_col: str = "id", vector_col: str = "embedding",
              seed: int = 42, max_iter: int = 20, materialize: bool = False):
    """Returns (index, centroids): index = (id, vector, list_id), centroids = (list_id, centroid).
    ``materialize=True`` checkpoints the assigned index into the shared checkpoint folder, so
    repeated probes neither re-run the assignment nor depend on lost executors' blocks."""
    centroids = ivf_train(corpus, lists, id_col, vector_col, seed, max_iter)
    data = corpus.select(F.col(id_col).alias("id"), _unit(vector_col).alias("vector"))
    index = _nearest_lists(data, "vector", _centroid_matrix(centroids), 1)
    return (cut_lineage(index) if materialize else index), centroids


# ------------------------------------------------------------------ stored index
def ivf_store(corpus: DataFrame, path: str, lists: int = 100, id_col: str = "id", vector_col: str = "embedding",
              seed: int = 42, max_iter: int = 20, list_rows: int = LIST_ROWS) -> None:
    """Write the index under ``path``: ``centroids``, ``lists`` (list_id, n, parts) and ``vectors``
    (id, vector, part) partitioned by list_id."""
    spark = corpus.sparkSession
    index, centroids = ivf_build(corpus, lists, id_col, vector_col, seed, max_iter)
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    assigned = scratch_path(spark, "ivf-assigned")
    index.write.parquet(assigned)
    index = spark.read.schema(index.schema).parquet(assigned)
    sizes = (index.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("parts", F.ceil(F.col("n") / list_rows).cast("int")))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    sizes = spark.read.parquet(f"{path}/lists")
    cut = (index.join(F.broadcast(sizes.select("list_id", "parts")), "list_id")  # one row per list
           .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))
    cut.repartition("list_id", "part").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/vectors")


def ivf_probe(queries: DataFrame, path: str, k: int = 5, nprobe: int = 10, query_id: str = "qid",
              query_vec: str = "query_vector", query_rows: int = LIST_ROWS) -> DataFrame:
    """Approximate cosine top-k per query from the index stored at ``path``; (qid, id, score, rank).

    The lists' parts are put together to shards of about equal size and the queries cut into blocks, as in the
    blocked plan of :func:`.vectors.batch_topk`: a query is sent once to each shard that holds any of its lists, not
    once to each list. The probes are written under the checkpoint folder and read twice: to prune the scan of the
    vectors by a join with the probed lists, and to meet the vectors of their lists."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("__qid"), _unit(query_vec).alias("__qv"))
    centroids = _centroid_matrix(spark.read.parquet(f"{path}/centroids"))
    found = _nearest_lists(q, "__qv", centroids, nprobe, as_array=True)
    folder = scratch_path(spark, "ivf-probes")
    found.write.parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    dim = centroids[1].shape[1]
    # one row per list, which the bound of the centroids covers
    sizes = [(r["list_id"], r["n"], r["parts"]) for r in spark.read.parquet(f"{path}/lists").orderBy("list_id").collect()]
    total = sum(n for _, n, _ in sizes)
    shards = block_count(total, total * dim, max([1, *(math.ceil(n / parts) for _, n, parts in sizes)]))
    placed, before = [], 0.0
    for list_id, n, parts in sizes:
        for part in range(parts):
            placed.append((list_id, part, int(before * shards // total)))
            before += n / parts
    placed = [(i, part, min(shard, shards - 1)) for i, part, shard in placed]
    n_q = found.count()
    blocks = block_count(n_q, n_q * dim, query_rows)
    most = np.int64(max([0, *(i for i, _, _ in placed)]) + 1)
    pairs = np.unique(np.array([i * shards + s for i, _, s in placed], np.int64))
    bc = spark.sparkContext.broadcast((pairs // shards, pairs % shards))

    def probed(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"list_id": np.unique(np.concatenate(pdf["lists"].tolist())).astype(np.int32)})

    def deal(batches):
        of, shard = bc.value
        for batch in batches:
            for a in range(0, len(batch), 512):
                pdf = batch.iloc[a:a + 512]
                n = np.array([len(x) for x in pdf["lists"]], np.int64)
                lists, row = np.concatenate(pdf["lists"].tolist()).astype(np.int64), np.repeat(np.arange(len(pdf)), n)
                low, high = np.searchsorted(of, lists, "left"), np.searchsorted(of, lists, "right")
                each = high - low  # a list in parts can be in several shards
                at = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
                key = (np.repeat(row, each) * shards + shard[at]) * most + of[at]
                key = np.sort(key)
                group = key // most
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(key) else np.zeros(0, np.int64)
                to, lists = group[first], np.split((key % most).astype(np.int32), first[1:])
                yield pd.DataFrame({"__qid": pdf["__qid"].to_numpy()[to // shards], "__qv": pdf["__qv"].to_numpy()[to // shards],
                                    "shard": (to % shards).astype(np.int32), "lists": lists if len(to) else []})

    met = found.select("lists").mapInPandas(probed, "list_id int").distinct()
    left = (found.mapInPandas(deal, "__qid long, __qv array<double>, shard int, lists array<int>")
            .withColumn("block", F.pmod(F.xxhash64("__qid"), F.lit(blocks)).cast("int")))
    at = spark.createDataFrame(placed, "list_id int, part int, shard int")
    # the comparison marks the probed lists as a selection, which is what lets them prune partitions
    right = (spark.read.parquet(f"{path}/vectors").join(F.broadcast(met.filter("list_id >= 0")), "list_id")
             .join(F.broadcast(at), ["list_id", "part"])
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("shard", "block", "list_id", "id", "vector"))

    def score(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"__qid": [], "__cid": [], "score": []})
        qids = qpdf["__qid"].to_numpy(dtype=np.int64)
        top = TopK(_stack(qpdf["__qv"], dim), "dot", k)  # unit vectors
        asked = np.concatenate(qpdf["lists"].tolist())
        row = np.repeat(np.arange(len(qpdf)), [len(x) for x in qpdf["lists"]])
        order = np.argsort(asked, kind="stable")
        asked, row = asked[order], row[order]
        for list_id, part in cpdf.groupby("list_id"):
            a, b = np.searchsorted(asked, [list_id, list_id + 1])
            if b > a:
                top.add(_stack(part["vector"], dim), part["id"].to_numpy(dtype=np.int64), row[a:b])
        qi, cid, sc = top.found()
        return pd.DataFrame({"__qid": qids[qi], "__cid": cid, "score": sc})

    tasks = max(1, min(shards * blocks, 1024))
    keys = ["shard", "block"]
    partial = (left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))
               .applyInPandas(score, _HITS))
    return _best_of(partial, k, query_id)


_HITS = T.StructType([T.StructField("__qid", T.LongType()), T.StructField("__cid", T.LongType()),
                      T.StructField("score", T.DoubleType())])


def _top_of_groups(left: DataFrame, right: DataFrame, keys: list[str], k: int, query_id: str) -> DataFrame:
    def score(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"__qid": [], "__cid": [], "score": []})
        qids = qpdf["__qid"].to_numpy(dtype=np.int64)
        dim = len(qpdf["__qv"].iloc[0])
        qm, cm = _stack(qpdf["__qv"], dim), _stack(cpdf["vector"], dim)
        qi, cid, sc = _score_chunked(cm, cpdf["id"].to_numpy(dtype=np.int64), qm, "dot", k, None, None)  # unit vectors
        return pd.DataFrame({"__qid": qids[qi], "__cid": cid, "score": sc})

    return _best_of(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, _HITS), k, query_id)


def _best_of(partial: DataFrame, k: int, query_id: str) -> DataFrame:
    w = Window.partitionBy("__qid").orderBy(F.col("score").desc(), F.col("__cid").asc())
    out = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("__qid").alias(query_id), F.col("__cid").alias("id"), "score", "rank")


def recall_rows(approx: DataFrame, exact: DataFrame, query_id: str = "qid") -> DataFrame:
    """Recall as data: per query of the exact result, how many hits it ``wanted`` and how many of
    them the approximate one ``found``."""
    hit = approx.select(query_id, "id", F.lit(1).alias("__hit"))
    return (exact.select(query_id, "id").join(hit, [query_id, "id"], "left").groupBy(query_id)
            .agg(F.count(F.lit(1)).alias("wanted"), F.count("__hit").alias("found")))


def ivf_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int = 5, nprobe: int = 10,
               query_id: str = "qid", query_vec: str = "query_vector", block_rows: int = LIST_ROWS) -> DataFrame:
    """Approximate cosine top-k per query against an index that is a table of rows (see
    :func:`ivf_build`); output (qid, id, score, rank)."""
    q = queries.select(F.col(query_id).cast("long").alias("__qid"), _unit(query_vec).alias("__qv"))
    probes = _nearest_lists(q, "__qv", _centroid_matrix(centroids), nprobe)
    sizes = index.groupBy("list_id").count().agg(F.max("count")).first()[0] or 0
    subs = max(1, math.ceil(sizes / block_rows))
    idx = index.withColumn("sub", F.pmod(F.xxhash64("id"), F.lit(subs)))
    probes = probes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1)).cast("array<long>")))
    return _top_of_groups(probes, idx, ["list_id", "sub"], k, query_id)


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str = "qid") -> DataFrame:
    """Fraction of exact top-k ids that the approximate search also returned (one row)."""
    hit = exact.join(approx.select(query_id, "id"), [query_id, "id"], "left_semi")
    total = exact.select(F.count(F.lit(1))).scalar()
    return hit.agg((F.count(F.lit(1)) / total).alias("recall"))


def ivf_write(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the IVF index partitioned by list, so a probe reads only the probed lists."""
    index.write.mode(mode).partitionBy("list_id").parquet(path)


def ivf_search_one(spark: SparkSession, query, index_path: str, centroids: DataFrame, k: int = 5, nprobe: int = 10) -> DataFrame:
    """Approximate cosine top-k for one query vector against a stored index: the nprobe nearest
    centroids are picked on the driver (the centroid table is bounded by the list count), and
    the scan of ``index_path`` is pruned to those list partitions before any vector is read."""
    from .vectors import cosine_topk

    ids, cmat = _centroid_matrix(centroids)
    q = np.asarray(list(query), dtype=np.float64)
    qn = q / (np.linalg.norm(q) or 1.0)
    order = np.argsort(-(cmat @ qn), kind="stable")[:min(nprobe, len(ids))]
    probed = [int(ids[i]) for i in order]
    part = spark.read.parquet(index_path).filter(F.col("list_id").isin(probed))
    return cosine_topk(part.withColumnRenamed("vector", "embedding"), qn.tolist(), k=k)

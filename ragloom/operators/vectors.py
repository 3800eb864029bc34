"""Exact vector search: scorers (V2, V9), single-query top-k (V1, V3), batch top-k (V4, V5),
vector checks (V7) and seeded linear projection (V8).

Two execution forms:

* expression form – higher-order array functions (``zip_with`` / ``aggregate``), exact,
  JVM-only; used for one query against a corpus (a scan + TakeOrderedAndProject).
* block form – Arrow batches scored with a numpy matrix product inside ``mapInPandas``
  while each task keeps a running top-k per query, so only ``k`` candidates per
  query and task reach the shuffle. The query side is broadcast only after its
  size was checked; beyond the bound both sides are cut into hash blocks and
  scored pairwise with ``cogroup().applyInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_parallelism

# pgvector-compatible fallback epsilon of the zero-safe cosine
COSINE_EPS = 1e-9


def _vec(v) -> Column:
    """A vector given as a column name, a Column, a Python sequence or a numpy array."""
    if isinstance(v, str):
        return F.col(v).cast("array<double>")
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


# ------------------------------------------------------------------ scorers (V9)
def dot(a, b) -> Column:
    """Inner product of two array columns (null when sizes differ)."""
    a, b = _vec(a), _vec(b)
    prods = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x))


def squared_l2(a, b) -> Column:
    a, b = _vec(a), _vec(b)
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a) -> Column:
    a = _vec(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a, b, eps: float = 0.0) -> Column:
    """1 - cosine distance. ``eps=0``: zero vector scores 0.0; ``eps>0``: V2's dot/(|a||b|+eps)."""
    denom = norm(a) * norm(b)
    if eps > 0:
        return dot(a, b) / (denom + F.lit(eps))
    return F.when(denom == 0, F.lit(0.0)).otherwise(dot(a, b) / denom)


def unit_query(spark, query):
    """The query vector scaled to unit length, computed once: on the driver for a literal
    vector, inside one scalar subquery for a Column (itself e.g. a scalar subquery)."""
    if isinstance(query, Column):
        v = F.col("q")
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return (spark.range(1).select(query.cast("array<double>").alias("q"))
                .select(F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)).scalar())
    arr = np.asarray(list(query), dtype=np.float64)
    nrm = np.linalg.norm(arr)
    return (arr / nrm if nrm > 0 else arr).tolist()


def cosine_to_unit(e, q_unit) -> Column:
    """Cosine similarity against an already normalised query: dot(e, q) / |e|, zero vector -> 0.0."""
    n = norm(e)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(e, q_unit) / n)


def bind_query(df: DataFrame, query, name: str = "__q"):
    """Materialise a Column query vector (e.g. a scalar subquery) as a column, since
    subqueries may not appear inside higher-order functions. Returns (df, vector)."""
    if isinstance(query, Column):
        return df.withColumn(name, query.cast("array<double>")), F.col(name)
    return df, query


# ------------------------------------------------------------------ pre-filter
def filter_model(corpus: DataFrame, model_type: str | None = None, embedding_type: str | None = None) -> DataFrame:
    """Equality pre-filter of vector search; both predicates reach the parquet scan."""
    if model_type is not None:
        corpus = corpus.filter(F.col("model_type") == model_type)
    if embedding_type is not None:
        corpus = corpus.filter(F.col("embedding_type") == embedding_type)
    return corpus


# ------------------------------------------------------------- single query (V1-V3)
def cosine_topk(corpus: DataFrame, query, k: int = 5, threshold: float = 0.0,
                model_type: str | None = None, embedding_type: str | None = None,
                vector_col: str = "embedding", id_col: str = "id", eps: float = 0.0,
                score_col: str = "similarity_score", method: str = "expr",
                query_is_unit: bool = False, corpus_is_unit: bool = False) -> DataFrame:
    """V1: score = 1 - cosine distance, highest first, ties by id; drop score < threshold
    only when threshold > 0; first k.

    ``method="expr"``: JVM expressions against the query normalised once, planned as
    filter -> project -> TakeOrderedAndProject. ``method="arrow"``: the corpus streams through
    the block scorer (numpy, per-task top-k) and the k hits are joined back to their rows."""
    df = filter_model(corpus, model_type, embedding_type)
    if method == "arrow" and eps == 0:
        spark = corpus.sparkSession
        qv = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
        qdf = spark.range(1).select(F.lit(0).cast("long").alias("qid"), qv.cast("array<double>").alias("query_vector"))
        hits = batch_topk(qdf, df, k=k, threshold=threshold if threshold > 0 else None, metric="cosine",
                          id_col=id_col, vector_col=vector_col)
        hits = hits.select(F.col(id_col), F.col("score").alias(score_col))
        return df.join(F.broadcast(hits), id_col).orderBy(F.col(score_col).desc(), F.col(id_col).asc())
    if eps > 0:
        df, q = bind_query(df, query)
        score = cosine_similarity(F.col(vector_col), q, eps)
    else:
        df, q = bind_query(df, query if query_is_unit else unit_query(corpus.sparkSession, query))
        score = dot(F.col(vector_col), q) if corpus_is_unit else cosine_to_unit(F.col(vector_col), q)
    scored = df.withColumn(score_col, score)
    # a vector of another size, or with a null or NaN component, has no score and is no hit
    scored = scored.filter(F.col(score_col).isNotNull() & ~F.isnan(score_col))
    if threshold > 0:
        scored = scored.filter(F.col(score_col) >= threshold)
    return scored.orderBy(F.col(score_col).desc(), F.col(id_col).asc()).limit(k).drop("__q")


def prepare_corpus(corpus: DataFrame, vector_col: str = "embedding", persist: bool = True) -> DataFrame:
    """Normalise every vector to unit length once (zero vectors stay zero), for repeated cosine
    searches with ``corpus_is_unit=True``; optionally persisted (memory, spilling to disk)."""
    v = F.col(vector_col).cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    out = corpus.withColumn(vector_col, F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    if persist:
        from pyspark import StorageLevel
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    return out


def zero_safe_cosine_topk(corpus: DataFrame, query, k: int = 5, threshold: float = 0.0, **kw) -> DataFrame:
    """V2: the fallback scorer dot/(|q||e|+1e-9) over the whole corpus (no 500-row cap)."""
    return cosine_topk(corpus, query, k=k, threshold=threshold, eps=COSINE_EPS, **kw)


def l2_topk(corpus: DataFrame, query, k: int = 5, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """V3: flat L2 search; ``distance`` is the squared L2 (as an L2 flat index reports it),
    similarity = 1 / (1 + distance); nearest first, ties by id."""
    corpus, q = bind_query(corpus, query)
    d = squared_l2(F.col(vector_col), q)
    return (corpus.withColumn("distance", d)
            .filter(F.col("distance").isNotNull() & ~F.isnan("distance"))
            .withColumn("similarity_score", 1.0 / (1.0 + F.col("distance")))
            .orderBy(F.col("distance").asc(), F.col(id_col).asc())
            .limit(k).drop("__q"))


# ----------------------------------------------------------------- vector checks (V7)
def check_vectors(df: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """V7: flag null, wrong-dimension, NaN and zero vectors; ``valid`` when none applies."""
    v = F.col(vector_col)
    problems = F.array_compact(F.array(
        F.when(v.isNull(), F.lit("null")),
        F.when(v.isNotNull() & (F.size(v) != dim), F.lit("dimension")),
        F.when(F.exists(v, lambda x: F.isnan(x) | x.isNull()), F.lit("nan")),
        F.when(v.isNotNull() & F.forall(v, lambda x: x == 0), F.lit("zero")),
    ))
    return df.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)


# ----------------------------------------------------------- block scorer (V4, V5)
def _normalize_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0  # a zero vector stays zero and scores 0.0
    return m / n


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


SCORE_MATRIX_BYTES = 4 << 20  # bound of one queries x corpus-chunk score matrix in a Python worker
QUERY_ROWS, FIRST_ROWS = 512, 512  # queries scored together; corpus rows of the first chunk, which sets a floor
RESCORED = 1 << 16  # pairs whose vectors are gathered at once


class TopK:
    """The k best corpus rows of each query of a block (larger score first, ties to the smaller id), kept as
    matrices of queries x k.

    A matrix product bounds the scores; the pairs that can be among a query's k best by it, a rounding error
    allowed, get their score from their two vectors alone, so equal vectors score the same wherever they stand."""

    def __init__(self, qmat: np.ndarray, metric: str, k: int, floor: float | None = None):
        self.q, self.metric, self.k = _normalize_rows(qmat) if metric == "cosine" else qmat, metric, k
        self.floor = -np.inf if floor is None else floor
        self.scores = np.full((len(qmat), k), -np.inf)
        self.ids = np.full((len(qmat), k), np.iinfo(np.int64).max)
        self.size = np.sqrt((self.q * self.q).sum(1))

    def add(self, cmat: np.ndarray, cids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """Corpus rows that meet all queries, or those at the given places."""
        order = np.argsort(cids, kind="stable")  # of equal scores those that come later are seldom wanted
        c, cids = cmat[order], cids[order]
        c = _normalize_rows(c) if self.metric == "cosine" else c
        queries = np.arange(len(self.q)) if queries is None else queries
        for a in range(0, len(queries), QUERY_ROWS):
            at = queries[a:a + QUERY_ROWS]
            most = max(1, SCORE_MATRIX_BYTES // (8 * len(at)))
            start, q = 0, self.q[at]
            while start < len(c):
                end = start + (min(most, FIRST_ROWS) if start == 0 else most)
                self._fold(at, q, c[start:end], cids[start:end])
                start = end

    def _fold(self, at: np.ndarray, q: np.ndarray, c: np.ndarray, cids: np.ndarray) -> None:
        s = q @ c.T
        largest = np.sqrt((c * c).sum(1)).max()
        scale = self.size[at] * largest
        if self.metric == "l2":
            s = 2.0 * s - (c * c).sum(1)[None, :] - (q * q).sum(1)[:, None]
            scale = (self.size[at] + largest) ** 2
        slack = 8 * (q.shape[1] + 2) * np.finfo(np.float64).eps * scale
        worst = np.maximum(self.scores[at, -1], self.floor)
        free = np.flatnonzero(worst == -np.inf)
        if len(free) and s.shape[1] > self.k:  # nothing to compare with yet: the k-th of this chunk
            some = np.where(np.isfinite(s[free]), s[free], -np.inf)
            worst[free] = np.partition(some, s.shape[1] - self.k, axis=1)[:, -self.k]
        i, j = np.divmod(np.flatnonzero(s >= (worst - slack)[:, None]), s.shape[1])
        for x in range(0, len(i), RESCORED):
            self._take(at, q, c, cids, i[x:x + RESCORED], j[x:x + RESCORED])

    def _take(self, at, q, c, cids, i, j) -> None:
        if self.metric == "l2":
            gap = q[i] - c[j]
            s = -np.einsum("ij,ij->i", gap, gap)
        else:
            s = np.einsum("ij,ij->i", q[i], c[j])
        ids, last = cids[j], at[i]
        last_score, last_id = self.scores[last, -1], self.ids[last, -1]
        keep = np.isfinite(s) & (s >= self.floor) & ((s > last_score) | ((s == last_score) & (ids < last_id)))
        if not keep.any():
            return
        s, ids, of = s[keep], ids[keep], last[keep]
        rows = np.unique(of)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.searchsorted(rows, of)])
        s, ids = np.concatenate([self.scores[rows].ravel(), s]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((ids, -s, of))
        n = np.bincount(of, minlength=len(rows))
        best = order[(np.cumsum(n) - n)[:, None] + np.arange(self.k)]
        self.scores[rows], self.ids[rows] = s[best], ids[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), by query."""
        qi, rank = np.nonzero(self.scores > -np.inf)
        return qi, self.ids[qi, rank], self.scores[qi, rank]


def _score_chunked(cmat: np.ndarray, cids: np.ndarray, qmat: np.ndarray, metric: str, k: int,
                   floor: float | None, best):
    """(query, id, score) of the k best of these corpus rows and of ``best``, an earlier result."""
    top = TopK(qmat, metric, k, floor)
    if best is not None:
        n = np.bincount(best[0], minlength=len(qmat))
        place = np.arange(len(best[0])) - np.repeat(np.cumsum(n) - n, n)
        top.ids[best[0], place], top.scores[best[0], place] = best[1], best[2]
    top.add(cmat, cids)
    return top.found()


def block_topk_schema(query_id: str, id_col: str) -> T.StructType:
    return T.StructType([T.StructField(query_id, T.LongType()), T.StructField(id_col, T.LongType()),
                         T.StructField("score", T.DoubleType())])


def _scorable(col: str) -> Column:
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True))


def _narrow(df: DataFrame, col: str) -> Column:
    """A vector column for scoring: floats stay floats until they are scored in double precision."""
    kind = df.schema[col].dataType
    kept = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(col) if kept else F.col(col).cast("array<double>")


def batch_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "cosine",
               threshold: float | None = None, query_id: str = "qid", query_vec: str = "query_vector",
               id_col: str = "id", vector_col: str = "embedding",
               max_broadcast_bytes: int = 64 << 20, block_rows: int = 20_000) -> DataFrame:
    """V5: top-k corpus rows per query, exact.

    Output: (query_id, id_col, score, rank). ``score`` is the cosine similarity, the
    inner product, or for ``metric="l2"`` the squared L2 distance (smaller is better).
    ``threshold`` keeps cosine/dot scores >= threshold, or l2 distances <= threshold.

    Each query is scored against the corpus vectors of its own size; both sides may hold several sizes.

    Plan: if the query side is provably small (its components x 8 bytes under
    ``max_broadcast_bytes``) its matrix is broadcast and every corpus task streams its
    Arrow batches through a matrix product, keeping a running top-k per query; the
    corpus is never shuffled. Otherwise both sides are hash-blocked, in blocks of
    ``block_rows`` or more (:func:`block_count`), and every (query block, corpus block)
    pair is scored apart. Either way at most
    k rows per query per task are shuffled to the final ``row_number() <= k``.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("__qid"),
                       _narrow(queries, query_vec).alias("__qv"))
    c = corpus.select(F.col(id_col).cast("long").alias("__cid"),
                      _narrow(corpus, vector_col).alias("__cv"))
    # vectors that are null, empty, or hold a null or non-finite component cannot be scored (V7 flags them)
    q, c = q.filter(_scorable("__qv")), c.filter(_scorable("__cv"))
    stats = q.agg(F.count("*").alias("n"), F.sum(F.size("__qv").cast("long")).alias("cells")).first()
    n_q = int(stats["n"])
    floor = None
    if threshold is not None:
        floor = -float(threshold) if metric == "l2" else float(threshold)
    schema = block_topk_schema("__qid", "__cid")

    if n_q == 0:
        partial = spark.createDataFrame([], schema)
    elif int(stats["cells"]) * 8 <= max_broadcast_bytes:
        partial = _broadcast_topk(q, c, k, metric, floor, schema)
    else:
        partial = _blocked_topk(q, c, k, metric, floor, n_q, int(stats["cells"]), block_rows, schema)

    asc = metric == "l2"
    order = F.col("score").asc() if asc else F.col("score").desc()
    w = Window.partitionBy("__qid").orderBy(order, F.col("__cid").asc())
    out = (partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    return out.select(F.col("__qid").alias(query_id), F.col("__cid").alias(id_col), "score", "rank")


def _finish_scores(metric, scores):
    return -scores if metric == "l2" else scores


def _broadcast_topk(q, c, k, metric, floor, schema):
    spark = c.sparkSession
    tbl = q.toArrow()  # bounded by the size check in batch_topk
    ids, vecs = tbl.column("__qid").to_pylist(), tbl.column("__qv").to_pylist()
    by_size: dict[int, tuple] = {}
    for dim in {len(v) for v in vecs}:
        at = [i for i, v in enumerate(vecs) if len(v) == dim]
        by_size[dim] = (np.asarray([ids[i] for i in at], dtype=np.int64), np.asarray([vecs[i] for i in at], dtype=np.float64))
    bc = spark.sparkContext.broadcast(by_size)

    def score_partition(batches):
        best: dict[int, TopK] = {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["__cv"].map(len)):
                if dim in bc.value:
                    if dim not in best:
                        best[dim] = TopK(bc.value[dim][1], metric, k, floor)
                    best[dim].add(_stack(part["__cv"], dim), part["__cid"].to_numpy(dtype=np.int64))
        for dim, top in best.items():
            qi, ids_, sc = top.found()
            if len(qi):
                yield pd.DataFrame({"__qid": bc.value[dim][0][qi], "__cid": ids_, "score": _finish_scores(metric, sc)})

    return ensure_parallelism(c).mapInPandas(score_partition, schema)


SIDE_BLOCKS = 16  # blocks that a side is cut into while they fit BLOCK_BYTES; a row is sent to every block of the other side
BLOCK_BYTES = 32 << 20  # of a block's vectors


def block_count(n: int, cells: int, least_rows: int) -> int:
    """Blocks of ``n`` vectors with ``cells`` components in all: ``SIDE_BLOCKS`` of them, fewer where these would
    have under ``least_rows``, more where one would have over ``BLOCK_BYTES``."""
    return max(1, min(math.ceil(n / least_rows), max(SIDE_BLOCKS, math.ceil(cells * 8 / BLOCK_BYTES))))


def _blocked_topk(q, c, k, metric, floor, n_q, cells_q, block_rows, schema):
    found = c.agg(F.count("*").alias("n"), F.sum(F.size("__cv").cast("long")).alias("cells")).first()
    qb, cb = block_count(n_q, cells_q, block_rows), block_count(found["n"], found["cells"] or 0, block_rows)
    q, c = q.withColumn("dim", F.size("__qv")), c.withColumn("dim", F.size("__cv"))
    qx = (q.withColumn("qb", F.pmod(F.xxhash64("__qid"), F.lit(qb)))
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)).cast("array<long>"))))
    cx = (c.withColumn("cb", F.pmod(F.xxhash64("__cid"), F.lit(cb)))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<long>"))))

    def score_block(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"__qid": [], "__cid": [], "score": []})
        dim = len(qpdf["__qv"].iloc[0])
        qids = qpdf["__qid"].to_numpy(dtype=np.int64)
        top = TopK(_stack(qpdf["__qv"], dim), metric, k, floor)
        top.add(_stack(cpdf["__cv"], dim), cpdf["__cid"].to_numpy(dtype=np.int64))
        qi, ids, sc = top.found()
        return pd.DataFrame({"__qid": qids[qi], "__cid": ids, "score": _finish_scores(metric, sc)})

    # a pair of blocks is much work for few bytes, so small partitions are not joined into one task
    keys = ["dim", "qb", "cb"]
    tasks = max(1, min(qb * cb, 1024))
    return (qx.repartition(tasks, *keys).groupBy(*keys).cogroup(cx.repartition(tasks, *keys).groupBy(*keys))
            .applyInPandas(score_block, schema))


def retrieve(queries: DataFrame, corpus: DataFrame, n: int = 3, threshold: float = 0.1, **kw) -> DataFrame:
    """V4: L2 top-n per query, then keep similarity 1/(1+d) >= threshold."""
    hits = batch_topk(queries, corpus, k=n, metric="l2", **kw)
    hits = hits.withColumn("similarity_score", 1.0 / (1.0 + F.col("score")))
    return hits.filter(F.col("similarity_score") >= threshold)


# -------------------------------------------------------------- projection (V8)
def projection_matrix(in_dim: int, out_dim: int, seed: int = 42) -> np.ndarray:
    """One seeded Gaussian matrix, so that projected vectors stay comparable across calls."""
    return np.random.default_rng(seed).standard_normal((in_dim, out_dim))


def project_vectors(df: DataFrame, out_dim: int, in_dim: int, seed: int = 42,
                    vector_col: str = "embedding", out_col: str = "projected") -> DataFrame:
    """V8: linear map in_dim -> out_dim with one broadcast matrix, Arrow batches through numpy."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(projection_matrix(in_dim, out_dim, seed))
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def project(batches):
        m = bc.value
        for pdf in batches:
            ok = pdf[vector_col].map(lambda v: v is not None and len(v) == in_dim)
            res = pd.Series([None] * len(pdf), dtype=object, index=pdf.index)
            if ok.any():
                mat = _stack(pdf.loc[ok, vector_col], in_dim) @ m
                res.loc[ok] = list(mat)
            pdf[out_col] = res
            yield pdf

    return df.mapInPandas(project, out_schema)

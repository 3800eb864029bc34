"""Text encoders. An encoder turns a text column into a fixed-width vector column.

The default is deterministic feature hashing (no model weights are available offline):
tokens are cut and hashed by JVM expressions, and one Arrow-batched pandas UDF turns the
bucket ids of a whole batch into L2-normalised count vectors with a single bincount.
A real model plugs in through :class:`PandasModelEncoder`, whose model is loaded once per
Python worker and fed whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_parallelism

TOKEN_SPLIT = "[^\\p{L}\\p{N}]+"
BATCH_TOKENS = 1 << 20
UNKNOWN_BYTES = 1 << 50  # estimates from here on say that the planner does not know
COUNT_BYTES = 8 << 20  # of the input, by the planner's estimate, whose counts a task holds


class HashingEncoder:
    """Signed feature hashing of lower-cased word tokens into ``dim`` buckets, L2-normalised.

    ``hash_fn="xxhash64"`` (default, fastest) or ``"md5"`` (bucket from the first 8 hex digits,
    sign from the 9th; reproducible outside Spark, e.g. in SQL)."""

    def __init__(self, dim: int = 384, seed: int = 42, hash_fn: str = "xxhash64"):
        if hash_fn not in ("xxhash64", "md5"):
            raise ValueError(hash_fn)
        self.dim = dim
        self.seed = seed
        self.hash_fn = hash_fn

    def tokens(self, text: Column) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")

    def _code(self, t: Column) -> Column:
        """bucket * 2 + sign bit of one token (sign bit 1 = negative)."""
        dim = self.dim
        if self.hash_fn == "md5":
            h = F.md5(t)
            bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
            sign = F.pmod(F.conv(F.substring(h, 9, 1), 16, 10).cast("int"), F.lit(2))
            return bucket * 2 + sign
        return F.pmod(F.xxhash64(t, F.lit(self.seed)), F.lit(dim)) * 2 + F.pmod(F.hash(t), F.lit(2))

    def bucket_ids(self, text: Column) -> Column:
        """Per token: bucket * 2 + sign bit, computed in the JVM."""
        return F.transform(self.tokens(text), lambda t: self._code(t))

    def signed_counts(self, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
        """The encoder's unnormalised vector in long form (id, bucket, count), nonzero entries only,
        as a Spark job: tokens are exploded and summed per (id, bucket) with a partial aggregation, in
        tasks of about ``COUNT_BYTES``, since a text leaves up to ``dim`` sums."""
        tasks = df.sparkSession.sparkContext.defaultParallelism
        if not df.isStreaming:
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            tasks = max(tasks, ceil(size / COUNT_BYTES) if size < UNKNOWN_BYTES else 0)
        df = ensure_parallelism(df.select(id_col, text_col), tasks)
        codes = df.select(id_col, F.explode(self.bucket_ids(F.col(text_col))).alias("__c"))
        signed = codes.select(id_col, (F.col("__c") / 2).cast("int").alias("bucket"),
                              F.when(F.col("__c") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("__s"))
        return (signed.groupBy(id_col, "bucket").agg(F.sum("__s").alias("count"))
                .filter(F.col("count") != 0))

    def vector(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def to_vectors(codes: pd.Series) -> pd.Series:
            n = len(codes)
            out = np.zeros((n, dim), dtype=np.float32)
            lens = np.fromiter((0 if c is None else len(c) for c in codes), dtype=np.int64, count=n)
            upto, a = np.cumsum(lens), 0
            while a < n:  # texts of about BATCH_TOKENS tokens at a time
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BATCH_TOKENS, "right")))
                b = min(b, a + BATCH_TOKENS // dim + 1)
                if lens[a:b].any():
                    flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in codes.iloc[a:b] if c is not None and len(c)])
                    rows = np.repeat(np.arange(b - a), lens[a:b])
                    weights = np.where(flat % 2 == 0, 1.0, -1.0)
                    mat = np.bincount(rows * dim + flat // 2, weights=weights, minlength=(b - a) * dim).reshape(b - a, dim)
                    norms = np.linalg.norm(mat, axis=1, keepdims=True)
                    norms[norms == 0] = 1.0
                    out[a:b] = mat / norms
                a = b
            return pd.Series(list(out))

        return to_vectors(self.bucket_ids(text).cast("array<int>"))

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return ensure_parallelism(df).withColumn(out_col, self.vector(F.col(text_col)))


class PandasModelEncoder:
    """Plug-in for a real model: ``loader()`` returns an object with ``encode(list[str]) -> ndarray``.
    The model is created once per Python worker process and reused for every batch."""

    _models: dict = {}

    def __init__(self, loader: Callable[[], object], dim: int, name: str = "model"):
        self.loader, self.dim, self.name = loader, dim, name

    def vector(self, text: Column) -> Column:
        loader, name = self.loader, self.name

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(texts: pd.Series) -> pd.Series:
            model = PandasModelEncoder._models.get(name)
            if model is None:
                model = PandasModelEncoder._models[name] = loader()
            out = np.asarray(model.encode(texts.fillna("").tolist()), dtype=np.float32)
            return pd.Series(list(out))

        return encode(text)

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return ensure_parallelism(df).withColumn(out_col, self.vector(F.col(text_col)))


def embed_text(df: DataFrame, text_col: str, encoder=None, out_col: str = "embedding") -> DataFrame:
    """Add an embedding column computed from ``text_col`` by ``encoder`` (default: hashing, 384 dims)."""
    return (encoder or HashingEncoder()).transform(df, text_col, out_col)

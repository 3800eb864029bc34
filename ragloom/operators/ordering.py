"""Sorts, limits and top-k (O1-O4). A sort followed by a limit is planned as
TakeOrderedAndProject: every task keeps its own top rows, so nothing is sorted globally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paginate(df: DataFrame, limit: int, offset: int = 0, order_col: str = "id") -> DataFrame:
    """O1: one page in ``order_col`` order (the reference had no order; we fix one)."""
    return df.orderBy(F.col(order_col).asc()).offset(offset).limit(limit)


def paginate_after(df: DataFrame, last_key, limit: int, order_col: str = "id") -> DataFrame:
    """O1 for deep pages: keyset pagination (a pushed-down range filter instead of an offset)."""
    return df.filter(F.col(order_col) > last_key).orderBy(F.col(order_col).asc()).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """O1 page block: total, pages = ceil(total / limit), page = offset // limit + 1,
    has_next, has_prev – one row."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        "total",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("pages"),
        F.lit(offset // limit + 1).alias("page"),
        (F.lit(offset + limit) < F.col("total")).alias("has_next"),
        F.lit(offset > 0).alias("has_prev"),
    )


def recent(df: DataFrame, limit: int = 100, ts_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """O2: newest first (ties by id, newest id first)."""
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(limit)


def top_n(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """O3: the n largest ``by`` (ties by ``tie`` ascending)."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def head_n(df: DataFrame, n: int | None, order_col: str = "id") -> DataFrame:
    """The first n rows in a stable order (None = all)."""
    return df if n is None else df.orderBy(F.col(order_col).asc()).limit(n)


def top_models(usage: DataFrame, n: int = 5) -> DataFrame:
    """O3: the n most used models of a usage table (A6 or A7 output), ties by name."""
    return top_n(usage, n, "usage_count", "model_name")

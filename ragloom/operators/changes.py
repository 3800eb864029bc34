"""Set operations and table changes.

Plain parquet has no MERGE, so a change produces the new version of a table as a
DataFrame; the sink writes it to a new location (never over the path being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import as_of_col, cutoff


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the one with the smallest ``order_col``. A hash aggregate with a
    partial (map-side) min_by, so a hot key is reduced before the shuffle."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("__r"))
    return agg.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def insert_unique(target: DataFrame, new: DataFrame, key: str, order_col: str | None = None):
    """Of the rows of ``new`` whose key is not in ``target``, the first of each key by
    ``order_col``; ties, and rows without an order column, go by all columns in their order.

    Returns ``(to_insert, rejected)``; ``rejected`` carries a ``reason`` column ('exists' or
    'duplicate') and every other row of ``new``, as often as it is there. Equal rows are counted with a
    map-side phase, so a hot key is reduced before the shuffle. A null key exists nowhere. Maps,
    which can be neither grouped nor ordered, take part as their sorted entries."""
    cols = new.columns
    maps = [f.name for f in new.schema.fields if isinstance(f.dataType, T.MapType)]
    if maps:
        flat = new.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps})
        return tuple(out.withColumns({c: F.map_from_entries(c) for c in maps}).select(*out.columns)
                     for out in insert_unique(target, flat, key, order_col))
    row = F.struct(*[F.col(c) for c in cols])
    counted = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    order = F.struct(F.col(order_col or cols[0]), row)
    firsts = counted.groupBy(F.col(key).alias("__key")).agg(F.min(order)["col2"].alias("__first"))
    existing = target.select(F.col(key).alias("__there")).distinct()
    named = firsts.select("__key", F.col("__first"))
    to_insert = named.join(existing, F.col("__key") == F.col("__there"), "left_anti").select("__first.*")
    exists = named.join(existing, F.col("__key") == F.col("__there"), "left_semi").select("__first.*") \
        .withColumn("reason", F.lit("exists"))
    others = counted.join(firsts, F.col(key).eqNullSafe(F.col("__key"))) \
        .withColumn("__n", F.col("__n") - F.when(row.eqNullSafe(F.col("__first")), 1).otherwise(0)).filter("__n > 0") \
        .withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return to_insert, exists.unionByName(others.select(*cols).withColumn("reason", F.lit("duplicate")))


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the given ids (no cascade to other tables)."""
    return df.join(ids.select(key), key, "left_anti")


def deleted_found(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """D2 report: each requested id with ``found`` = whether it existed."""
    hit = df.select(key).distinct().withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(hit, key, "left").fillna({"found": False})


def retain_since(df: DataFrame, amount: int, unit: str = "days", as_of=None, ts_col: str = "created_at") -> DataFrame:
    """D3: drop rows older than as_of - interval; rows exactly at the cutoff are kept."""
    return df.filter(F.col(ts_col) >= cutoff(as_of, amount, unit))


def removed_before(df: DataFrame, amount: int, unit: str = "days", as_of=None, ts_col: str = "created_at") -> DataFrame:
    """D3 report: the rows that retention removes."""
    return df.filter(F.col(ts_col) < cutoff(as_of, amount, unit))


def expire_ttl(df: DataFrame, as_of=None, expires_col: str = "expires_at") -> DataFrame:
    """Drop rows with as_of > expires_at (strict); a null expiry never expires."""
    e = F.col(expires_col)
    return df.filter(e.isNull() | ~(as_of_col(as_of) > e))


def clear_by_type(df: DataFrame, model_type: str | None = None, type_col: str = "model_type") -> DataFrame:
    """What remains after clearing one type (None clears everything)."""
    if model_type is None:
        return df.limit(0)
    return df.filter(~(F.col(type_col) == model_type) | F.col(type_col).isNull())


def distinct_values(df: DataFrame, col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Distinct values of an array or scalar column, optionally per group, a row each."""
    c = F.col(col)
    is_array = dict(df.dtypes)[col].startswith("array")
    if is_array:
        df = df.select(*(group_cols or []), F.explode(c).alias(col))
    return df.select(*(group_cols or []), col).distinct()

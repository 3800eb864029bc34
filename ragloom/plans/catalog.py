"""Query catalogue: one Spark job per operator of the inventory, run over the whole test
tables, each paired (where SQL can say it) with DuckDB SQL computing the same result.

Conventions shared by both sides: ``as_of`` is the latest timestamp of the table
(never the wall clock), every order is tie-broken by id, doubles are rounded, and
arrays/maps are emitted as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def ts_text(c):
    """Timestamps leave the catalogue as text with microseconds, identical in both engines."""
    from pyspark.sql import functions as F
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def ts_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            # the catalogue's dates and times are defined in UTC, whatever session it runs in
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (q_vectors, q_relational, q_aggregates, q_windows, q_functions,  # noqa: F401
                   q_composed, q_streaming, q_io)

"""Sinks (K1-K5). Writers never overwrite a path that the same job reads: a changed table
is written to a new location (``write_version``) and readers switch to it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prometheus_labels


# ------------------------------------------------------------------------------ K1
def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None,
                compression: str = "snappy") -> None:
    """K1: parquet write (append by default); ids come from the input key, not a global sequence."""
    w = df.write.mode(mode).option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed_table(df: DataFrame, table: str, path: str, buckets: int, cols: list[str],
                         mode: str = "overwrite") -> None:
    """K1 for tables joined again and again on the same key (vectors and images on image id):
    bucketed and sorted by the key, so later joins on it read co-located buckets with no shuffle."""
    (df.write.mode(mode).bucketBy(buckets, *cols).sortBy(*cols).option("path", path)
       .format("parquet").saveAsTable(table))


def write_version(df: DataFrame, table_dir: str, version: str) -> str:
    """Write a changed table (D1/D2/D3 result) as a new version folder and return its path."""
    path = f"{table_dir.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


# ------------------------------------------------------------------------------ K2
def write_annotations_json(df: DataFrame, path: str) -> None:
    """K2: annotation records as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_metadata_csv(df: DataFrame, path: str) -> None:
    """K2: metadata rows as a header CSV."""
    (df.select("image_filename", "description", "tags", "style", "category")
       .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# ------------------------------------------------------------------------------ K3
def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """K3: a long (section, key, metric, value) report as JSON lines or as aligned text lines.
    Reports are small by construction (aggregates), so one output file is written."""
    ordered = report.orderBy("section", "key", "metric").coalesce(1)
    if fmt == "json":
        ordered.write.mode("overwrite").json(path)
    elif fmt == "text":
        ordered.select(F.format_string("%-20s %-30s %-28s %s", "section", "key", "metric", "value").alias("value")) \
            .write.mode("overwrite").text(path)
    else:
        raise ValueError(fmt)


# ------------------------------------------------------------------------------ K4
def prometheus_lines(registry: DataFrame, latest: DataFrame) -> DataFrame:
    """K4: for each registered metric that has samples: '# HELP', '# TYPE' and
    'name{labels} latest_value', in registry order -> (reg_seq, line_no, line)."""
    j = registry.join(latest, "name", "inner")
    lines = F.array(
        F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("description")).alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" "), F.col("type")).alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.concat(F.col("name"), prometheus_labels("latest_labels"), F.lit(" "),
                                                     F.col("latest_value").cast("string")).alias("line")))
    return j.select("reg_seq", F.inline(lines))


def export_prometheus(registry: DataFrame, latest: DataFrame, path: str) -> None:
    prometheus_lines(registry, latest).orderBy("reg_seq", "line_no").select("line").coalesce(1) \
        .write.mode("overwrite").text(path)


# ------------------------------------------------------------------------------ K5
def snapshot_tables(spark: SparkSession, tables: dict[str, DataFrame], backup_dir: str,
                    taken_at: dt.datetime | None = None, compressed: bool = True) -> DataFrame:
    """K5: write each table as gzip (or plain) parquet under ``backup_dir/<stamp>/<name>`` and append
    one manifest row per table (taken_at, name, compressed, path, rows)."""
    taken_at = taken_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stamp = taken_at.strftime("%Y%m%d_%H%M%S")
    rows = []
    for name, df in tables.items():
        path = f"{backup_dir.rstrip('/')}/{stamp}/{name}"
        df.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").parquet(path)
        rows.append((taken_at, name, compressed, path))
    manifest = spark.createDataFrame(rows, "taken_at timestamp, name string, compressed boolean, path string")
    manifest.write.mode("append").parquet(f"{backup_dir.rstrip('/')}/_manifest")
    return manifest


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, backup_dir: str) -> DataFrame:
    """K5: manifest of the snapshots that have not been deleted, newest first."""
    base = backup_dir.rstrip("/")
    rows = spark.read.parquet(f"{base}/_manifest")
    path, fs = _file_system(spark, f"{base}/_deleted")
    if fs.exists(path):
        rows = rows.join(spark.read.parquet(f"{base}/_deleted").select("path"), "path", "left_anti")
    return rows.select("taken_at", "name", "compressed", "path").orderBy(F.col("taken_at").desc(), "name")


def restore_snapshot(spark: SparkSession, backup_dir: str, name: str, taken_at: dt.datetime | None = None) -> DataFrame:
    """K5: read one table back from the newest (or the given) snapshot."""
    m = list_snapshots(spark, backup_dir).filter(F.col("name") == name)
    if taken_at is not None:
        m = m.filter(F.col("taken_at") == F.lit(taken_at))
    row = m.limit(1).first()
    if row is None:
        raise FileNotFoundError(f"no snapshot of {name}")
    return spark.read.parquet(row["path"])


def retain_snapshots(spark: SparkSession, backup_dir: str, days: int = 30, as_of=None) -> DataFrame:
    """K5 + D3: manifest rows younger than ``days`` (older ones are the ones to delete)."""
    from ..operators.changes import retain_since
    return retain_since(list_snapshots(spark, backup_dir), days, "days", as_of, ts_col="taken_at")


def delete_snapshots(spark: SparkSession, backup_dir: str, days: int = 30, as_of=None) -> DataFrame:
    """K5: delete the snapshots older than ``days`` and return their manifest rows. They are first
    marked as deleted, so a reader never lists a folder that is gone; running it again finishes what was cut off."""
    from ..operators.changes import removed_before
    base = backup_dir.rstrip("/")
    gone = removed_before(list_snapshots(spark, base), days, "days", as_of, ts_col="taken_at")
    rows = gone.collect()  # one row per table and snapshot
    marked = spark.createDataFrame(rows, gone.schema)
    if rows:
        marked.write.mode("append").parquet(f"{base}/_deleted")
    path, fs = _file_system(spark, f"{base}/_deleted")
    if fs.exists(path):
        for r in spark.read.parquet(f"{base}/_deleted").select("path").collect():
            path, fs = _file_system(spark, r["path"])
            fs.delete(path, True)
    return marked

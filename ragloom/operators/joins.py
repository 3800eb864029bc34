"""Joins (J1-J8).

Join strategy is left to Catalyst and AQE: a side is hinted for broadcast only when
its size has a static bound (top-k hits of one query); otherwise AQE converts a
sort-merge join into a broadcast join at run time once it has measured the side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import batch_topk


def enrich_hits(hits: DataFrame, images: DataFrame, key: str = "image_id",
                image_key: str = "id", hits_bounded: bool = False) -> DataFrame:
    """Inner equi-join of search hits to image rows; hits without an image are dropped
    after the top-k, so fewer than k rows may come back.

    ``hits_bounded=True`` (hits of a single query, at most k rows) broadcasts the hits.
    """
    right = images.withColumnRenamed(image_key, key) if image_key != key else images
    left = F.broadcast(hits) if hits_bounded else hits
    return left.join(right, key, "inner")


def annotate_categories(annotations: DataFrame, categories: DataFrame,
                        cat_key: str = "category_id") -> DataFrame:
    """Annotations joined to category names (inner)."""
    cats = categories.select(F.col("id").alias(cat_key), F.col("name").alias("category_name"))
    return annotations.join(cats, cat_key, "inner")


def images_with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image kept; images without annotations carry null annotation columns."""
    ann = annotations.withColumnRenamed("image_id", "id")
    return images.join(ann, "id", "left")


def normalize_path(c) -> F.Column:
    """Collapse repeated slashes, drop './' segments and a trailing slash."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, "/+", "/")
    c = F.regexp_replace(c, "(^|/)\\./", "$1")
    return F.regexp_replace(c, "/$", "")


def keep_existing_files(df: DataFrame, files: DataFrame, path_col: str = "image_path",
                        file_path_col: str = "path") -> DataFrame:
    """Keep rows whose file exists in the listing (left semi join on the normalised path)."""
    left = df.withColumn("__p", normalize_path(path_col))
    right = files.select(normalize_path(file_path_col).alias("__p"))
    return left.join(right, "__p", "left_semi").drop("__p")


def zip_by_position(vectors: DataFrame, metadata: DataFrame, pos_col: str = "pos",
                    dim: int | None = None, vector_col: str = "embedding") -> DataFrame:
    """Positional 1:1 join of vectors and metadata saved side by side.

    Rows whose vector is missing, has the wrong dimension, or whose metadata is missing
    are skipped (inner join + check), as the migration skips bad items.
    """
    joined = vectors.join(metadata, pos_col, "inner")
    if dim is not None:
        joined = joined.filter(F.size(vector_col) == dim)
    return joined.filter(F.col(vector_col).isNotNull())


def count_by_position(vectors: DataFrame, metadata: DataFrame, pos_col: str = "pos",
                      dim: int | None = None, vector_col: str = "embedding") -> DataFrame:
    """J5 dry run: one row with the number of good pairs, nothing written."""
    return zip_by_position(vectors, metadata, pos_col, dim, vector_col).agg(F.count("*").alias("migrated"))


def registry_with_latest(registry: DataFrame, latest: DataFrame, name_col: str = "name") -> DataFrame:
    """Every registered metric, with its latest sample when it has one (left join)."""
    return registry.join(latest, name_col, "left")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 5, **kw) -> DataFrame:
    """Query x corpus theta join restricted to the k best pairs per query."""
    return batch_topk(queries, corpus, k=k, **kw)


def unregistered_names(samples: DataFrame, registry: DataFrame, name_col: str = "name") -> DataFrame:
    """Metric names with samples but no registry row (they are auto-registered as gauges)."""
    return samples.select(name_col).distinct().join(registry.select(name_col), name_col, "left_anti")


def missing_names(required: DataFrame, present: DataFrame, name_col: str = "name") -> DataFrame:
    """Required names that are absent."""
    return required.select(name_col).distinct().join(present.select(name_col).distinct(), name_col, "left_anti")

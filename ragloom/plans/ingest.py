"""Dataset ingest as one DAG – metadata source -> existing files -> searchable text ->
embedding -> image and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import HashingEncoder
from ..functions.text import coco_description, metadata_text_coco, metadata_text_csv, split_tags
from ..operators.changes import insert_unique
from ..operators.joins import keep_existing_files


def csv_items(meta: DataFrame, image_dir: str) -> DataFrame:
    """Rows of S1 as dataset items: path, description, tags, style, category and the F6 text."""
    return meta.select(
        F.concat(F.lit(image_dir.rstrip("/") + "/"), F.col("image_filename")).alias("image_path"),
        F.col("description"), split_tags(F.col("tags")).alias("tags"), "style", "category",
        metadata_text_csv("description", "tags", "style", "category").alias("text"))


def coco_items(ann: DataFrame) -> DataFrame:
    """Rows of S2 as dataset items (F12): description = captions joined, tags = captions; the
    searchable text is the COCO form of F6 ('Objects: … | Size: WxH')."""
    return ann.select(F.col("id").alias("item_id"), "image_path",
                      coco_description("captions").alias("description"), F.col("captions").alias("tags"),
                      "width", "height", metadata_text_coco("captions", "width", "height").alias("text"))


def ingest(items: DataFrame, files: DataFrame, existing_images: DataFrame, encoder=None,
           model_type: str = "hashing", model_name: str = "hashing-384"):
    """Keep items whose file exists, embed their text, and return (new_images, new_embeddings,
    rejected). Image ids come from the path (xxhash64), not from a global sequence."""
    enc = encoder or HashingEncoder(dim=384)
    present = keep_existing_files(items, files, "image_path", "path")
    with_id = present.withColumn("id", F.abs(F.xxhash64("image_path")))
    new_images, rejected = insert_unique(existing_images.select("image_path"),
                                         with_id, "image_path")
    emb = enc.transform(new_images.select("id", "text"), "text", "embedding").select(
        F.col("id").alias("image_id"), "embedding", F.lit(model_type).alias("model_type"),
        F.lit(model_name).alias("model_name"), F.lit("text").alias("embedding_type"))
    return new_images.drop("text"), emb, rejected


ingest_dataset = ingest  # X1 under its inventory name

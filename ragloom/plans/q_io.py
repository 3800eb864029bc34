"""Catalogue entries for sources and sinks: data derived from the test tables is written by a
sink into a fresh folder under the shared checkpoint root and read back by the matching
source, so each round trip is checked against SQL over the original tables."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import metadata_text_csv
from ..operators import aggregates as G
from ..operators import joins as J
from ..session import scratch_path
from ..sources import readers as R
from ..sources import sinks as K
from .catalog import register


@register("s1_k2_metadata_csv", """
SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS image_filename,
       md5(concat_ws(' | ', CASE WHEN text <> '' THEN 'Description: ' || text END,
                     'Tags: ' || lang || ',' || source, 'Style: ' || source, 'Category: ' || lang)) AS h
FROM documents""")
def s1_k2_metadata_csv(spark, sf):
    """Documents as metadata rows -> header CSV (K2) -> S1 reader -> F6 text."""
    d = A.read_table(spark, sf, "documents")
    meta = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_filename"),
                    F.col("text").alias("description"), F.concat_ws(",", "lang", "source").alias("tags"),
                    F.col("source").alias("style"), F.col("lang").alias("category"))
    path = scratch_path(spark, "metadata-csv")
    K.write_metadata_csv(meta, path)
    back = R.read_metadata_csv(spark, path)
    return back.select("image_filename",
                       F.md5(metadata_text_csv("description", "tags", "style", "category")).alias("h"))


@register("s2_k2_annotations_json", A.with_views("""
, named AS (SELECT a.image_id, c.name FROM coco_ann a JOIN coco_cat c ON c.id = a.category_id),
per AS (SELECT image_id, list_sort(list_distinct(list(name))) AS cats FROM named GROUP BY image_id)
SELECT i.id, array_to_string(coalesce(p.cats, []), ' ') AS description
FROM coco_images i LEFT JOIN per p ON p.image_id = i.id
WHERE i.split = 'train'""", "coco_images", "coco_ann", "coco_cat"))
def s2_k2_annotations_json(spark, sf):
    """Processed annotations (A1 per image, in train/val folders by order priority) -> JSON
    lines (K2) -> S2 reader keeping the train split -> F12 description."""
    from ..plans.ingest import coco_items
    s = G.summarize_annotations(A.coco_images(spark, sf), A.coco_annotations(spark, sf), A.coco_categories(spark, sf))
    split = F.col("split")
    ann = s.select("id", F.concat(F.lit("coco/"), split, F.lit("/"), F.col("file_name")).alias("image_path"),
                   "file_name", "width", "height", F.col("categories").alias("captions"),
                   F.col("num_objects").cast("int").alias("num_objects"))
    path = scratch_path(spark, "annotations-json")
    K.write_annotations_json(ann, path)
    back = R.read_annotations_json(spark, path, split="train", image_dir="coco", array_file=False)
    return coco_items(back).select(F.col("item_id").alias("id"), "description")


FILE_BYTES = 64 << 20  # of the tables, by the planner's estimate, that go to one JSON document


def _documents(spark, name, tables, lines, marks, close):
    """JSON values (section, id, line) as the arrays of one JSON document in one text file, or, of larger
    tables, of several documents by id hash: a task sorts and writes one. ``marks`` has the line that opens each section, ``close``
    the last; a comma stands before all but the first value of an array."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    files = max(1, ceil(size / FILE_BYTES))
    lines = lines.withColumn("file", F.pmod(F.xxhash64("section", "id"), F.lit(files)).cast("int"))
    first = lines.groupBy("file", "section").agg(F.min("id").alias("first"))  # a row per array
    lines = lines.join(F.broadcast(first), ["file", "section"], "left").select(
        "file", "section", "id", F.concat(F.when(F.col("id") == F.col("first"), F.lit("")).otherwise(F.lit(",")), "line").alias("line"))
    rows = [(f, section, -1, line) for f in range(files) for section, line in [*enumerate(marks), (len(marks), close)]]
    lines = lines.unionByName(spark.createDataFrame(rows, "file int, section int, id long, line string"))
    path = scratch_path(spark, name)
    (lines.repartition(files, "file").sortWithinPartitions("file", "section", "id").select("file", "line")
     .write.partitionBy("file").text(path))
    return path


def _values(rows, value, section):
    """(section, id, line): the values of an array; ``rows`` has ``id``."""
    return rows.select(F.lit(section).alias("section"), F.col("id").cast("long").alias("id"), F.to_json(value).alias("line"))


@register("s2_annotations_array", """
SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0""")
def s2_annotations_array(spark, sf):
    """Documents as the captions of one JSON array in one file, or of several where the table is large (texts with
    quotes, braces and line breaks) -> S2 reader, several tasks a file -> the train split."""
    d = A.read_table(spark, sf, "documents")
    split = F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train")
    rows = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("coco/"), split, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"),
                    F.array("text").alias("captions"), F.lit(1).alias("num_objects"))
    lines = _values(rows, F.struct("id", "image_path", "captions", "num_objects"), 0)
    path = _documents(spark, "annotations-array", [d], lines, ["["], "]")
    back = R.read_annotations_json(spark, path, split="train", image_dir="coco")
    return back.select("id", F.md5(F.col("captions")[0]).alias("h"))


@register("s3_coco_instances", A.with_views("""
SELECT c.name, count(*) AS annotations, count(DISTINCT i.id) AS images, CAST(sum(i.width) AS BIGINT) AS width
FROM coco_ann a JOIN coco_images i ON i.id = a.image_id JOIN coco_cat c ON c.id = a.category_id GROUP BY c.name""",
                                                "coco_images", "coco_ann", "coco_cat"))
def s3_coco_instances(spark, sf):
    """Images, annotations and categories as one instances document in one file, or several where the tables are
    large -> S3 reader -> the three tables joined."""
    lineitem = A.read_table(spark, sf, "lineitem")
    images = _values(A.coco_images(spark, sf), F.struct("id", "file_name", "width", "height"), 0)
    ann = lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                          F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))
    ann = _values(ann, F.struct("id", "image_id", "category_id"), 1)
    cats = _values(A.coco_categories(spark, sf), F.struct("id", "name"), 2)
    tables = [lineitem, *(A.read_table(spark, sf, t) for t in ("orders", "part"))]
    path = _documents(spark, "instances", tables, images.unionByName(ann).unionByName(cats),
                      ['{"info": {"year": 2017}, "images": [', '], "annotations": [', '], "categories": ['], "]}")
    i, a, c = R.read_coco_instances(spark, path)
    j = a.join(i, a["image_id"] == i["id"]).join(c.withColumnRenamed("id", "category_id"), "category_id")
    return j.groupBy("name").agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct(i["id"]).alias("images"),
                                 F.sum("width").alias("width"))


@register("s8_photo_search", """
SELECT format('image_{:03d}.jpg', n) AS image_filename, doc_id, tags, style FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id // 50, coalesce(lang, ''), doc_id) AS n,
         concat_ws(',', lang, source) AS tags, 'page ' || CAST(doc_id // 50 AS VARCHAR) AS style FROM documents) t""")
def s8_photo_search(spark, sf):
    """Documents as search responses (50 ids a category, a term per language, a photo per document) -> S8
    metadata rows, numbered over all photos."""
    d = A.read_table(spark, sf, "documents").withColumn("page", F.expr("doc_id div 50").cast("int"))
    photo = F.struct("doc_id", F.col("doc_id").cast("string").alias("alt"), F.array_compact(F.array("lang", "source")).alias("tags"))
    terms = d.groupBy("page", F.coalesce("lang", F.lit("")).alias("term")).agg(F.sort_array(F.collect_list(photo)).alias("photos"))
    pages = terms.groupBy(F.col("page").alias("category_pos")).agg(F.sort_array(F.collect_list(F.struct("term", "photos"))).alias("terms"))
    pages = pages.withColumn("category", F.concat(F.lit("page "), F.col("category_pos").cast("string")))
    flat = R.flatten_photo_search(pages)
    return flat.select("image_filename", F.col("description").cast("long").alias("doc_id"), "tags", "style")


@register("a16_log_performance_stats", """
SELECT 'op' || CAST(user_id % 5 AS VARCHAR) AS operation, event_type AS component, count(*) AS n,
       round(avg(value), 6) AS avg_duration_ms, max(value) AS max_duration_ms,
       round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 20.48), 6) AS avg_memory_mb
FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def a16_log_performance_stats(spark, sf):
    """Events written as JSON log lines (performance records flagged, errors not) -> S5 reader
    -> A16 grouping."""
    ev = A.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    rec = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.lit("performance").alias("logger"), F.col("props").alias("message"),
        F.concat(F.lit("op"), (F.col("user_id") % 5).cast("string")).alias("operation"),
        F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("performance_metric"),
        F.col("event_type").alias("component"), (k * 20.48).alias("memory_mb"))
    path = scratch_path(spark, "app-log")
    ev.select(F.to_json(rec).alias("value")).write.mode("overwrite").text(path)
    stats = G.log_performance_stats(R.read_structured_logs(spark, path))
    return stats.select("operation", "component", "n", F.round("avg_duration_ms", 6).alias("avg_duration_ms"),
                        "max_duration_ms", F.round("avg_memory_mb", 6).alias("avg_memory_mb"))


@register("s6_list_files")
def s6_list_files(spark, sf):
    """Rows-only: the listing of the table folder (content never read)."""
    return R.list_files(spark, sf, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@register("s7_k1_vector_bundle", """
SELECT e.label, count(*) AS migrated FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
WHERE len(e.embedding) = 64 GROUP BY e.label""")
def s7_k1_vector_bundle(spark, sf):
    """Vectors and metadata saved side by side (K1) -> S7 loader -> J5 positional join."""
    base = scratch_path(spark, "vector-bundle")
    vecs = A.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", "label")
    meta = A.read_table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "source")
    K.write_table(vecs, f"{base}/vectors", mode="overwrite")
    K.write_table(meta, f"{base}/metadata", mode="overwrite")
    v, m = R.load_vector_bundle(spark, f"{base}/vectors", f"{base}/metadata")
    return J.zip_by_position(v, m, dim=64).groupBy("label").agg(F.count(F.lit(1)).alias("migrated"))


@register("k5_snapshot_restore", A.with_views("""
SELECT model_type, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM cache GROUP BY model_type""", "cache"))
def k5_snapshot_restore(spark, sf):
    """Cache table snapshot (gzip parquet + manifest) -> newest snapshot restored."""
    import datetime as dt
    bk = scratch_path(spark, "backups")
    K.snapshot_tables(spark, {"model_cache": A.cache_entries(spark, sf)}, bk, taken_at=dt.datetime(2024, 1, 1))
    back = K.restore_snapshot(spark, bk, "model_cache")
    return back.groupBy("model_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@register("k5_snapshot_retention", A.with_views("""
SELECT '2024-02-0' || CAST(d AS VARCHAR) AS taken_on, (SELECT count(*) FROM cache) AS n FROM (SELECT unnest([1, 9]) AS d) t""", "cache"))
def k5_snapshot_retention(spark, sf):
    """Three snapshots of the cache table, the oldest deleted after 30 days; the others are listed and read."""
    import datetime as dt
    bk = scratch_path(spark, "backups")
    for day in (dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 9)):
        K.snapshot_tables(spark, {"model_cache": A.cache_entries(spark, sf)}, bk, taken_at=day)
    K.delete_snapshots(spark, bk, 30, as_of=dt.datetime(2024, 2, 9))
    left = [(r["taken_at"], r["path"]) for r in K.list_snapshots(spark, bk).collect()]  # two rows
    parts = [spark.read.parquet(path).agg(F.lit(t.strftime("%Y-%m-%d")).alias("taken_on"), F.count(F.lit(1)).alias("n")) for t, path in left]
    return parts[0].unionByName(parts[1])

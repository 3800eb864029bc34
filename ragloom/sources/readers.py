"""Sources (S1-S8). Every reader declares its schema (no inference pass over the data) and
returns a lazy DataFrame; filters placed after it are pushed into the scan where the
format allows (parquet, JDBC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import keep_existing_files
from ..operators.ordering import head_n
from ..operators.windows import prefix_agg
from .records import csv_records, json_elements

METADATA_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                    ("image_filename", "description", "tags", "style", "category")])

ANNOTATIONS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("image_path", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("captions", T.ArrayType(T.StringType())),
    T.StructField("num_objects", T.IntegerType())])

COCO_SCHEMA = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()),
        T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("coco_url", T.StringType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType())]))),
    T.StructField("categories", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
])

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("module", T.StringType()), T.StructField("function", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("exception", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("traceback", T.ArrayType(T.StringType()))])),
    # extra fields written by the performance / memory / cache / error helpers
    T.StructField("operation", T.StringType()), T.StructField("duration_ms", T.DoubleType()),
    T.StructField("performance_metric", T.BooleanType()), T.StructField("component", T.StringType()),
    T.StructField("memory_mb", T.DoubleType()), T.StructField("memory_metric", T.BooleanType()),
    T.StructField("cache_event", T.StringType()), T.StructField("error_type", T.StringType()),
])
LOG_KNOWN = [f.name for f in LOG_SCHEMA.fields]


# ------------------------------------------------------------------------------ S1
def _file_order(records: DataFrame) -> DataFrame:
    """``row_pos``: files by name, then records by their place in the file. A range's first byte plus a
    record's number in it is below the next range's first byte."""
    files = records.select("name").distinct()  # one row per file
    rank = files.withColumn("__rank", F.row_number().over(Window.orderBy("name")).cast("long"))
    return (records.join(F.broadcast(rank), "name")
            .withColumn("row_pos", F.shiftleft("__rank", 46) + F.col("block") + F.col("pos")).drop("__rank"))


def read_metadata_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Header CSV (image_filename, description, tags, style, category); fields may hold line breaks,
    and one large file is read by several tasks (:mod:`.records`). The optional head-n is
    taken in file order before any validity filter. ``row_pos`` keeps that order."""
    options = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    fields = ", ".join(f"{f.name} string" for f in METADATA_CSV_SCHEMA.fields)
    rows = _file_order(csv_records(spark, path)).select(F.from_csv("text", F.lit(fields), options).alias("r"), "row_pos")
    return head_n(rows.select("r.*", "row_pos"), max_rows, "row_pos")


# ------------------------------------------------------------------------------ S2
def read_annotations_json(spark: SparkSession, path: str, split: str | None = None, image_dir: str = "",
                          max_rows: int | None = None, files: DataFrame | None = None,
                          array_file: bool = True) -> DataFrame:
    """Annotation records – one JSON array per file (the processed-annotations layout,
    ``array_file=True``, read by several tasks per file) or JSON lines (what K2 writes,
    ``array_file=False``). Keep paths under ``image_dir/split``, then head-n (by id), then – when
    a listing is given – only records whose file exists (J4)."""
    if array_file:
        elements = json_elements(spark, path, depth=1)
        df = elements.select(F.from_json("text", ANNOTATIONS_SCHEMA).alias("r")).select("r.*")
    else:
        df = spark.read.json(path, schema=ANNOTATIONS_SCHEMA)
    if split is not None:
        prefix = f"{image_dir.rstrip('/')}/{split}" if image_dir else split
        df = df.filter(F.col("image_path").startswith(prefix))
    df = head_n(df, max_rows, "id")
    if files is not None:
        df = keep_existing_files(df, files, "image_path", "path")
    return df


# ------------------------------------------------------------------------------ S3
def read_coco_instances(spark: SparkSession, path: str):
    """S3: one nested instances document per file -> (images, annotations, categories) DataFrames. A
    document is read by several tasks; the objects of its arrays are parsed apart."""
    elements = json_elements(spark, path, depth=2)
    return tuple(elements.filter(F.col("section") == f.name).select(F.from_json("text", f.dataType.elementType).alias("r")).select("r.*")
                 for f in COCO_SCHEMA.fields)


# ------------------------------------------------------------------------------ S4
def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None, num_partitions: int = 8,
                    properties: dict | None = None) -> DataFrame:
    """A PostgreSQL (or any JDBC) table scan, split into ``num_partitions`` range reads when a
    numeric partition column and its bounds are given. Needs the JDBC driver on the classpath."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


# ------------------------------------------------------------------------------ S5
def parse_log_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON log lines -> typed columns plus ``extras`` (unknown keys kept as a string map)."""
    parsed = F.from_json(F.col(value_col), LOG_SCHEMA)
    as_map = F.from_json(F.col(value_col), T.MapType(T.StringType(), T.StringType()))
    known = F.array(*[F.lit(k) for k in LOG_KNOWN])
    return lines.select(parsed.alias("r"), as_map.alias("m")).select(
        "r.*", F.map_filter("m", lambda k, v: ~F.array_contains(known, k)).alias("extras"),
    ).withColumn("ts", F.to_timestamp("timestamp"))


def read_structured_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines application log, batch or stream, with an explicit schema."""
    reader = spark.readStream if stream else spark.read
    return parse_log_lines(reader.format("text").load(path))


# ------------------------------------------------------------------------------ S6
def list_files(spark: SparkSession, directory: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """File listing (path, length, modificationTime); the content column is never read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", str(recursive).lower()).load(directory))
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"), "length", "modificationTime")


# ------------------------------------------------------------------------------ S7
def load_vector_bundle(spark: SparkSession, vectors_path: str, metadata_path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and metadata saved side by side as parquet, both carrying an explicit ``pos``."""
    return spark.read.parquet(vectors_path), spark.read.parquet(metadata_path)


# ------------------------------------------------------------------------------ S8
PHOTO_SEARCH_SCHEMA = ("category_pos int, category string, "
                       "terms array<struct<term:string, photos:array<struct<alt:string, tags:array<string>>>>>")


def flatten_photo_search(df: DataFrame, per_photo_tags: int = 5) -> DataFrame:
    """Search responses (category -> terms -> photos) to metadata rows. Photos are numbered
    1, 2, … over categories, terms and photos in order (``image_%03d.jpg``); description = alt
    text, else the term; tags = the first five joined by ','; style = category = category.

    A term's photos are numbered from its offset, a running count over chunks of the terms
    (:func:`..operators.windows.prefix_agg`), so no task sorts the whole table."""
    terms = df.select("category_pos", "category", F.posexplode("terms").alias("term_pos", "t"))
    photos = terms.select("category_pos", "category", "term_pos", F.col("t.term").alias("term"),
                          F.posexplode(F.coalesce(F.col("t.photos"), F.array())).alias("photo_pos", "p"))
    counts = terms.select("category_pos", "term_pos", F.size(F.coalesce(F.col("t.photos"), F.array())).cast("long").alias("__n"))
    offsets = prefix_agg(counts, [], ["category_pos", "term_pos"], F.col("__n"), inclusive=False, out="__before").drop("__n")
    numbered = photos.join(offsets, ["category_pos", "term_pos"]).withColumn(
        "image_number", F.col("__before") + F.col("photo_pos") + 1)
    return numbered.select(
        F.format_string("image_%03d.jpg", F.col("image_number").cast("int")).alias("image_filename"),
        F.coalesce(F.col("p.alt"), F.col("term")).alias("description"),
        F.array_join(F.slice(F.coalesce(F.col("p.tags"), F.array().cast("array<string>")), 1, per_photo_tags), ",")
        .alias("tags"),
        F.col("category").alias("style"), F.col("category").alias("category"), "image_number")

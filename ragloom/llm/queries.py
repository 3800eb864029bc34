"""One query for each operator over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship, table_path
from . import tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), end_id=1, length=2048)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    folder = scratch_path(spark, "token-ids")
    repair.write(table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), folder, end_id=2)
    return repair.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"), 24).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.learn(docs, ~held_out)
    return langid.identified(docs.select("doc_id", "text"), model)[0].select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judged(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))[0].select("doc_id", "severity", "grade", "toxic")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality, stats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, quality.learn(docs, table(spark, sf_dir, "labels")))[0].select("doc_id", *stats.COUNTS, "base_failed", "kept", "rule")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    file = tokens.public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows, ids = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), *file)
    rows, back = bpe.decoded(rows, *file, ids_col=ids)
    return rows.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(back, 256).alias("decoded_sha256"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    folder = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write(warc.archived(pages), folder)
    kind = pages.schema["page_id"].dataType
    # two scans: the filters that Spark pushes down stay with the relation that was loaded
    responses = warc.read(spark, folder).where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = warc.read(spark, folder, payload=False).where("record_type = 'revisit'").withColumn("payload_bytes", F.col("payload_length"))
    return responses.unionByName(revisits).select(
        warc.page_id("record_id").cast(kind).alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", warc.page_id("refers_to").cast(kind).alias("refers_to")
    )


@query
def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import joined

    return joined(table(spark, sf_dir, "documents"), every_link=True)[0].select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op12_gnat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    coded = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))[0]
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.public("byte_bpe_50k.json"), tokens.public("piece_bpe_32k.model"))


@query
def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))[0].select("page_id", "url", "text", "n_chars")


ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((('0x' || substr(hex || '00', CAST(5 * i // 4 AS INTEGER) + 1, 2))::BIGINT >> (3 - (5 * i) % 4)) & 31) AS INTEGER) + 1, 1)), '') AS digest
      FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b"""

ORACLE["op9_jaccard"] = """
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) l ON l.a = d.doc_id"""


def _codes_sql() -> str:
    """Every round as a table of parts with their nearest entries, and a table of entries."""
    nearest = """SELECT v.id, v.p, v.x, b.e, row_number() OVER (PARTITION BY v.id, v.p
             ORDER BY list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e) AS rank,
             list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM parts v JOIN b{r} b ON b.p = v.p"""
    ctes = ["""kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
      """parts AS MATERIALIZED (SELECT id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(0, 4) t(p))""",
      """b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, x AS y FROM parts
      WHERE id IN (SELECT id FROM kept ORDER BY id LIMIT 256))"""]
    for r in range(4):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT id, p, x, e FROM ({nearest.format(r=r)}) t WHERE rank = 1)")
        ctes.append(f"""u{r} AS (SELECT p, e, k, CAST(floor(sum(x[k])::HUGEINT / count(*)) AS BIGINT) AS y FROM a{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(k) GROUP BY p, e, k)""")
        ctes.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.y, b.y) AS y FROM b{r} b
      LEFT JOIN (SELECT p, e, list(y ORDER BY k) AS y FROM u{r} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    ctes.append(f"last AS MATERIALIZED (SELECT id, p, e, d FROM ({nearest.format(r=4)}) t WHERE rank = 1)")
    ctes.append("""coded AS (SELECT id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY id)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT c.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256
FROM coded c JOIN kept k ON k.id = c.id"""


ORACLE["op12_gnat"] = _codes_sql()

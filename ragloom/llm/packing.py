"""Packing of token ids into training sequences: concatenate and cut.

Two passes. The first encodes every text where it is read and writes, next to the ids, the number of ids
before the document in its partition. The totals of the partitions, summed in order, then give each
document its place in the concatenation of all documents, and the second pass cuts that at every
multiple of the sequence length. A piece is a document's part of one sequence; documents that cross
a cut have several, and these are the boundary records. Only the last sequence has room left.

Nulls and empty texts are documents of the end id alone. The order of the documents is that of the table's
partitions and rows; rows that are repeated, also with the same id, are packed each for itself. An
empty table gives no pieces. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .prefix import before, written
from .textbytes import q


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass. doc_id, part, number (of the row in its partition), local (ids before it
    there), n_tokens with the end id, ids (packed little-endian unsigned 32-bit)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, local, number = tokens.loaded(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for a, flat, off in encoder.encode(batch.column(1)):
                n = len(off) - 1
                flat, off = np.insert(flat, off[1:], np.uint32(end_id)), off + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int64)), pa.array(number + np.arange(n)), pa.array(local + off[:-1]), pa.array(np.diff(off)), tokens.packed(flat, off)],
                    names=["doc_id", "part", "number", "local", "n_tokens", "ids"],
                )
                local, number = local + int(off[-1]), number + n

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, part long, number long, local long, n_tokens long, ids binary"
    return docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).cast("string").alias("text")).mapInArrow(encode, schema)


def offsets(tokenised_docs: DataFrame) -> DataFrame:
    """The first pass's rows with `at`: the ids of all documents before."""
    parts = before(tokenised_docs.groupBy("part").agg(F.sum("n_tokens").alias("_n")), "part", "_n", [], "_at").drop("_n")
    # the broadcast has 16 bytes for each partition that the first pass wrote, whatever they hold
    return tokenised_docs.join(F.broadcast(parts), "part").withColumn("at", F.col("_at") + F.col("local")).drop("_at")


def pack(docs: DataFrame, path: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start (its document's ids before the piece), length, ids (packed), doc_tokens,
    sequence_id, offset (in the sequence)."""
    at = offsets(written(tokenised(docs, path, end_id, id_col, text_col), "packing"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length)
    cut = at.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * length)
    end = F.least(F.col("at") + F.col("n_tokens"), (F.col("sequence_id") + 1) * length)
    cut = cut.withColumn("start", begin - F.col("at")).withColumn("length", end - begin).withColumn("offset", begin - F.col("sequence_id") * length)
    ids = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select("doc_id", "start", "length", ids.alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")

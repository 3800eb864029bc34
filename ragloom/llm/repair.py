"""Token ids on disk under a Re-Pair grammar.

The documents are dealt out by ranges of the id and sorted; a partition's ids are cut into shards of
about two million ids, whole documents each. In a shard, the most frequent pairs of neighbouring symbols are
replaced by new symbols, round after round, until no pair occurs LEAST_COUNT times or fewer than SPENT of the RULES symbols are
left. A pair never crosses two documents. A shard's bytes hold the rules, the lengths of their
expansions, the documents' places among the symbols and the symbols, so one document, or some ids of
it, are decoded without the rest. Shards are rows of a Parquet table, which Spark commits as a whole.

Bytes of a shard, little-endian: "RPR1"; documents, rules, first new symbol, bytes per symbol (2 or 4)
as u32; rules as pairs of u32; expansion lengths as u64; documents + 1 places as u64; symbols.

Nulls and empty texts are documents of the end id alone. Null ids come first; documents with the same
id follow one another in the order of their texts, each for itself. An empty table writes no shard.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .prefix import before
from .textbytes import q

SHARD_IDS = 1 << 21
RULES, RULES_A_ROUND, LEAST_COUNT = 15_200, 3800, 12  # with the ids of a vocabulary of 50,257 these fit in 16 bits
SPENT = 256  # symbols; fewer are not worth another round
_BITS = 18
_HEAD = struct.Struct("<4s4I")


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


def grammar(ids: np.ndarray, ends: np.ndarray, base: int, most: int = RULES, per_round: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their documents' ends, rules as pairs): the ids with frequent pairs replaced."""
    narrow = base + most <= 1 << 16
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    top = base
    while len(seq) > 1 and base + most - top >= min(SPENT, most):
        codes = (seq[:-1] << np.uint32(16) | seq[1:]) if narrow else (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])
        whole = np.ones(len(codes), bool)  # both symbols in the same document
        inner = ends[:-1]
        whole[inner[(inner > 0) & (inner < len(seq))] - 1] = False
        ranked = np.sort(codes[whole])
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
        counts = np.diff(np.append(at, len(ranked)))
        often = np.flatnonzero(counts >= least)
        often = often[np.lexsort((ranked[at[often]], -counts[often]))][: min(per_round, base + most - top)]
        pairs = ranked[at[often]]
        _, one = np.unique(_slot(pairs), return_index=True)  # of pairs that share a slot the most frequent, this round
        pairs = pairs[np.sort(one)]
        if not len(pairs):
            break
        table, code_at = np.full(1 << _BITS, -1, np.int32), np.zeros(1 << _BITS, codes.dtype)
        table[_slot(pairs)], code_at[_slot(pairs)] = np.arange(len(pairs)), pairs
        slot = _slot(codes)
        found = np.flatnonzero(whole & (table[slot] >= 0) & (code_at[slot] == codes))
        # of overlapping pairs every other one is replaced, from the left of each run
        run = np.flatnonzero(np.concatenate([[True], np.diff(found) > 1])) if len(found) else found
        place = np.arange(len(found)) - np.repeat(run, np.diff(np.append(run, len(found))))
        take = found[place % 2 == 0]
        rule = table[slot[take]]
        shift = 16 if narrow else 32
        rules.append(np.stack([pairs >> pairs.dtype.type(shift), pairs & pairs.dtype.type((1 << shift) - 1)], 1).astype(np.uint32))
        seq[take] = top + rule.astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        ends = ends - np.searchsorted(take + 1, ends, "left")
        seq = seq[keep]
        top += len(pairs)
    return seq, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, base: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for pair in rules.tolist():
        out.append(np.concatenate([np.array([s], np.uint32) if s < base else out[s - base] for s in pair]))
    return out


def shard_bytes(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """ends: for each document the number of ids up to its end."""
    base = max(base, int(ids.max()) + 1 if len(ids) else 0)
    seq, ends, rules = grammar(ids, ends, base)
    lengths = np.ones(base + len(rules), np.uint64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[base + i] = lengths[a] + lengths[b]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = _HEAD.pack(b"RPR1", len(ends), len(rules), base, width)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths[base:].astype("<u8").tobytes(), np.concatenate([[0], ends]).astype("<u8").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Shard:
    def __init__(self, data: bytes):
        magic, n, r, self.base, width = _HEAD.unpack_from(data)
        if magic != b"RPR1":
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        self.rules = np.frombuffer(data, "<u4", 2 * r, at).reshape(r, 2)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), np.frombuffer(data, "<u8", r, at + 8 * r).astype(np.int64)])
        self.places = np.frombuffer(data, "<u8", n + 1, at + 16 * r).astype(np.int64)
        self.symbols = np.frombuffer(data, f"<u{width}", -1, at + 16 * r + 8 * (n + 1))
        parts = expansions(self.rules, self.base)
        self.flat = np.concatenate([np.arange(self.base, dtype=np.uint32), *parts])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the documents from number first up to last."""
        symbols = self.symbols[self.places[first] : self.places[last]].astype(np.int64)
        sizes = self.lengths[symbols]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[tokens.spread(self.starts[symbols], sizes)], total[self.places[first : last + 1] - self.places[first]]

    def ids(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Some ids of one document; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.places[doc] : self.places[doc + 1]].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(self.lengths[symbols])])
        start, stop = max(0, start), min(stop, int(total[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(total, start, "right")) - 1, int(np.searchsorted(total, stop, "left"))
        flat = self.flat[tokens.spread(self.starts[symbols[a:b]], self.lengths[symbols[a:b]])]
        return flat[start - total[a] : stop - total[a]]


def write(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write the shards to the folder: part, shard, first_id, last_id, n_ids,
    doc_ids, payload."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = tokens.loaded(path), TaskContext.get().partitionId(), 0
        names, flats, ends, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            doc_ids, ids = pa.concat_arrays(names), np.concatenate(flats)
            named = doc_ids.drop_null() if doc_ids.null_count < len(doc_ids) else doc_ids
            payload = shard_bytes(ids, np.concatenate(ends), len(encoder.opens))
            columns = [pa.array([part]), pa.array([shard]), named[:1], named[-1:], pa.array([len(ids)]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "first_id", "last_id", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for a, flat, off in encoder.encode(batch.column(1)):
                n = len(off) - 1
                flat, off = np.insert(flat, off[1:], np.uint32(end_id)), off + np.arange(n + 1)
                names.append(batch.column(0).slice(a, n))
                flats.append(flat)
                ends.append(held + off[1:])
                held += len(flat)
                if held >= SHARD_IDS:
                    yield flush()
                    names, flats, ends, held, shard = [], [], [], 0, shard + 1
        if names:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part long, shard long, first_id {kind}, last_id {kind}, n_ids long, doc_ids array<{kind}>, payload binary"
    rows = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, schema).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (packed little-endian
    unsigned 32-bit) of every document in the folder."""
    shards = spark.read.parquet(folder)
    order = (F.col("part") * (1 << 24) + F.col("shard")).alias("order")
    at = before(shards.select("part", "shard", order, "n_ids"), "order", "n_ids", [], "at").select("part", "shard", "at")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, doc_ids, at = Shard(batch.column(1)[i].as_py()), batch.column(0)[i].values, batch.column(2)[i].as_py()
                a, n = 0, len(doc_ids)
                total = np.concatenate([[0], np.cumsum(shard.lengths[shard.symbols])])[shard.places]
                while a < n:
                    b = max(a + 1, int(np.searchsorted(total, total[a] + SHARD_IDS // 4, "right")) - 1)
                    flat, off = shard.decode(a, b)
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(at + total[a] + off[:-1]), pa.array(np.diff(off)), tokens.packed(flat, off)], names=["doc_id", "start", "n_tokens", "ids"])
                    a = b

    kind = shards.schema["first_id"].dataType.simpleString()
    # the broadcast has 24 bytes for each shard of two million ids: 2 MB for a terabyte of text
    return shards.join(F.broadcast(at), ["part", "shard"]).select("doc_ids", "payload", "at").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, folder: str, doc_id, start: int = 0, stop: int = 1 << 62) -> list[int]:
    """Some ids of one document (the first of that id): the scan is pruned by the shards' id ranges."""
    rows = spark.read.parquet(folder).where((F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id)))
    rows = rows.where(F.array_contains("doc_ids", F.lit(doc_id))).orderBy("part", "shard").select("payload", F.array_position("doc_ids", F.lit(doc_id)).alias("i")).head(1)
    return Shard(bytes(rows[0].payload)).ids(int(rows[0].i) - 1, start, stop).tolist() if rows else []

"""Byte-level BPE of whole texts by a rank file, and back.

Overlapping chunk encoding. A text of more than `chunk` characters is cut into chunks, each with
`overlap` characters of the next. The chunks are dealt out to tasks and cut into pre-tokens there by
themselves. A chunk that begins amid a pre-token finds wrong ones at first, but from the first place in the
overlap where both neighbours have a boundary they agree, so there the left chunk's ids end and the
right one's begin. Should two neighbours have no such place, they are joined and cut again as one. Only
boundaries after a character other than white space count, so the pieces between two of them are encoded by
themselves. Texts that fit in one chunk are encoded where they are read, without a shuffle. Equal long texts are
encoded once.

Nulls and empty texts have no ids. Rows that are repeated are encoded each for itself or, if long, once
for all. Decoding joins the bytes of the ids; an id that the file lacks is an error. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .textbytes import fresh, q

CHUNK, OVERLAP = 32_768, 1024  # characters
_LOADED: dict[tuple[str, str], "Codec"] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes = tokens.Rows(np.uint8)
        parts = [b""] * size
        for token, i in ranks.items():
            parts[i] = token
        self.bytes.add(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))
        self.there = np.array([bool(p) for p in parts])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (int(ids.max()) >= len(self.there) or not self.there[ids].all()):
            raise ValueError("an id that the rank file lacks")
        return self.bytes.take(ids.astype(np.int64))

    def boundaries(self, text: str) -> np.ndarray:
        """Where a pre-token ends after a character that isn't white space, but for the text's end."""
        return np.array([e for m in self.pattern.finditer(text) if (e := m.end()) < len(text) and not text[e - 1].isspace()], np.int64)


def loaded(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


class Piece:
    """The ids of a chunk, and how many of them lie before each boundary in its overlaps."""

    def __init__(self, codec: Codec, text: str, start: int, overlap: int, first: bool, last: bool):
        self.text, self.start, self.first, self.last = text, start, first, last
        at = codec.boundaries(text)
        marks = at[((at <= overlap) & (not first)) | ((at >= len(text) - overlap) & (not last))]
        cuts = [0, *marks.tolist(), len(text)]
        parts = [codec.encode(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.marks = start + marks
        self.before = np.cumsum([len(p) for p in parts])[:-1]
        self.ids = np.concatenate(parts)

    def meets(self, right: "Piece") -> tuple[int, int] | None:
        """How many ids of this chunk and of the right one lie before the first boundary of both."""
        _, a, b = np.intersect1d(self.marks, right.marks, assume_unique=True, return_indices=True)
        return (int(self.before[a[0]]), int(right.before[b[0]])) if len(a) else None


def stitch(codec: Codec, pieces: Iterator[Piece], overlap: int) -> np.ndarray:
    """The ids of a text from those of its chunks, in their order."""
    out, left, skip = [], None, 0
    for right in pieces:
        if left is None:
            left = right
            continue
        cut = left.meets(right)
        if cut is None or cut[0] < skip:
            # joined from the left chunk's start, which is a boundary if it is the first or has been stitched
            text = left.text[: right.start - left.start] + right.text
            begin = int(left.marks[np.searchsorted(left.before, skip, "left")]) if skip else left.start
            text = text[begin - left.start :]
            left, skip = Piece(codec, text, begin, overlap, True, right.last), 0
            continue
        out.append(left.ids[skip : cut[0]])
        left, skip = right, cut[1]
    if left is not None:
        out.append(left.ids[skip:])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _packed(rows: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return tokens.packed(np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.uint32), off)


def long_texts(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """key, ids for a table of key and text, by way of chunks."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1 - overlap), F.lit(chunk))
    rows = texts.select("key", "text", F.posexplode(starts).alias("k", "start"))
    last = F.col("start") + chunk + overlap >= F.length("text")
    rows = rows.select("key", "k", "start", F.expr(f"substring(text, start + 1, {chunk + overlap})").alias("text"), last.alias("last"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                some = batch.slice(a, 16)
                pieces = [Piece(codec, r["text"], r["start"], overlap, r["k"] == 0, r["last"]) for r in some.to_pylist()]
                extra = [_packed([p.ids for p in pieces]), *(pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in ([p.marks for p in pieces], [p.before for p in pieces]))]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], names=["key", "k", "start", "text", "last", "ids", "marks", "before"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path, pattern)

        def rows() -> Iterator[tuple[str, Piece]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    p = object.__new__(Piece)
                    p.text, p.start, p.first, p.last, p.ids = r["text"], r["start"], r["k"] == 0, r["last"], np.frombuffer(r["ids"], "<u4")
                    p.marks, p.before = np.array(r["marks"], np.int64), np.array(r["before"], np.int64)
                    yield r["key"], p

        from itertools import groupby

        for key, pieces in groupby(rows(), lambda r: r[0]):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), _packed([stitch(codec, (p for _, p in pieces), overlap)])], names=["key", "ids"])

    spread = rows.repartition("key", "k").mapInArrow(scan, "key string, k int, start int, text string, last boolean, ids binary, marks array<long>, before array<long>")
    return spread.repartition("key").sortWithinPartitions("key", "k").mapInArrow(join, "key string, ids binary")


def encoded(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text") -> tuple[DataFrame, str]:
    """The table without the text and with the ids of each (packed little-endian unsigned 32-bit
    integers); the ids' column."""
    text, key, ids = fresh(docs, "text_", "key_", "ids")
    others = [F.col(q(c)) for c in docs.columns if c != text_col]
    names = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias(text))
    one = F.length(F.col(text)) <= chunk + overlap
    at = len(names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*some.columns[:at], _packed([codec.encode(t) for t in some.column(at).to_pylist()])], names=[*names, ids])

    kind = rows.select(*[F.col(q(c)) for c in names], F.lit(b"").alias(ids)).schema
    short = rows.where(one).mapInArrow(whole, kind)
    keyed = rows.where(~one).withColumn(key, F.sha2(F.col(text).cast("binary"), 256))
    texts = keyed.groupBy(F.col(key).alias("key")).agg(F.first(F.col(text)).alias("text"))
    long = keyed.drop(text).join(long_texts(texts, path, pattern, chunk, overlap).select(F.col("key").alias(key), F.col("ids").alias(ids)), key)
    return short.unionByName(long.select(*[F.col(q(c)) for c in names], F.col(ids))), ids


def decoded(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> tuple[DataFrame, str]:
    """The table with the bytes of its ids; the new column."""
    (name,) = fresh(rows, "decoded")
    at = rows.columns.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                flat = [np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u4") for x in some.column(at)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([codec.decode(f).tobytes() for f in flat], pa.binary())], names=[*some.schema.names, name])

    return rows.mapInArrow(join, rows.withColumn(name, F.lit(b"")).schema), name

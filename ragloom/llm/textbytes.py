"""Vectorised work on the bytes of many texts at once: words, lines, hashes.

The functions take the UTF-8 bytes of a few texts laid end to end and their offsets, so that a
task handles an Arrow batch with numpy passes and creates no Python string per word. Hashes have 64 bits
and are the same in every process; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 21
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * GOLD)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, U64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes, one row at least; a
    null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Bytes:
    """Prefix hashes of one slice, and its words: runs of bytes other than white space, or of those
    that a table of 256 flags names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None):
        self.data = LOWER[data] if lower else data
        self.offsets, self.docs = offsets, len(offsets) - 1
        n = len(data)
        if n:
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.data] * _powers(n + 1)[0][:n], out=self.sums[1:])
        else:
            self.sums = np.zeros(1, U64)
        self.inside = ~_SPACE[self.data] if inside is None else inside[self.data]
        cut = offsets[1:-1]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = self.inside[:-1], self.inside[1:]
        before[cut[cut < n]] = False
        after[cut[cut > 0] - 1] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.word_doc = self.doc_of(self.starts)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; they depend on the bytes alone."""
        return mix((self.sums[ends] - self.sums[starts]) * _powers(len(self.data) + 1)[1][starts] + (ends - starts).astype(U64) * GOLD)

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def per_doc(self, docs: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(docs, weights, self.docs)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[self.offsets])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the \\n-split lines that hold a word."""
        first = np.zeros(len(self.data), bool)
        first[1:] = self.data[:-1] == 10
        first[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(self.data))
        ends = ends - ((ends > starts) & (self.data[ends - 1] == 10)) if len(starts) else ends[:0]
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(self.inside, out=c[1:])
        full = c[ends] > c[starts]
        return starts[full], ends[full], self.doc_of(starts[full])


def with_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys that are equal where both the hash and the text are."""
    return mix(hashes + (docs.astype(U64) + U64(1)) * GOLD)


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words within a text, and where each begins."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[width - 1 :])
    h = np.zeros(len(at), U64)
    for k in range(width):
        h = mix(h + hashes[at + k] + GOLD)
    return h, at


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names, prolonged where the table has a column of that name already."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> str:
    """A column's name, quoted for F.col and SQL text."""
    return "`" + name.replace("`", "``") + "`"


def widened(df: DataFrame, columns: dict[str, str]) -> StructType:
    """The table's schema with more columns at its end."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def appended(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

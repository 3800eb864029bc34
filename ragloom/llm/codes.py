"""Product codes of integer vectors, each part's nearest codebook entry found in a GNAT over the entries.

A component x becomes the whole number floor(1024 * x), a vector is cut into equal consecutive parts, and every
part position has a codebook. It starts as that part of the vectors with the smallest ids; each round gives
every part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces an entry by the
componentwise floor of its parts' mean. All vectors take part in every round.

The entries of a codebook are kept in a geometric near-neighbour access tree. A node has a few split points; every other
entry of the node belongs to its nearest split point's child, and for each split point and child the
range of distances from the one to the members of the other is known. With a query at distance d from a split point and
r from the best entry so far, a child whose range lies wholly beyond [d - r, d + r] cannot hold an entry as near as that,
and its whole subtree is left out. Only a strict excess counts, with distances rounded away from it, so
an entry at the same distance is still met; entries met are compared by their squared distances as whole numbers and then by
index. The tree answers a batch of queries at once: a node's distances are one matrix product.

A round is one pass of tasks over the vectors: each task sends the sum and count of the parts it gave to each
entry, Spark adds these up by entry, and the driver holds the codebooks alone (parts x entries x components).

Defined results: rows whose vector is null or holds null, NaN or infinite components are left out. Of the other rows
the one that comes first (by id, nulls last, then by vector) sets the length; vectors of another length or of one
that does not divide into the parts, and those with a component beyond exact 63-bit sums (131,072 for 64 components),
take no part and have null codes and errors. A label's sum beyond 63 bits is null. Repeated ids are rows of their own. With
fewer vectors than entries a codebook has as many entries as there are vectors; no vector at all gives no rows. Other
columns are kept; the columns added get a longer name where theirs is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import beside
from .prefix import written
from .textbytes import appended, fresh, q, widened

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
EXACT = 1 << 60  # a component's square times the vector's length is at most this, so an error has 63 bits
SPLITS, LEAF = 12, 24
BLOCK = 8192  # queries that meet a tree together


# ------------------------------------------------------------------ the tree
def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` to each of ``b``, exact."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)), 1)
    if 4 * top * top * max(a.shape[1], 1) < 1 << 53:  # whole numbers that doubles hold
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def below(squared: np.ndarray) -> np.ndarray:
    """Distances, rounded down by more than the root and the sums after it can be off."""
    return np.sqrt(squared.astype(np.float64)) * (1 - 1e-12)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 1e-12)


class Gnat:
    """Entries (rows of whole numbers) under their split points."""

    def __init__(self, entries: np.ndarray, at: np.ndarray | None = None):
        self.entries = entries
        at = np.arange(len(entries)) if at is None else at
        self.children: list[tuple[Gnat, np.ndarray, np.ndarray]] = []
        if len(at) <= LEAF:
            self.splits = at
            return
        near = squares(entries[at], entries[at[:1]])[:, 0]
        chosen = [0]
        while len(chosen) < SPLITS and near.max() > 0:  # the entry farthest from those chosen
            chosen.append(int(near.argmax()))
            near = np.minimum(near, squares(entries[at], entries[at[chosen[-1:]]])[:, 0])
        self.splits = np.sort(at[chosen])
        rest = np.setdiff1d(at, self.splits)
        d = squares(entries[self.splits], entries[rest])
        owner = d.argmin(0)
        for j in range(len(self.splits)):
            mine = owner == j
            if mine.any():
                self.children.append((Gnat(entries, rest[mine]), below(d[:, mine].min(1)), above(d[:, mine].max(1))))

    def visit(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> int:
        """Lowers `best` (index) and `least` (squared distance) of the rows; the number of distances computed."""
        d = squares(points[rows], self.entries[self.splits])
        first = d.argmin(1)  # of equal ones the lowest index, as the splits ascend
        found, index = d[np.arange(len(rows)), first], self.splits[first]
        better = (found < least[rows]) | ((found == least[rows]) & (index < best[rows]))
        best[rows[better]], least[rows[better]] = index[better], found[better]
        done = d.size
        if self.children:
            low, high = below(d), above(d)
            for child, nearest, farthest in self.children:
                r = above(least[rows])[:, None] * (1 + 1e-12)
                out = (low * (1 - 1e-12) > farthest + r) | (nearest * (1 - 1e-12) > high + r)
                on = rows[~out.any(1)]
                if len(on):
                    done += child.visit(points, on, best, least)
        return done

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each point's nearest entry (ties to the lower index), its squared distance, and the number of
        distances computed for it all."""
        best, least, done = np.full(len(points), len(self.entries), np.int64), np.full(len(points), np.iinfo(np.int64).max), 0
        for a in range(0, len(points), BLOCK):
            done += self.visit(points, np.arange(a, min(a + BLOCK, len(points))), best, least)
        return best, least, done


# ------------------------------------------------------------------ vectors as whole numbers
def whole(vectors: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors are kept, and the whole numbers of their components as little-endian 32-bit
    integers; null for vectors with a component too large."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    off = np.concatenate([[0], ends])

    def none(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[off[1:]] == c[off[:-1]]

    kept = ~pc.is_null(vectors).to_numpy(zero_copy_only=False) & none(~np.isfinite(x))
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.floor(x * SCALE)
        large = ~(np.abs(n) <= np.repeat(np.floor(np.sqrt(EXACT / np.maximum(lengths, 1))), lengths))
    ints = np.where(large, 0, n).astype("<i4")
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off * 4), pa.py_buffer(ints)])
    return kept, pc.if_else(pa.array(none(large)), data.cast(pa.binary()), pa.scalar(None, pa.binary()))


def prepared(df: DataFrame, vector_col: str, ints: str) -> DataFrame:
    """The rows that are kept, with their whole numbers in place of the vector."""
    left = df.drop(vector_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, data = whole(b.column(b.schema.get_field_index(vector_col)))
            rest = b.select([n for n in b.schema.names if n != vector_col])
            yield appended(rest, **{ints: data}).filter(pa.array(kept))

    return df.mapInArrow(rows, widened(left, {ints: "binary"}))


def parts_of(data: pa.Array, length: int, parts: int) -> np.ndarray:
    """(rows, parts, components) of vectors that all have the given length."""
    data = data.cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    flat = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]] if len(data) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return flat.view("<i4").reshape(len(data), parts, length // parts).astype(np.int64)


# ------------------------------------------------------------------ learning
def first_books(vectors: DataFrame, id_col: str, ints: str, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, components): the parts of the vectors with the smallest ids."""
    order = [F.col(q(id_col)).asc_nulls_last(), F.col(q(ints))]
    head = vectors.where(F.col(q(ints)).isNotNull()).orderBy(*order).select(F.octet_length(q(ints)).alias("n")).first()
    if head is None or not head.n or head.n % (4 * parts):
        return None
    same = vectors.where(F.octet_length(q(ints)) == head.n)
    start = same.orderBy(*order).limit(entries).select(F.col(q(ints)).alias("v")).collect()
    flat = np.concatenate([np.frombuffer(r.v, "<i4") for r in start]).astype(np.int64)
    return flat.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()


def learn(vectors: DataFrame, ints: str, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after the given rounds over all vectors of their length."""
    parts, entries, width = books.shape
    sums = [f"s{k}" for k in range(width)]
    same = vectors.where(F.octet_length(q(ints)) == 4 * parts * width).select(F.col(q(ints)).alias("v"))
    for _ in range(rounds):

        def totals(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            trees = [Gnat(b) for b in books]
            count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for b in batches:
                points = parts_of(b.column(0), parts * width, parts)
                for p, tree in enumerate(trees):
                    best = tree.nearest(points[:, p])[0]
                    count[p] += np.bincount(best, minlength=entries)
                    order = best.argsort(kind="stable")
                    cut = np.flatnonzero(np.diff(best[order], prepend=-1))
                    total[p][best[order][cut]] += np.add.reduceat(points[order, p], cut, axis=0) if len(cut) else 0
            p, e = np.nonzero(count)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *(pa.array(np.ascontiguousarray(c)) for c in total[p, e].T)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *sums])

        schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
        found = same.mapInArrow(totals, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums)).collect()
        books = books.copy()
        for r in found:  # at most one row an entry
            books[r.part, r.entry] = [int(r[s]) // r.n for s in sums]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


# ------------------------------------------------------------------ the operator
def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """The rows kept, with `code` (binary, a byte for each part), `error` (their squared distances to their
    entries), `label_error` (summed over equal labels, nulls together) and `codebooks_sha256`, all
    long or string; and the codebooks (parts, entries, components), or None without a vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    ints = fresh(df, "ints")[0]
    code, error, together, sha = fresh(df.drop(vector_col), "code", "error", "label_error", "codebooks_sha256")
    vectors = written(prepared(df, vector_col, ints), "vectors")
    books = first_books(vectors, id_col, ints, parts, entries)
    left = vectors.drop(ints)
    if books is None:
        nothing = {code: "binary", error: "long", together: "long", sha: "string"}
        return vectors.select(*(F.col(q(c)) for c in left.columns), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items())), None
    books = learn(vectors, ints, books, rounds)
    width = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for b in batches:
            data = b.column(b.schema.get_field_index(ints))
            fits = pc.fill_null(pc.equal(pc.binary_length(data), 4 * parts * width), False)
            points = parts_of(data.filter(fits), parts * width, parts)
            codes, errors = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p, tree in enumerate(trees):
                codes[:, p], least, _ = tree.nearest(points[:, p])
                errors += least
            at = pc.if_else(fits, pc.subtract(pc.cumulative_sum(fits.cast(pa.int64())), 1), pa.scalar(None, pa.int64()))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            rest = b.select([n for n in b.schema.names if n != ints])
            yield appended(rest, **{code: flat.take(at), error: pa.array(errors).take(at)})

    out = written(vectors.mapInArrow(coded, widened(left, {code: "binary", error: "long"})), "codes")
    sums = out.groupBy(F.col(q(label_col)).alias("key")).agg(F.try_sum(q(error)).alias("value"))
    return beside(out, q(label_col), sums, together).withColumn(sha, F.lit(digest(books))), books


def restored(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes (rows of bytes) stand for, in the scale of the originals."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1) / SCALE

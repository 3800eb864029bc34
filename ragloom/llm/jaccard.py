"""Near-duplicate join by the Jaccard similarity of word shingles, exact, with a count-vector R-tree.

A text's set holds its different runs of five words, lower-cased; a text of fewer words has its whole sequence as
its one shingle, and one without words has no set and no link. Two texts link if their sets' similarity is
at least the threshold.

1. Sets. Equal sets are one class, held by its smallest id. Shingles are ordered so that those few texts have
   come first: those that an array of counters of fixed size shows to be common last, else the
   longest first, as chance seldom repeats these. Two sets that link share one of the
   first n - ceil(threshold * n) + 1 shingles of either.
2. Cells. The classes that have a shingle among these first ones make up its cell; cells of one class go.
   Cells of the same classes are one cell.
3. Each class in a cell is a point: shingles are hashed into groups, a quarter as many as shingles or more, and the
   point has the number of its shingles in each group. The overlap of two is at most the sum, over the groups, of the
   smaller count, the groups of the larger point joined where it has more; sets of more than 256 shingles have
   a second point with more groups, for pairs that the first lets through. Of the pairs of a cell's first class with the others, those whose bound suffices are verified on the texts, and the
   components found. That joins a family of copies by as many pairs as it has members.
4. In the cells that still hold several components, an R-tree over the points bounds the overlap with a
   box by the sum of the smaller of the point's count and the box's greatest, and so finds the pairs of different
   components whose overlap may suffice. Two classes may meet in many cells: rows carry the smallest few
   cells of their class, and a pair is left to the smallest cell that both carry. These are verified, and the components found again. So no link between
   components is lost. The pairs verified up to here span the components; within one they are not all links.
5. Every link, if asked for: all links lie within components, so a component's classes are dealt to blocks, and
   the overlaps of two blocks are a matrix product of their sets. A pair meets once. The number of links of a
   row is that of the other rows with an id whose sets link with its own, equal sets included; it is summed
   in the blocks, so no rows of pairs are made for it.

Verified pairs carry the similarity. Null and empty texts get n_shingles 0 and are components of
their own. A null id can't be named as a component: such rows take part in no link. Rows that repeat an id with
another text link to both texts' neighbours. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .prefix import written
from .textbytes import GOLD, SLICE_BYTES, Bytes, fresh, mix, q, slices, windows
from .tokens import spread

WIDTH, PERCENT = 5, 75
COUNTERS = 21  # bits: two million counters
GROUPS = 256
CROWD = 4  # shingles in a group, on average; beyond it a point has eight times as many groups
POINT_BYTES = 32 << 20  # unpacked
LEAF = 16
FEW = 256  # points that are looked at without a tree
CARRIED = 8  # cells of a class that its rows carry
BUCKET_POSTINGS = 1 << 19
HEAVY = 1 << 15  # texts, by estimate; the cells of such shingles are never gathered
POINTS = 4096
SMALL_BYTES = 32 << 20
BLOCK, BLOCK_BYTES = 256, 8 << 20  # classes, and bytes of their texts, in a block
SMALL_COMPONENTS = 2048  # classes of components of one block that are looked at together
COLUMNS = 4096


def shingles(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, texts, bytes in words) of the different shingles of each text, by text."""
    b = Bytes(data, off, lower=True)
    words, docs = b.words(), b.word_doc
    h, at = windows(words, docs, width)
    of = docs[at]
    size = np.concatenate([[0], np.cumsum(b.ends - b.starts)])
    length = size[at + width] - size[at]
    n = b.per_doc(docs)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        first = np.searchsorted(docs, few)
        whole = n[few].astype(np.uint64) * GOLD
        for k in range(width - 1):
            on = n[few] > k
            whole[on] = mix(whole[on] + words[first[on] + k])
        h, of, length = np.concatenate([h, mix(whole)]), np.concatenate([of, few]), np.concatenate([length, size[first + n[few].astype(np.int64)] - size[first]])
    order = np.lexsort((h, of))
    h, of, length = h[order], of[order], length[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[once], of[once], length[once]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles, ordered, must be looked at so that no partner is missed."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def counters(docs: DataFrame) -> np.ndarray:
    """By bucket of the shingle hash, how many (text, shingle) fall into it; 2**COUNTERS numbers."""
    block = 1 << 14

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for _, data, off in slices(batch.column(0)):
                h, _, _ = shingles(data, off)
                total += np.bincount((h >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(total))
        for k in range(0, len(total), block):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.minimum(total[k : k + block], 65535).astype("<u2").tobytes()], pa.binary())], names=["k", "n"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.int64)
        for batch in batches:
            for n in batch.column("n"):
                total += np.frombuffer(n.as_buffer(), "<u2")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["k", "n"])

    got = docs.select("text").mapInArrow(tally, "k long, n binary").groupBy("k").applyInArrow(add, "k long, n binary").toArrow()
    out = np.zeros(1 << COUNTERS, np.int64)
    for k, n in zip(got["k"].to_pylist(), got["n"].to_pylist(), strict=True):
        out[k : k + block] = np.frombuffer(n, "<i8")
    return out


def fine_groups(h: np.ndarray) -> bytes:
    """Counts in eight times as many groups, and eight times as many again, until there are half as many
    as shingles; one or four bytes each."""
    n = GROUPS * 8
    while n * 2 < len(h) and n < GROUPS * 512:
        n *= 8
    counts = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def fine_overlap(a: bytes, b: bytes) -> int:
    """What two sets can have in common at most; the groups of the finer counts are joined."""
    x, y = (np.frombuffer(v, "<u1" if len(v) in (GROUPS * 8, GROUPS * 64, GROUPS * 512) else "<u4").astype(np.int64) for v in (a, b))
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def point(h: np.ndarray) -> bytes:
    """Counts of a set's shingles in GROUPS groups, or eight times as many, and again, until a group has few; one or four
    bytes each, which their number tells apart, compressed."""
    n = GROUPS
    while n * CROWD < len(h) and n < GROUPS * 512:
        n *= 8
    counts = np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return zlib.compress(counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes(), 1)


def unpacked_bytes(size: str) -> Column:
    """The bytes of a point's counts, unpacked, by the number of its set's shingles."""
    n = GROUPS * 512
    out = F.lit(n * 4)
    while n > GROUPS:
        n //= 8
        out = F.when(F.col(size) <= n * CROWD, n * 4).otherwise(out)
    return out.cast("long")


def resolution(raw: bytes) -> int:
    """How many groups a point has."""
    n = GROUPS
    while n * 8 <= len(raw):
        n *= 8
    return n


def matrices(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, counts) of the points of each number of groups, fewest first."""
    rows = [zlib.decompress(r) for r in rows]
    groups = np.array([resolution(r) for r in rows], np.int64)
    out = []
    for n in np.unique(groups):
        at = np.flatnonzero(groups == n)
        counts = np.zeros((len(at), n), np.uint32)
        narrow = np.array([len(rows[i]) == n for i in at], bool)
        for some, width in ((narrow, 1), (~narrow, 4)):
            if some.any():
                counts[some] = np.frombuffer(b"".join([rows[i] for i in at[some]]), f"<u{width}").reshape(-1, n)
        out.append((at, counts))
    return out


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts (rows, or one row) in fewer groups; a group is named by the low bits of a hash."""
    return counts.reshape(*counts.shape[:-1], counts.shape[-1] // groups, groups).sum(-2, dtype=np.uint32)


def common_most(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """What the sets of two lists of points can have in common at most, row by row."""
    out = np.zeros(len(a), np.int64)
    for x_at, x in matrices(a):
        for y_at, y in matrices(b):
            rows, i, j = np.intersect1d(x_at, y_at, return_indices=True)
            n = min(x.shape[1], y.shape[1])
            out[rows] = np.minimum(folded(x[i], n), folded(y[j], n)).sum(1, dtype=np.int64)
    return out


def levels(counts: np.ndarray, heavy: int) -> np.ndarray:
    """By bucket, 0 for counts that chance explains and more for each doubling beyond; 255 for `heavy` or more."""
    mean = counts.mean()
    beyond = np.maximum(counts - mean, 1) / (3 * np.sqrt(mean) + 2)
    return np.where(counts >= heavy, 255, np.clip(np.ceil(np.log2(beyond)), 0, 254)).astype(np.uint8)


def sets(docs: DataFrame, kind: str, percent: int, common) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (equal for equal sets), name (64 bits of these), first (packed hashes of
    the shingles that must be looked at), groups (its point), fine (counts in more groups)."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = common.value
        for batch in batches:
            for a, data, off in slices(batch.column(1), 1 << 20):
                h, of, length = shingles(data, off)
                n = np.bincount(of, minlength=len(off) - 1)
                start = np.cumsum(n) - n
                k1, k2, name = named(h, of, n)
                level = seen[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)]
                order = np.lexsort((h, -length, level, of))
                take = needed(n, percent)
                first = h[order][spread(start, take)]
                at = np.concatenate([[0], np.cumsum(take)])
                packed = lambda x, at: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())  # noqa: B023, E731
                groups = pa.array([point(h[i : i + m]) for i, m in zip(start.tolist(), n.tolist(), strict=True)], pa.binary())
                fine = pa.array([fine_groups(h[i : i + m]) if m > GROUPS else None for i, m in zip(start.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(n)), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(name.view(np.int64)), packed(first, at * 8), groups, fine], names=["doc_id", "n_shingles", "k1", "k2", "name", "first", "groups", "fine"])

    return docs.mapInArrow(measure, f"doc_id {kind}, n_shingles long, k1 long, k2 long, name long, first binary, groups binary, fine binary")


def heavy_of(h: np.ndarray, common) -> np.ndarray:
    return common.value[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)] == 255


def cells(rows: DataFrame, common) -> DataFrame:
    """cell, name: the different groups of several classes that share one of their first shingles.

    Shingles are dealt to buckets by their hash, as packed arrays, and a bucket's task sorts them and names
    cells by their classes. A task deals out a class once for each of its batches, however many copies it
    has. The counters bound how many classes a shingle can have; one that may be heavy is not gathered: its
    cell is named by the shingle and stays rows of a table."""
    total = rows.agg(F.sum(F.octet_length("first")).alias("n")).first().n or 0
    buckets = max(1, ceil(total / 8 / BUCKET_POSTINGS), rows.sparkSession.sparkContext.defaultParallelism)

    def unpacked(batches: Iterator[pa.RecordBatch], lightly: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            names, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            for a in range(0, len(at), 4096):
                raw = batch.column(1).take(pa.array(at[a : a + 4096])).to_pylist()
                h = np.frombuffer(b"".join(raw), "<u8")
                row = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
                some = heavy_of(h, common) != lightly
                yield names[a : a + 4096], h[some], row[some]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, h, row in unpacked(batches, True):
            # the high half chooses the bucket, and the low half tells its shingles apart: two that
            # share it give a pair more to verify
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edge)):
                at = order[edge[k] : edge[k + 1]]
                own, of = np.unique(row[at], return_inverse=True)
                packed = [h[at].astype("<u4").tobytes(), of.astype("<u2").tobytes(), names[own].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)]), *(pa.array([x], pa.binary()) for x in packed)], names=["bucket", "h", "row", "names"])

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, row, names, n = [], [], [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                h.append(np.frombuffer(batch.column("h")[r].as_buffer(), "<u4"))
                row.append(np.frombuffer(batch.column("row")[r].as_buffer(), "<u2").astype(np.int64) + n)
                names.append(np.frombuffer(batch.column("names")[r].as_buffer(), "<i8"))
                n += len(names[-1])
        names, same = np.unique(np.concatenate(names), return_inverse=True)
        h, row = np.concatenate(h), same[np.concatenate(row)]
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[once], row[once]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(at, len(h)))
        at, size = at[size > 1], size[size > 1]
        if not len(at):
            return
        # a cell is named by its classes, so equal cells of all buckets have one name
        cell = mix(np.add.reduceat(mix(names.view(np.uint64)[row[spread(at, size)]]), np.cumsum(size) - size) + size.astype(np.uint64) * GOLD)
        _, one = np.unique(cell, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell[one], size[one]).view(np.int64)), pa.array(names[row[spread(at[one], size[one])]])], names=["cell", "name"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, h, row in unpacked(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(mix(h + GOLD).view(np.int64)), pa.array(names[row])], names=["cell", "name"])

    first = rows.select("name", "first")
    dealt = first.mapInArrow(deal, "bucket long, h binary, row binary, names binary").groupBy("bucket").applyInArrow(gather, "cell long, name long")
    return dealt.unionByName(first.mapInArrow(apart, "cell long, name long")).distinct()


class RTree:
    """Points of group counts in boxes of boxes, each with its greatest counts and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        # neighbours in the order of size and of the largest groups tend to be alike
        self.order = np.lexsort((*points[:, :8].T, points.argmax(1), sizes)) if len(points) else np.zeros(0, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1:
            edge = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, edge, axis=0), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The points whose overlap with this one may suffice."""
        nodes = np.zeros(1, np.int64) if self.levels else np.arange(len(self.order))
        for depth in reversed(range(len(self.levels))):
            top, low, high = self.levels[depth]
            nodes = nodes[self._may(np.minimum(top[nodes], point).sum(1, dtype=np.int64), size, low[nodes], high[nodes], percent)]
            nodes = (nodes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < (len(self.levels[depth - 1][1]) if depth else len(self.order))]
        at = self.order[nodes]
        n = self.sizes[at]
        return at[self._may(np.minimum(self.points[at], point).sum(1, dtype=np.int64), size, n, n, percent)]

    @staticmethod
    def _may(overlap, size: int, low, high, percent: int) -> np.ndarray:
        """Whether 100 * overlap >= percent * union can hold for a size from low to high."""
        return (overlap * (100 + percent) >= percent * (size + low)) & (high * 100 >= percent * size) & (low * percent <= 100 * size)


def candidates(rooted: DataFrame, points: DataFrame, kind: str, percent: int) -> DataFrame:
    """a, b for the pairs of different components in each cell (cell, doc_id, root) that the
    R-tree leaves. points: doc_id, n_shingles, groups.

    The one pair of a cell of two has been looked at before. Of two components one isn't the cell's largest, so the classes of the others are the probes. Of
    two probes the one with the smaller id asks. A pair isn't looked at where a smaller cell is among the CARRIED
    smallest of both, as it meets there; cells are named by hashes, so of classes that share most of theirs some
    such cell is common, and others meet once for each cell that they share. A cell's
    points are indexed in parts of about POINTS classes, or POINT_BYTES of points, and its probes go to every part in
    blocks of that size. A tree holds points of one number of groups; of the others a probe meets those whose sizes allow it."""
    bytes_of = points.groupBy("doc_id").agg(F.sum(unpacked_bytes("n_shingles")).alias("bytes"))
    by_root = rooted.join(bytes_of, "doc_id").groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    mixed = by_root.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("most")).where("most.n < n and n > 2")
    parts = lambda n, size: F.greatest(F.ceil(n / POINTS), F.ceil(size / POINT_BYTES)).cast("int")
    mixed = written(mixed.select("cell", F.col("most.root").alias("most"), parts(F.col("n"), F.col("bytes")).alias("parts"), parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("blocks")), "mixed")
    inside = rooted.join(mixed, "cell")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cell"))
    carried = inside.select("doc_id", "cell").distinct().withColumn("place", place).where(F.col("place") <= CARRIED).groupBy("doc_id").agg(F.collect_list("cell").alias("less"))
    members = inside.join(points, "doc_id").join(carried, "doc_id").withColumn("less", F.expr("filter(less, c -> c < cell)")).withColumn("asks", F.expr("root <> most"))
    index = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    probes = members.where("asks").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "doc_id"), "blocks").cast("int")).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
    names = ["doc_id", "root", "n_shingles", "groups", "less", "asks"]

    def probe(points: pa.Table, probes: pa.Table) -> pa.Table:
        a, b = [], []
        if points.num_rows and probes.num_rows:
            ids, roots, asks = (points[c].to_pylist() for c in ("doc_id", "root", "asks"))
            sizes = points["n_shingles"].to_numpy()
            code = {r: i for i, r in enumerate(set(roots))}
            component = np.array([code[r] for r in roots], np.int64)
            holding: dict[int, list[int]] = {}
            for j, less in enumerate(points["less"].to_pylist()):
                for cell in less:
                    holding.setdefault(cell, []).append(j)
            holders = {cell: np.array(rows, np.int64) for cell, rows in holding.items()}
            indexed = matrices(points["groups"].to_pylist())
            flat: dict[tuple[int, int], np.ndarray] = {}
            trees: dict[tuple[int, int], RTree] = {}
            asking, root_of, size_of, less_of = (probes[c].to_pylist() for c in ("doc_id", "root", "n_shingles", "less"))
            for rows, counts in matrices(probes["groups"].to_pylist()):
                for k, (at, own) in enumerate(indexed):
                    n = min(counts.shape[1], own.shape[1])
                    low, high = int(sizes[at].min()), int(sizes[at].max())
                    for i, count in zip(rows.tolist(), folded(counts, n), strict=True):
                        x, size = asking[i], size_of[i]
                        if high * 100 < percent * size or low * percent > 100 * size:
                            continue
                        new = component != code.get(root_of[i], -1)
                        for cell in less_of[i]:
                            if cell in holders:
                                new[holders[cell]] = False
                        some = np.flatnonzero(new[at])
                        if not len(some):
                            continue
                        if (k, n) not in flat:
                            flat[k, n] = folded(own, n)
                        if len(some) > FEW:
                            if (k, n) not in trees:
                                trees[k, n] = RTree(flat[k, n], sizes[at])
                            near = at[trees[k, n].near(count, size, percent)]
                            near = near[new[near]]
                        else:
                            m = sizes[at[some]]
                            near = at[some[RTree._may(np.minimum(flat[k, n][some], count).sum(1, dtype=np.int64), size, m, m, percent)]]
                        for j in near.tolist():
                            if not (asks[j] and x > ids[j]):
                                a.append(min(x, ids[j]))
                                b.append(max(x, ids[j]))
        return pa.Table.from_arrays([pa.array(a, points["doc_id"].type), pa.array(b, points["doc_id"].type)], names=["a", "b"])

    keys = ["cell", "part", "block"]
    points, probes = (side.select(*[F.col(c).alias(c) for c in (*keys, *names)]) for side in (index, probes))
    return points.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(probe, f"a {kind}, b {kind}").distinct()


def possible(pairs: DataFrame, points: DataFrame, kind: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose points' overlap may suffice."""
    sides = [points.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("groups").alias(f"groups_{k}")) for k in "ab"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                overlap = common_most(*(some.column(c).to_pylist() for c in ("groups_a", "groups_b")))
                n, m = (some.column(c).to_numpy() for c in ("n_a", "n_b"))
                at = pa.array(np.flatnonzero(RTree._may(overlap, n, m, m, percent)))
                yield pa.RecordBatch.from_arrays([some.column("a").take(at), some.column("b").take(at)], names=["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(bound, f"a {kind}, b {kind}").distinct()


def finer(pairs: DataFrame, rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap may suffice by the finer counts too. An id with several texts
    has each of them compared."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    points = written(only(rows.select("doc_id", "n_shingles", "fine"), ids).dropDuplicates(), "fine")
    sides = [points.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("fine").alias(f"fine_{k}")) for k in "ab"]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = [
                i for i in range(batch.num_rows)
                if not (batch.column("fine_a")[i].is_valid and batch.column("fine_b")[i].is_valid)
                or RTree._may(fine_overlap(batch.column("fine_a")[i].as_py(), batch.column("fine_b")[i].as_py()), n[i], m[i], m[i], percent)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], names=["a", "b"])

    return written(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(bound, f"a {kind}, b {kind}").distinct(), "pairs")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose ids are in the table of different ids: by a broadcast if that has
    at most SMALL_BYTES, by a shuffle if it has more."""
    small = ids.count() * 32 <= SMALL_BYTES
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, kind: str, percent: int) -> DataFrame:
    """a, b, overlap, total (size of the union) of the pairs that link, by their texts."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = written(only(docs, ids), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the two texts of a pair stand next to each other
            n = batch.num_rows
            texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))[1::2]
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
                for _, data, off in slices(texts.slice(2 * i, 2 * (j - i)), 1 << 62):
                    h, of, length = shingles(data, off)
                    pair = of // 2
                    total = np.bincount(pair, minlength=j - i)
                    order = np.lexsort((h, pair))
                    h, pair = h[order], pair[order]
                    overlap = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=j - i)
                    ok = (100 * overlap >= percent * (total - overlap)) & (overlap > 0)
                    at = pa.array(np.flatnonzero(ok) + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(overlap[ok]), pa.array((total - overlap)[ok])], names=["a", "b", "overlap", "total"])
                i = j

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}, overlap long, total long")


def named(h: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k1, k2 (equal for equal sets) and name of n.size sets, from their shingles by text."""
    start, full = np.cumsum(n) - n, np.flatnonzero(n)
    k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full):
        k1[full], k2[full] = np.add.reduceat(mix(h), start[full]), np.add.reduceat(mix(h ^ GOLD), start[full])
    return k1, k2, mix(mix(k1 + n.astype(np.uint64)) + k2)


def overlaps(h: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of `left` has in common with each of `right`; h, row: the different shingles of each set."""
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    some = times[column] > 1
    column, row = shared[column[some]], row[some]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    m, last = max(left.max(), right.max()) + 1, int(column[-1]) + 1 if len(column) else 0
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((m, min(COLUMNS, last - c)), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        out += (x[left] @ x[right].T).astype(np.int64)
    return out


def blocks(docs: DataFrame, held: DataFrame, roots: DataFrame, kind: str) -> DataFrame:
    """bucket, i, j, side, root, class_id, name, n_rows, text: the classes of each component of several, in each of the
    pairs of blocks (i, j) that theirs is one of. Components of one block share buckets, with i and j -1."""
    twice = held.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class_id").alias("doc_id"))
    ids = written(roots.select(F.col("node").alias("doc_id")).union(twice).distinct(), "ids")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, off in slices(batch.column(1)):
                h, of, _ = shingles(data, off)
                n = np.bincount(of, minlength=len(off) - 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(n)) for c in batch.columns), pa.array(named(h, of, n)[2].view(np.int64))], names=["class_id", "text", "name"])

    texts = only(docs, ids).select("doc_id", "text").mapInArrow(name, f"class_id {kind}, text string, name long")
    classes = held.select("class_id", "name", "n_rows").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    rows = written(texts.join(classes, ["class_id", "name"]).dropDuplicates(["name"]), "classes")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int")
    large = written(rows.groupBy("root").agg(size.alias("parts")).where("parts > 1"), "large")
    n, length = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(1, ceil(n / SMALL_COMPONENTS), ceil((length or 0) / BLOCK_BYTES))
    # at most one of BLOCK classes, or of BLOCK_BYTES of text, is a large component
    rows = rows.join(F.broadcast(large) if large.count() * 32 <= SMALL_BYTES else large, "root", "left")
    small = rows.where("parts is null").withColumn("bucket", F.pmod(F.xxhash64(F.lit(2), "root"), F.lit(buckets))).withColumn("i", F.lit(-1)).withColumn("j", F.lit(-1)).withColumn("side", F.lit(0))
    cut = rows.where("parts is not null").withColumn("bucket", F.xxhash64("root")).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "name"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cut = cut.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).withColumn("side", F.when(F.col("part") == F.col("i"), 0).otherwise(1))
    names = ["bucket", "i", "j", "side", "root", "class_id", "name", "n_rows", "text"]
    return small.select(*names).unionByName(cut.select(*names))


def every(dealt: DataFrame, kind: str, percent: int, counted: bool) -> DataFrame:
    """name, n: how many rows the class links with in a pair of blocks; or, if not counted, a, b, overlap, total for every link."""
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("side", "ascending")])
        h, of, at = [], [], 0
        for chunk in table["text"].chunks:
            for a, data, off in slices(chunk):
                own_h, own_of, _ = shingles(data, off)
                h.append(own_h)
                of.append(own_of + at + a)
            at += len(chunk)
        h, of = np.concatenate(h), np.concatenate(of)
        n = np.bincount(of, minlength=len(table))
        start = np.concatenate([[0], np.cumsum(n)])
        root, side, rows, i, j = (table[c].combine_chunks() for c in ("root", "side", "n_rows", "i", "j"))
        root, side, rows = root.dictionary_encode().indices.to_numpy(), side.to_numpy(), rows.to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root))
        within = i[0].as_py() == j[0].as_py()
        links, found = np.zeros(len(table), np.int64), [[np.zeros(0, np.int64)] for _ in range(4)]
        for first, last in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            left = np.flatnonzero(side[first:last] == 0)
            right = left if within else np.flatnonzero(side[first:last] == 1)
            if not len(left) or not len(right):
                continue
            overlap = overlaps(h[start[first] : start[last]], of[start[first] : start[last]] - first, left, right)
            left, right = left + first, right + first
            total = n[left][:, None] + n[right] - overlap
            ok = (100 * overlap >= percent * total) & (overlap > 0)
            if within:
                ok = np.triu(ok, 1)
            links[left] += ok @ rows[right]
            links[right] += rows[left] @ ok
            x, y = np.nonzero(ok)
            for into, some in zip(found, (left[x], right[y], overlap[x, y], total[x, y]), strict=True):
                into.append(some)
        if counted:
            return pa.Table.from_arrays([table["name"], pa.array(links)], names=["name", "n"])
        x, y, overlap, total = (np.concatenate(f) for f in found)
        ids = table["class_id"].combine_chunks()
        x, y = ids.take(pa.array(x)), ids.take(pa.array(y))
        return pa.Table.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y), pa.array(overlap), pa.array(total)], names=["a", "b", "overlap", "total"])

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "name long, n long" if counted else f"a {kind}, b {kind}, overlap long, total long")


def joined(docs: DataFrame, percent: int = PERCENT, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text", every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id, component_id for every row; a, b, overlap, total for links between classes that
    span the components). every_link: the rows have their n_links too, and the links between classes are all there are."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(levels(counters(docs), heavy))  # 2 MB
    rows = written(sets(docs, kind, percent, common), "sets")
    keys = ["n_shingles", "k1", "k2"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    held = written(full.groupBy(*keys, "name").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows")), "held")
    members = written(rows.select("doc_id", *keys).join(held, keys, "left").select("doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("class_id", "name", "n_rows")]), "members")
    cell = written(cells(full, common).join(held.select("name", F.col("class_id").alias("doc_id")), "name").select("cell", "doc_id"), "cells")
    hub = written(cell.groupBy("cell").agg(F.min("doc_id").alias("a")), "hubs")
    star = written(cell.join(hub, "cell").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "star")
    # an id with several texts has a point for each
    points = written(only(full.select("doc_id", "n_shingles", "groups"), written(cell.select("doc_id").distinct(), "ids")).dropDuplicates(), "points")
    links = written(verified(finer(possible(star, points, kind, percent), full, kind, percent), docs, kind, percent), "links")
    # an id with several texts is in several classes, and links them
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id", "a")
    several = written(several.join(members.select("doc_id", F.col("class_id").alias("b")), "doc_id").select("a", "b"), "several")
    roots = components(links.select("a", "b").unionByName(several), kind)
    rooted = written(cell.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "rooted")
    more = finer(written(candidates(rooted, points, kind, percent), "pairs").join(star, ["a", "b"], "left_anti"), full, kind, percent)
    links = links.unionByName(written(verified(more, docs, kind, percent), "links"))
    roots = written(components(links.select("a", "b").unionByName(several), kind), "components")
    out = members.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    columns = ["doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("root", "class_id", "doc_id").alias("component_id")]
    if not every_link:
        return out.select(*columns), links.dropDuplicates(["a", "b"])
    dealt = blocks(docs, held, roots, kind)
    counts = written(every(dealt, kind, percent, True).groupBy("name").agg(F.sum("n").alias("n")), "counts")
    links = every(dealt, kind, percent, False).where("a <> b").dropDuplicates(["a", "b"])
    return out.join(counts, "name", "left").select(*columns, F.coalesce(F.col("n_rows") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).alias("n_links")), links


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, that with the smallest id, with the same columns; of
    repeated ids the row that sorts first. Rows without an id stay."""
    rows, _ = joined(docs, percent, id_col=id_col, text_col=text_col)
    rows = written(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("doc_id = component_id").select("doc_id", "n"), "kept")
    named = docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs
    once = only(named, rows.where("n = 1").select("doc_id"))
    (place,) = fresh(named, "place")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(q(c)) for c in named.columns]), F.col(q(text_col)))
    first = only(named, rows.where("n > 1").select("doc_id")).withColumn(place, F.row_number().over(order)).where(F.col(q(place)) == 1).drop(place)
    out = once.unionByName(first).unionByName(named.where(F.col("doc_id").isNull()))
    return out.select(*[(F.col("doc_id") if c == id_col else F.col(q(c))).alias(c) for c in docs.columns])

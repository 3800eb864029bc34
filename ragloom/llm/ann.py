"""Approximate nearest neighbours by cosine: low-dimensional stable projections in kd-trees.

Vectors are scaled to length 1 and projected onto `dims` Gaussian directions. The squared distance of two
projections over that of the vectors follows a chi-square law with `dims` degrees of freedom whatever the
vectors are. So a search takes vectors in the order of their projected distance, computes their cosine, and
stops when every one left lies so far that the chi-square probability of a projection that near,
were the vector as close as the k-th found, has passed `certainty`.

The table is cut into cells by a kd-tree over the projections, its splits fitted on at most `sample` rows,
the first by a hash of the id. A query is first run in its own cell; the distance found there
rules out most other cells by the same test on their bounding boxes, and only those left are searched.
In a cell a kd-tree of leaves of 64 vectors gives the incremental order. Cells that hold more rows than `cell_rows` are cut by a
hash of the id, and all of their parts are searched. Rows that repeat an id with the same vector are one, in the
table and among the queries. Of equal vectors only the k + 1 smallest different
ids are indexed, which are all that a result can hold; no other row is left out.

Vectors that are null, zero, or hold a null or a non-finite component take no part, nor does a null id. Vectors are compared with
those of the same length only. Equal scores go to the smaller id; a repeated id is one candidate per
different vector, but the hits of a query on one id with the same score, to `SAME`, are one. A query id with several vectors
has one result, the best hits of them all. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import written
from .textbytes import q

DIMS, CERTAINTY = 8, 0.95
SAMPLE, CELL_ROWS, LEAF, QUERY_ROWS = 20_000, 8192, 64, 8192
MOST_CELLS = 1 << 12
SAME = 1e-12  # by how much rounding may part the scores of parallel vectors


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 0.0
    for i in range(dims // 2):
        term = term * half / i if i else np.ones_like(half)
        total = total + term
    return 1 - np.exp(-half) * total


def radius(dims: int, certainty: float) -> float:
    """The squared projected distance, for a squared distance of 1, at which the search may stop."""
    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < certainty else (low, mid)
    return high


def directions(length: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dims))


def vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, seed: int) -> DataFrame:
    """id, size, vec (packed doubles), proj (array of doubles) of the rows that take part."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(q(id_col)).alias("id"), F.col(q(vector_col)).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = values[starts[at][:, None] + np.arange(n)]
                top = np.abs(x).max(1)
                ok = np.isfinite(top) & (top > 0)
                at, x = at[ok], np.ascontiguousarray(x[ok])
                if len(at):
                    scaled = x / top[ok][:, None]
                    unit = scaled / np.sqrt((scaled * scaled).sum(1))[:, None]
                    proj = unit @ directions(int(n), dims, seed)
                    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * n * 8).astype(np.int32)), pa.py_buffer(x)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), packed, pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dims, pa.int32()), pa.array(proj.ravel()))], names=["id", "size", "vec", "proj"])

    return rows.mapInArrow(project, f"id {kind}, size int, vec binary, proj array<double>")


def matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of doubles from a column of packed or of array values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, width or 0))


@dataclass
class Tree:
    """The top of the kd-tree: for each vector length, splits in heap order."""

    splits: dict[int, list[tuple[int, float]]]

    def cell(self, size: int, proj: np.ndarray) -> np.ndarray:
        node, splits = np.zeros(len(proj), np.int64), self.splits.get(size, [])
        dim, value = (np.array(x) for x in zip(*splits, strict=True)) if splits else (np.zeros(0), np.zeros(0))
        while len(splits) and (inner := np.flatnonzero(node < len(splits))).size:
            n = node[inner]
            node[inner] = 2 * n + 1 + (proj[inner, dim[n].astype(int)] > value[n])
        return size * (4 * MOST_CELLS) + node

    @staticmethod
    def fit(sample: list[tuple[int, np.ndarray]], total: int, cell_rows: int) -> "Tree":
        out = {}
        n = sum(len(p) for _, p in sample)
        for size, points in sample:
            cells = min(MOST_CELLS, max(1, len(points) // 8), math.ceil(total * len(points) / max(n, 1) / cell_rows))
            depth = max(0, math.ceil(math.log2(cells)))
            splits, groups = [], [points]
            for _ in range(depth):
                nxt = []
                for g in groups:
                    d = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
                    v = float(np.median(g[:, d])) if len(g) else 0.0
                    splits.append((d, v))
                    nxt += [g[g[:, d] <= v], g[g[:, d] > v]]
                groups = nxt
            out[size] = splits
        return Tree(out)


def in_cell(tree: Tree, df: DataFrame) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, proj = batch.column("size").to_numpy(), matrix(batch.column("proj"))
            cell = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes):
                at = sizes == n
                cell[at] = tree.cell(int(n), proj[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(assign, f"{kinds}, cell long")


class Leaves:
    """The bottom of the kd-tree: the points in runs of at most LEAF, and the runs' bounding boxes."""

    def __init__(self, proj: np.ndarray, leaf: int = LEAF):
        runs, todo = [], [np.arange(len(proj))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                runs.append(at)
                continue
            p = proj[at]
            d = int(np.argmax(p.max(0) - p.min(0)))
            order = np.argpartition(p[:, d], len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.runs = runs
        self.low = np.array([proj[r].min(0) for r in runs])
        self.high = np.array([proj[r].max(0) for r in runs])


def gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to about 1: cosines stay the same to the last
    bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def different(of: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The places of one hit for each number in `of` and score."""
    order = np.lexsort((-score, of))
    o, s = of[order], score[order]
    once = np.ones(len(order), bool)
    once[1:] = (o[1:] != o[:-1]) | (s[:-1] - s[1:] > SAME)
    return order[once]


def search(ids: np.ndarray, x: np.ndarray, proj: np.ndarray, q_ids: np.ndarray, qx: np.ndarray, q_proj: np.ndarray, known: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, row's number, cosine) of the nearest found for each query. known: the k-th
    cosine that each has already."""
    x, qx = scaled(x), scaled(qx)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    q_norm = np.sqrt((qx * qx).sum(1))
    named, code = np.unique(ids, return_inverse=True)
    repeats = len(named) < len(ids)
    leaves = Leaves(proj)
    far = gap(q_proj, leaves.low, leaves.high)
    order = np.argsort(far, axis=1)
    out: list[tuple[int, np.ndarray]] = []
    for i in range(len(qx)):
        near, seen, best, bound, j, step = order[i], [], [], known[i], 0, 4
        u = qx[i] / q_norm[i]
        while j < len(near):
            # squared distance of unit vectors by their cosine
            if far[i, near[j]] > stop * max(2 - 2 * bound, 1e-12):
                break
            at = np.concatenate([leaves.runs[r] for r in near[j : j + step]])
            at = at[ids[at] != q_ids[i]]
            seen.append(at)
            best.append(unit[at] @ u)
            j, step = j + step, step * 2
            score = np.concatenate(best)
            if repeats:
                score = score[different(code[np.concatenate(seen)], score)]
            if len(score) >= k:
                bound = max(bound, float(np.partition(score, len(score) - k)[len(score) - k]))
        if seen:
            at, score = np.concatenate(seen), np.concatenate(best)
            if repeats:
                once = different(code[at], score)
                at, score = at[once], score[once]
            # rounding of the matrix product must not decide a tie
            out.append((i, at[score >= min(bound, np.partition(score, len(score) - k)[len(score) - k]) - 1e-9] if len(score) > k else at))
    a = np.concatenate([np.full(len(at), i) for i, at in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([at for _, at in out]) if out else np.zeros(0, np.int64)
    score = (qx[a] * x[b]).sum(1) / (q_norm[a] * np.sqrt((x * x).sum(1))[b])
    if repeats:
        once = different(a * len(named) + code[b], score)
        a, b, score = a[once], b[once], score[once]
    rank = np.lexsort((ids[b], -score, a))
    a, b, score = a[rank], b[rank], score[rank]
    first = np.searchsorted(a, a, "left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], score[keep]


def met(index: DataFrame, cells: DataFrame, visits: DataFrame, kind: str, dims: int, k: int, stop: float) -> DataFrame:
    """query_id, vec_id, score of what each visit (query_id, cell, vec, proj, known) finds."""
    blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    # the broadcasts have one row for each of at most MOST_CELLS cells and vector length
    cells = F.broadcast(cells.join(blocks, "cell").select("cell", "parts", "blocks"))
    left = index.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("parts", "blocks", "size")
    right = visits.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts", "blocks")

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        ids = rows["id"].combine_chunks()
        q_ids = queries["query_id"].combine_chunks()
        if not len(ids) or not len(q_ids):
            return pa.Table.from_arrays([q_ids[:0], ids[:0], pa.array([], pa.float64())], names=names)
        rows_x, rows_p, queries_x, queries_p = matrix(rows["vec"]), matrix(rows["proj"]), matrix(queries["vec"]), matrix(queries["proj"])
        a, b, score = search(ids.to_numpy(zero_copy_only=False), rows_x, rows_p, q_ids.to_numpy(zero_copy_only=False), queries_x, queries_p, queries["known"].to_numpy(), k, stop)
        return pa.Table.from_arrays([q_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], names=names)

    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {kind}, vec_id {kind}, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    hits = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"))
    found = found.withColumn("above", F.lag("score").over(hits)).where(F.col("above").isNull() | (F.col("above") - F.col("score") > SAME)).drop("above")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(df: DataFrame, queries: Column, k: int = 5, dims: int = DIMS, certainty: float = CERTAINTY, seed: int = 0, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all rows for each row for which `queries` holds."""
    from pyspark.sql import Window

    kind = df.schema[id_col].dataType.simpleString()
    stop = radius(dims, certainty)
    equal = Window.partitionBy("size", F.xxhash64("vec"), "vec").orderBy("id")
    rows = vectors(df, id_col, vector_col, dims, seed).dropDuplicates(["id", "size", "vec"])
    rows = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy")
    got = rows.select("id", "size", "proj").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toArrow()
    total = df.count()
    sizes, points = got["size"].to_numpy(), matrix(got["proj"], dims)
    tree = Tree.fit([(int(n), points[sizes == n]) for n in np.unique(sizes)], total, cell_rows)
    index = written(in_cell(tree, rows), "ann")
    boxes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), *[f(F.col("proj")[d]).alias(f"{s}{d}") for d in range(dims) for f, s in ((F.min, "l"), (F.max, "h"))])
    known_cells = boxes.toArrow()  # one row for each cell: at most MOST_CELLS for a vector length
    spark = df.sparkSession
    parts = [(int(c), max(1, math.ceil(n / (2 * cell_rows)))) for c, n in zip(known_cells["cell"].to_pylist(), known_cells["n"].to_pylist(), strict=True)]
    cells = spark.createDataFrame(parts, "cell long, parts int")
    cell_ids, cell_sizes = known_cells["cell"].to_numpy(), known_cells["size"].to_numpy()
    low, high = (np.array([known_cells[f"{s}{d}"].to_numpy() for d in range(dims)]).T.reshape(-1, dims) for s in "lh")

    asked = in_cell(tree, vectors(df.where(queries), id_col, vector_col, dims, seed).dropDuplicates(["id", "size", "vec"])).withColumnRenamed("id", "query_id")
    first = written(best(met(index, cells, asked.withColumn("known", F.lit(-2.0)).drop("size"), kind, dims, k, stop), k), "ann-first")
    # with fewer than k found, no distance is known and all cells are searched
    bound = first.groupBy("query_id").agg(F.min("score").alias("found"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("found")).alias("found"))
    asked = asked.join(bound, "query_id", "left").withColumn("known", F.coalesce("found", F.lit(-2.0))).drop("found")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                near = gap(matrix(some.column("proj")), low, high) <= stop * np.maximum(2 - 2 * some.column("known").to_numpy(), 1e-12)[:, None]
                near &= (cell_ids != some.column("cell").to_numpy()[:, None]) & (cell_sizes == some.column("size").to_numpy()[:, None])
                row, col = np.nonzero(near)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(at), some.column("vec").take(at), some.column("proj").take(at), some.column("known").take(at), pa.array(cell_ids[col])], names=["query_id", "vec", "proj", "known", "cell"])

    visits = asked.mapInArrow(others, f"query_id {kind}, vec binary, proj array<double>, known double, cell long")
    second = met(index, cells, visits, kind, dims, k, stop)
    return best(first.select("query_id", "vec_id", "score").unionByName(second), k).select("query_id", "rank", "vec_id", "score")

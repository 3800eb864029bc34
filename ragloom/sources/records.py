"""Records of one large text file read by several tasks.

CSV fields may hold line breaks and a JSON file may be one array, so neither can be cut at line
ends. Here Spark's text source cuts a file into its usual byte ranges at a one-byte separator (a line
break for CSV, a closing brace for JSON) on any file system, and each range is scanned as a state
machine whose starting state is known:

1. a first pass sums up each range (the parity of its quotes, and for JSON, with the parity known,
   its change of depth); these sums compose, so a running total over the ranges gives the state in
   which each one starts. There is one row per range of ``spark.sql.files.maxPartitionBytes``.
2. a second pass runs through each range from that state with numpy over the bytes of an Arrow
   batch. Records that begin and end in a range come out whole; what is left at its ends
   comes out as fragments, at most two per range, which are joined across ranges.

Records carry ``file``, ``block`` (the range's first byte) and ``pos`` (a place within it), which
sort them in file order. The second pass is written under the checkpoint folder, since its
records and its fragments are read apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

WHOLE, BEGUN, GOES_ON, SECTION = 0, 1, 2, 3  # kinds of rows of the second pass
_OUT = "file long, block long, pos long, kind int, section string, text string"
_KEY = re.compile(rb'"([^"\\]*)"\s*:\s*$')


def _lines(spark: SparkSession, path, sep: str) -> DataFrame:
    rows = spark.read.option("lineSep", sep).text(path)
    return rows.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"),
                       F.col("_metadata.file_block_start").alias("block"))


def _before(value: str):
    """The total of the file's earlier ranges."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of one range that stand together."""
    file, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("file", "block"))
    cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


class _Range:
    """The scan of one range: whether it is inside a record, that record's text so far, and the rows
    found."""

    def __init__(self, file: int, block: int, inside: bool):
        self.file, self.block = file, block
        self.begun, self.held, self.pos = False, [] if not inside else [b""], 0
        self.inside = inside
        self.out: list[tuple] = []

    def row(self, kind: int, text: bytes | None, section: str | None = None) -> None:
        self.out.append((self.file, self.block, self.pos, kind, section, None if text is None else text.decode("utf-8", "replace")))
        self.pos += 1

    def close(self, text: bytes, section: str | None = None) -> None:
        """The record that was open ends."""
        self.row(WHOLE if self.begun else GOES_ON, b"".join([*self.held, text]), section)
        self.held, self.inside, self.begun = [], False, False

    def finish(self, section: str | None = None) -> None:
        """The range ends."""
        if self.inside:
            self.row(BEGUN if self.begun else GOES_ON, b"".join(self.held), section)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["file", "block", "pos", "kind", "section", "text"])


def _joined(found: DataFrame, glue: str) -> DataFrame:
    """(file, block, pos, section, text): whole records, and those joined from fragments."""
    whole = found.filter(F.col("kind") == WHOLE).select("file", "block", "pos", "section", "text")
    pieces = found.filter(F.col("kind").isin(BEGUN, GOES_ON))  # at most two per range
    begun = F.col("kind") == BEGUN
    w = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, 0)
    one = pieces.withColumn("record", F.sum(begun.cast("int")).over(w)).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "pos", "section", "text"))).alias("p"))
    return whole.unionByName(one.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["pos"].alias("pos"),
                                        F.col("p")[0]["section"].alias("section"),
                                        F.array_join(F.col("p.text"), glue).alias("text")))


# ------------------------------------------------------------------ CSV
def csv_records(spark: SparkSession, path) -> DataFrame:
    """(file, name, block, pos, text): the records of CSV files without their header records and
    without empty ones; a line break inside quotes belongs to its record."""
    lines = _lines(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "name", "block").agg(F.sum(quotes).alias("n"))
    ranges = _stored(ranges.withColumn("odd", (_before("n") % 2).cast("int")).drop("n"), "csv-ranges")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Range | None = None
        for batch in batches:
            done = []
            for a, b in _runs(batch):
                file, block = batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                if at is None or (at.file, at.block) != (file, block):
                    if at is not None:
                        at.finish()
                        done += at.out
                    at = _Range(file, block, bool(batch.column(3)[a].as_py()))
                    at.held = []
                values = batch.column(0).slice(a, b - a)
                odd = pc.count_substring(values, '"').to_numpy() % 2
                inside = (np.cumsum(odd) + at.inside) % 2  # after each line
                for text, open_after in zip(values.to_pylist(), inside.tolist(), strict=True):
                    if open_after:
                        if not at.inside:
                            at.inside, at.begun, at.held = True, True, []
                        at.held.append(text.encode() + b"\n")
                    elif at.inside:
                        at.close(text.encode())
                    else:
                        at.row(WHOLE, text.encode())
                done += at.out
                at.out = []
            yield _batch(done)
        if at is not None:
            at.finish()
            yield _batch(at.out)

    ready = lines.drop("name").join(F.broadcast(ranges.select("file", "block", "odd")), ["file", "block"]).select("value", "file", "block", "odd")
    found = _stored(ready.mapInArrow(scan, _OUT), "csv-records")
    # pieces but the last end with their line break
    records = _joined(found, "").withColumn("text", F.regexp_replace("text", "\r$", ""))
    names = ranges.select("file", "name").distinct()
    first = records.groupBy("file").agg(F.min(F.struct("block", "pos")).alias("head"))
    records = records.join(F.broadcast(first), "file").filter(F.struct("block", "pos") > F.col("head")).drop("head")
    return records.join(F.broadcast(names), "file").filter(F.length("text") > 0).select("file", "name", "block", "pos", "text")


# ------------------------------------------------------------------ JSON
def _shape(data: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Opening (+1) and closing (-1) brackets outside strings, the bytes that lie in strings, and the
    parity of quotes at the end."""
    quote, slash = data == 34, data == 92
    near = np.flatnonzero(quote[1:] & slash[:-1]) + 1
    if len(near):  # a quote after an odd run of backslashes ends no string
        other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        quote[near[(near - 1 - other[near - 1]) % 2 == 1]] = False
    within = ((np.cumsum(quote) + odd) % 2).astype(bool)
    step = ((data == 123) | (data == 91)).astype(np.int8) - ((data == 125) | (data == 93))
    step[within] = 0
    return step, within, (odd + int(quote.sum())) % 2


def _bytes(values: pa.Array) -> np.ndarray:
    """The separator after each value, end to end."""
    joined = pc.binary_join_element_wise(values, pa.scalar("}", values.type), pa.scalar("", values.type))
    off = np.frombuffer(joined.buffers()[1], np.int32 if joined.type == pa.string() else np.int64)
    return np.frombuffer(joined.buffers()[2], np.uint8)[off[joined.offset] : off[joined.offset + len(joined)]]


def json_elements(spark: SparkSession, path, depth: int) -> DataFrame:
    """(file, name, block, pos, section, text): the objects that lie ``depth`` brackets deep in each JSON
    document of ``path``: 1 for the elements of a top-level array, 2 for those of the arrays that are the
    values of a top-level object, whose key is the ``section``."""
    lines = _lines(spark, path, "}")
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "name", "block").agg(F.sum(quotes).alias("n"))
    parity = _stored(parity.withColumn("odd", (_before("n") % 2).cast("int")).drop("n"), "json-parity")

    def deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd: dict[tuple, int] = {}
        for batch in batches:
            found = []
            for a, b in _runs(batch):
                key = batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                step, _, odd_after = _shape(_bytes(batch.column(0).slice(a, b - a)), odd.get(key, batch.column(3)[a].as_py()))
                odd = {key: odd_after}
                found.append((*key, int(step.sum(dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["file", "block", "d"])

    def ready(state: DataFrame, *columns: str) -> DataFrame:
        return lines.drop("name").join(F.broadcast(state.select("file", "block", *columns)), ["file", "block"]).select("value", "file", "block", *columns)

    change = ready(parity, "odd").mapInArrow(deltas, "file long, block long, d long").groupBy("file", "block").agg(F.sum("d").alias("d"))
    state = parity.join(change, ["file", "block"])
    state = _stored(state.withColumn("deep", _before("d").cast("int")).drop("d"), "json-ranges")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Range | None = None
        odd = deep = 0
        section: str | None = None
        for batch in batches:
            done = []
            for a, b in _runs(batch):
                file, block = batch.column(1)[a].as_py(), batch.column(2)[a].as_py()
                if at is None or (at.file, at.block) != (file, block):
                    if at is not None:
                        at.finish(section)
                        done += at.out
                    odd, deep, section = batch.column(3)[a].as_py(), batch.column(4)[a].as_py(), None
                    at = _Range(file, block, deep > depth)
                data = _bytes(batch.column(0).slice(a, b - a))
                step, _, odd = _shape(data, odd)
                after = deep + np.cumsum(step, dtype=np.int64)
                events = np.flatnonzero(((step > 0) & ((after == depth + 1) | (after == depth))) | ((step < 0) & (after == depth)))
                raw, start = data.tobytes(), 0
                for i in events.tolist():
                    if step[i] > 0 and after[i] == depth + 1:
                        at.inside, at.begun, at.held, start = True, True, [], i
                    elif step[i] > 0:
                        key = _KEY.search(raw, max(0, i - 1000), i)
                        section = key[1].decode() if key else None
                        at.row(SECTION, None, section)
                    elif at.inside:
                        at.close(raw[start : i + 1], section)
                if at.inside:
                    at.held.append(raw[start:])
                deep = int(after[-1]) if len(after) else deep
                done += at.out
                at.out = []
            yield _batch(done)
        if at is not None:
            at.finish(section)
            yield _batch(at.out)

    found = _stored(ready(state, "odd", "deep").mapInArrow(scan, _OUT), "json-elements")
    # the section that was open when a range began
    last = found.filter(F.col("kind") == SECTION).groupBy("file", "block").agg(F.max_by("section", "pos").alias("opened"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = state.join(last, ["file", "block"], "left").withColumn("carried", F.last("opened", ignorenulls=True).over(w))
    out = _joined(found, "").join(F.broadcast(carried.select("file", "block", "name", "carried")), ["file", "block"])
    return out.select("file", "name", "block", "pos", F.coalesce("section", "carried").alias("section"), "text")

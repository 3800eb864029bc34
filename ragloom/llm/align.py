"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

A text, led by a space, is encoded by a byte-level BPE of the tokenizers library (A); the text itself by a sentencepiece
model that puts the space before it (B). Every token covers a range of bytes. The tokens of both are sorted by start,
the greatest end so far is carried along, and a group breaks where a start reaches it: so the groups are cut at the
byte offsets where both have a token's end. Within a group every token of A is linked with every token of B.

1. One pass over the texts finds the groups and each document's different linked id pairs with the number of their
   links. A group's links are expanded from its different ids with their counts, in blocks, so that a long run
   without a common end costs its different ids and not the square of its tokens. A long text is grouped in runs.
2. In how many documents each pair is linked: tasks count pairs in arrays of bounded size, Spark adds them up. The table
   has at most one row for each pair of vocabulary entries.
3. A second pass, over the written pairs, sums the counts and the links whose pair is its A id's most frequent. The pairs
   found in most documents, at most 2**20 by a histogram of the counts, are sent to every executor; links of all
   the other pairs meet their counts in a shuffle, in which no pair is frequent.

Defined results: texts that are null or empty, and those of which either tokenizer's bytes differ from a space and the text
(unknown characters, or one that stands for a space), have no tokens: zeros and an empty groups text. Every row is a
document, also with a null or repeated id. Other columns are kept; the columns added get a longer name where theirs is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import written
from .textbytes import appended, fresh, q, slices, widened
from .tokens import Encoder, Known, Rows, spread

SENT = 1 << 20  # pairs sent to every executor, 12 bytes each
LONG = 2 << 20  # bytes of a text beyond which it is grouped in runs
BLOCK = 1 << 21  # links, or pairs to be counted, that are held at once
LOOKED_UP = 1 << 18  # pairs whose counts are looked up at once
_LOADED: dict[tuple[str, str], "Aligner"] = {}


class Pieces(Encoder):
    """Ids of texts that begin with a space by a sentencepiece model that puts that space there itself.

    Where no piece holds a space but at its start, a cut before a space that follows another character lies between two
    pieces, as pieces grow by joining neighbours into longer pieces of the vocabulary. So each different run
    is encoded once; models with other pieces get every text whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(self.size)]
        self.raw = [bytes([int(n[3:5], 16)]) if m.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = m.piece_to_id("▁")
        self.by_piece = not any("▁" in n.lstrip("▁") for n in names)
        self.known = Known()

    def pieces(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        at = data == 0x20
        at[1:] &= data[:-1] != 0x20
        at[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(at)

    def _new(self, raw: list[bytes]) -> list[np.ndarray]:
        return self.whole([r.decode() for r in raw])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        ids = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array([self.space] if t == " " else i, np.uint32) for t, i in zip(texts, ids, strict=True)]


def byte_level(encoder: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    out = [b""] * len(encoder.opens)
    for token, i in encoder.tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def table(tokens: list[bytes]) -> Rows:
    out = Rows(np.uint8)
    out.add(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64))
    return out


def same(ids: np.ndarray, off: np.ndarray, raw: Rows, data: np.ndarray, text_off: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their ids equal."""
    lengths = raw.lengths(ids.astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ok = np.diff(ends[off]) == np.diff(text_off)
    some = np.flatnonzero(ok & (np.diff(text_off) > 0))
    if len(some):
        mine = raw.take(ids[spread(off[some], np.diff(off)[some])].astype(np.int64))
        sizes = np.diff(text_off)[some]
        ok[some] = np.logical_and.reduceat(mine == data[spread(text_off[some], sizes)], np.cumsum(sizes) - sizes)
    return ok


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and the sum of each one's weights."""
    order = keys.argsort(kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def linked(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, of_doc: np.ndarray, size_b: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document << bits | a * size_b + b) of every linked pair of ids, and its number of links."""
    wide = np.int64(max(int(a.max(initial=0)), int(b.max(initial=0))) + 1)
    ka, na = counted(group_a * wide + a, np.ones(len(a), np.int64))
    kb, nb = counted(group_b * wide + b, np.ones(len(b), np.int64))
    ga, ia, gb, ib = ka // wide, ka % wide, kb // wide, kb % wide
    start, end = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    each = end - start
    upto = np.cumsum(each)
    keys, weights, x = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while x < len(ka):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + BLOCK, "right")))
        left = np.repeat(np.arange(x, y), each[x:y])
        right = spread(start[x:y], each[x:y])
        key = (of_doc[ga[left]] << bits) | (ia[left] * size_b + ib[right])
        keys, weights = counted(np.concatenate([keys, key]), np.concatenate([weights, na[left] * nb[right]]))
        x = y
    return keys, weights


class Aligner:
    """Both tokenizers; one for each pair of files and Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), Pieces(path_b)
        raw_a = byte_level(self.a)
        self.raw_a, self.raw_b = table(raw_a), table(self.b.raw)
        self.size_a, self.size_b = len(raw_a), self.b.size
        self.bits = (self.size_a * self.size_b).bit_length()
        # every id in decimal before each of the marks that may follow it
        self.names = [np.array([f"{i}{mark}" for i in range(max(self.size_a, self.size_b))], object) for mark in ",|;"]

    def groups(self, data: np.ndarray, off: np.ndarray) -> dict:
        """Of the texts of a slice, each led by a space or empty: columns by text, and their linked pairs."""
        n = len(off) - 1
        (_, ids_a, off_a), (_, ids_b, off_b) = (self._ids(e, data, off) for e in (self.a, self.b))
        ok = same(ids_a, off_a, self.raw_a, data, off) & same(ids_b, off_b, self.raw_b, data, off)
        sides = []
        for ids, at, raw in ((ids_a, off_a, self.raw_a), (ids_b, off_b, self.raw_b)):
            keep = spread(at[:-1][ok], np.diff(at)[ok])
            ids, doc = ids[keep].astype(np.int64), np.repeat(np.flatnonzero(ok), np.diff(at)[ok])
            size = raw.lengths(ids)
            ends = np.cumsum(size)
            sides.append((ids, doc, ends - size, ends))  # in the bytes of the texts that are left
        (a, doc_a, start_a, end_a), (b, doc_b, start_b, end_b) = sides
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        order = np.lexsort((side, start))
        furthest = np.maximum.accumulate(end[order]) if len(order) else end
        breaks = np.ones(len(order), bool)
        breaks[1:] = start[order][1:] >= furthest[:-1]
        group = np.zeros(len(order), np.int64)
        group[order] = np.cumsum(breaks) - 1
        group_a, group_b = group[: len(a)], group[len(a) :]
        many = int(breaks.sum())
        in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        of_doc = np.zeros(many, np.int64)
        of_doc[group_a] = doc_a
        upto = np.concatenate([[0], np.cumsum(in_a * in_b)])  # groups ascend by text
        at = np.searchsorted(of_doc, np.arange(n + 1))
        keys, weights = linked(group_a, a, group_b, b, of_doc, self.size_b, self.bits)
        cut = np.searchsorted(keys >> self.bits, np.arange(n + 1))
        return {
            "ok": ok,
            "n_a": np.bincount(doc_a, minlength=n),
            "n_b": np.bincount(doc_b, minlength=n),
            "n_groups": np.bincount(of_doc, minlength=n),
            "n_links": np.diff(upto[at]),
            "groups": self._texts(np.concatenate([a, b]), group, side, np.concatenate([doc_a, doc_b]), start, n),
            "pairs": (keys & ((1 << self.bits) - 1), cut),
            "weights": (weights, cut),
        }

    def long_text(self, data: np.ndarray, most: int) -> dict:
        """The same of one long text, from runs of about `most` bytes. A run begins at a space before which both
        tokenizers end a token, so no group reaches over its start."""
        off = np.array([0, len(data)], np.int64)
        if not (self.a.by_piece and self.b.by_piece):
            return self.groups(data, off)
        safe = np.intersect1d(self.a.pieces(data, off), self.b.pieces(data, off))
        cuts = np.unique(safe[np.searchsorted(safe, np.arange(0, len(data), most)).clip(max=len(safe) - 1)])
        out: dict = {}
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(data)], strict=True):
            g = self.groups(data[i:j], np.array([0, j - i], np.int64))
            if not g["ok"][0]:
                return g
            if not out:
                out, texts = g, [g["groups"][0]]
                continue
            texts.append(g["groups"][0])
            for c in COUNTS:
                out[c] = out[c] + g[c]
            keys, weights = counted(*(np.concatenate([out[c][0], g[c][0]]) for c in ("pairs", "weights")))
            cut = np.array([0, len(keys)])
            out["pairs"], out["weights"] = (keys, cut), (weights, cut)
        return {**out, "groups": [";".join(texts)]}

    def _ids(self, encoder: Encoder, data: np.ndarray, off: np.ndarray) -> tuple:
        if encoder.by_piece:
            return (0, *encoder._slice(data, off))
        raw = data.tobytes()
        ids = encoder.whole([raw[i:j].decode() for i, j in zip(off.tolist(), off[1:].tolist(), strict=False)])
        lengths = [len(x) if j > i else 0 for x, i, j in zip(ids, off, off[1:], strict=False)]
        return 0, np.concatenate([*(x[:k] for x, k in zip(ids, lengths, strict=True)), np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def _texts(self, ids, group, side, doc, start, n) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text."""
        order = np.lexsort((start, side, group))
        ids, group, side, doc = ids[order], group[order], side[order], doc[order]
        last = np.ones(len(ids), bool)  # of its side of the group
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        parts = self.names[0][ids]
        for mark, flags in ((1, last & (side == 0)), (2, last & (side == 1))):
            parts[flags] = self.names[mark][ids[flags]]
        cut, parts = np.searchsorted(doc, np.arange(n + 1)), parts.tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


def loaded(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def numbers(flat: np.ndarray, off: np.ndarray, kind: str) -> pa.Array:
    """Rows of numbers as binary."""
    width = np.dtype(kind).itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat.astype(kind)))]).cast(pa.binary())


def values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, and each row's first."""
    column = column.cast(pa.large_binary())
    width = np.dtype(kind).itemsize
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // width
    flat = np.frombuffer(column.buffers()[2], np.uint8)[off[0] * width : off[-1] * width].view(kind) if off[-1] > off[0] else np.zeros(0, kind)
    return flat, off - off[0]


def led(texts: pa.Array) -> pa.Array:
    """A space before every text that has characters; empty where there are none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), spaced)


def in_parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` pairs, or of one row."""
    upto = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy().astype(np.int64) // 8)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


# ------------------------------------------------------------------ the operator
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def grouped(df: DataFrame, path_a: str, path_b: str, text_col: str, names: dict[str, str], keep_groups: bool) -> DataFrame:
    """First pass: the text's counts, the digest (and text, if kept) of its groups, and its linked pairs."""
    left = df.drop(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(path_a, path_b)
        for b in batches:
            rest = b.select([n for n in b.schema.names if n != text_col])
            for at, data, off in slices(led(b.column(b.schema.get_field_index(text_col))), LONG // 2):
                g = aligner.groups(data, off) if len(data) <= LONG or len(off) > 2 else aligner.long_text(data, LONG // 2)
                texts = g["groups"]
                columns = {names[c]: pa.array(g[c], pa.int64()) for c in COUNTS}
                columns[names["groups_sha256"]] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())
                if keep_groups:
                    columns[names["groups"]] = pa.array(texts, pa.string())
                columns[names["pairs"]] = numbers(*g["pairs"], "<u8")
                columns[names["weights"]] = numbers(*g["weights"], "<u8")
                yield appended(rest.slice(at, len(off) - 1), **columns)

    kinds = {names[c]: "long" for c in COUNTS} | {names["groups_sha256"]: "string"} | ({names["groups"]: "string"} if keep_groups else {}) | {names["pairs"]: "binary", names["weights"]: "binary"}
    return df.mapInArrow(rows, widened(left, kinds))


def pair_counts(found: DataFrame, pairs: str, size_b: int) -> DataFrame:
    """pair (a * size_b + b), n: documents that hold it linked, best: whether n is the highest of its A id."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([np.zeros(0, np.int64), *waiting])
            return counted(np.concatenate([keys, new]), np.concatenate([n, np.ones(len(new), np.int64)]))

        for b in batches:
            flat, _ = values(b.column(0), "<u8")
            for a in range(0, len(flat), BLOCK):
                part = flat[a : a + BLOCK].astype(np.int64)
                waiting.append(part)
                held += len(part)
                if held >= BLOCK:
                    (keys, n), waiting, held = merged(), [], 0
                    if len(keys) >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                        keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    counts = written(found.select(pairs).mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most `most` pairs are in so many documents."""
    level = {r.level: r["count"] for r in counts.groupBy(F.expr("length(bin(n))").alias("level")).count().collect()}
    total = 0
    for k in sorted(level, reverse=True):  # at most 63
        total += level[k]
        if total > most:
            return 1 << k
    return 1


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", most_sent: int = SENT, keep_groups: bool = False) -> DataFrame:
    """The table without its text, with `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum` (long) and
    `groups_sha256`; with `keep_groups` also `groups`, the text that the digest is of."""
    wanted = [*COUNTS, "n_best", "count_sum", "groups_sha256", "groups", "pairs", "weights", "row"]
    names = dict(zip(wanted, fresh(df.drop(text_col), *wanted), strict=True))
    spark = df.sparkSession
    found = written(grouped(df, path_a, path_b, text_col, names, keep_groups).withColumn(names["row"], F.monotonically_increasing_id()), "groups")
    pairs, weights, row = names["pairs"], names["weights"], names["row"]
    counts = written(pair_counts(found, q(pairs), loaded(path_a, path_b).size_b), "pair-table")
    least = frequent(counts, most_sent)
    arrow = counts.where(F.col("n") >= least).toArrow()  # at most `most_sent` rows
    keys, n, best = (arrow.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = keys.argsort()
    sent = spark.sparkContext.broadcast((keys[order], n[order], best[order]))
    out = [c for c in found.columns if c not in (pairs, weights)]

    def parts(batch: pa.RecordBatch) -> tuple:
        """Pairs, links, offsets, and each pair's place among those sent, or -1."""
        flat, off = values(batch.column(batch.schema.get_field_index(pairs)), "<u8")
        links, _ = values(batch.column(batch.schema.get_field_index(weights)), "<u8")
        flat, links, keys = flat.astype(np.int64), links.astype(np.int64), sent.value[0]
        at = np.searchsorted(keys, flat)
        there = at < len(keys)
        there[there] = keys[at[there]] == flat[there]
        return flat, links, off, np.where(there, at, -1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for b in (x for batch in batches for x in in_parts(batch, pairs, LOOKED_UP)):
            _, links, off, at = parts(b)
            there = at >= 0
            total, good = np.zeros(len(links) + 1, np.int64), np.zeros(len(links) + 1, np.int64)
            total[1:][there], good[1:][there] = n[at[there]] * links[there], best[at[there]] * links[there]
            total, good = total.cumsum(), good.cumsum()
            yield appended(b.select(out), **{names["n_best"]: pa.array(np.diff(good[off])), names["count_sum"]: pa.array(np.diff(total[off]))})

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in in_parts(batch, pairs, LOOKED_UP)):
            flat, links, off, at = parts(b)
            rows = np.repeat(b.column(b.schema.get_field_index(row)).to_numpy(), np.diff(off))
            miss = np.flatnonzero(at < 0)
            for a in range(0, len(miss), BLOCK):
                m = miss[a : a + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(rows[m]), pa.array(flat[m]), pa.array(links[m])], names=["row", "pair", "links"])

    answered = found.mapInArrow(sums, widened(found.select(*(q(c) for c in out)), {names["n_best"]: "long", names["count_sum"]: "long"}))
    if least > 1:
        rare = found.select(q(row), q(pairs), q(weights)).mapInArrow(rest, "row long, pair long, links long")
        met = rare.join(counts.where(F.col("n") < least), "pair")
        more = met.groupBy(F.col("row").alias("more_row")).agg(F.sum(F.col("n") * F.col("links")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
        answered = answered.join(more, F.col(q(row)) == F.col("more_row"), "left").drop("more_row")
        for name, extra in (("n_best", "more_best"), ("count_sum", "more_sum")):
            answered = answered.withColumn(names[name], F.col(q(names[name])) + F.coalesce(F.col(extra), F.lit(0))).drop(extra)
    shown = [*COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    return answered.select(*(q(c) for c in df.columns if c != text_col), *(q(names[c]) for c in shown))

"""Toxicity by cumulative-link ordinal regression.

Grades run from 0 (clean) to 3. One weight per text feature is shared by all grades, and ordered
thresholds tell them apart: P(grade >= k) = sigmoid(w x - t_k) with t_1 < t_2 < t_3. The sum of these is the
expected severity. Features are words (runs of letters, A-Z lowered) and their beginnings of 4 to 7
bytes, present in clearly more toxic than clean labelled texts; x is log(1 + count).

The labels only tell toxic from clean. A toxic text's grade is the third in which its number of such
words falls. Features, grades and weights come from at most `sample` labelled rows,
the first by a hash of the id. Without labels of both kinds nothing is toxic. Null and empty texts are
clean: severity 0. Rows that are repeated are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import labelled_sample
from .textbytes import Bytes, appended, fresh, mix, q, slices, widened

SAMPLE, MOST_FEATURES, GRADES = 20_000, 4096, 3
LEAST_DOCS, LEAST_ODDS = 6, 3.0  # toxic texts that have a feature; log of how much likelier it is in one
PREFIXES = (4, 5, 6, 7)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[Bytes, np.ndarray, np.ndarray]:
    """(the slice, hashes of its words and their beginnings, the text of each)."""
    b = Bytes(data, off, lower=True, inside=_LETTER)
    hashes, docs = [b.words()], [b.word_doc]
    for n in PREFIXES:
        long = np.flatnonzero(b.ends - b.starts >= n)
        hashes.append(mix(b.hashes(b.starts[long], b.starts[long] + n) + np.uint64(n)))
        docs.append(b.word_doc[long])
    return b, np.concatenate(hashes), np.concatenate(docs)


@dataclass
class Model:
    hashes: np.ndarray  # of the features, ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 50.0))

    def __post_init__(self):
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, h: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) of the features found."""
        some = np.flatnonzero(self.flags[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[some])
        hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[some]) if len(self.hashes) else at[:0]
        key, count = np.unique(docs[some[hit]].astype(np.int64) * max(len(self.hashes), 1) + at[hit], return_counts=True)
        return key // max(len(self.hashes), 1), key % max(len(self.hashes), 1), count

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(P(grade >= 1), expected severity) of each text."""
        some, expected = [], []
        for _, data, off in slices(texts):
            b, h, docs = features(data, off)
            row, col, count = self.counts(h, docs, b.docs)
            z = np.bincount(row, np.log1p(count) * self.weights[col], b.docs) if len(row) else np.zeros(b.docs)
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -40, 40)))
            above[np.bincount(row, minlength=b.docs) == 0] = 0  # no feature: clean
            some.append(above[:, 0])
            expected.append(above.sum(1))
        return (np.concatenate(some), np.concatenate(expected)) if some else (np.zeros(0), np.zeros(0))


def fit_ordinal(row: np.ndarray, col: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, decay: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised loss, by gradient steps of adapted size (Adam). A grade g is
    `grades` yes-or-no answers: whether it is at least k."""
    n = len(grade)
    yes = grade[:, None] >= np.arange(1, grades + 1)
    share = np.bincount(np.clip(grade, 0, grades), minlength=grades + 1) / n
    balance = (1 / np.maximum(share, 1e-6))[np.clip(grade, 0, grades)] ** 0.5  # rarer grades weigh more
    balance /= balance.mean()
    w, first, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(grades - 1)
    params, moment, square = [w, first, gaps], [np.zeros_like(p) for p in (w, first, gaps)], [np.zeros_like(p) for p in (w, first, gaps)]
    for step in range(1, steps + 1):
        t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        z = np.bincount(row, x * w[col], n)
        d = (1 / (1 + np.exp(-np.clip(z[:, None] - t, -40, 40))) - yes) * balance[:, None] / n
        dt = -d.sum(0)
        grads = [np.bincount(col, x * d.sum(1)[row], n_features) + decay * w / max(n_features, 1), np.array([dt.sum()]), np.array([dt[k + 1 :].sum() for k in range(grades - 1)]) * np.exp(gaps)]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            p -= 0.1 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Three passes over the texts of the labelled sample; what reaches the driver is bounded by
    the sample and by MOST_FEATURES."""
    known = labels.select(F.col(q(id_col)).alias("_id"), (F.col(q(label_col)) > 0).alias("_toxic")).where("_toxic is not null")
    # half of the sample for either kind
    some = labelled_sample(known.where("_toxic"), sample // 2, "_id").unionByName(labelled_sample(known.where("not _toxic"), sample // 2, "_id"))
    # the broadcast has at most `sample` rows of 16 bytes
    rows = docs.select(F.col(q(id_col)).alias("_id"), F.col(q(text_col)).cast("string").alias("text")).join(F.broadcast(some), "_id").select("text", "_toxic").dropDuplicates(["text"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), bool)
            for a, data, off in slices(batch.column(0)):
                b, h, of = features(data, off)
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, yes = h[once], toxic[a : a + b.docs][of[once]]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(h)))
                bad = np.add.reduceat(yes.astype(np.int64), at) if len(at) else n
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((n - bad).astype(np.int64))], names=["h", "bad", "good"])

    totals = {r._toxic: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n_bad, n_good = totals.get(True, 0), totals.get(False, 0)
    if not n_bad or not n_good:
        return Model(np.zeros(0, np.uint64))
    tallied = rows.mapInArrow(tally, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    sure = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = tallied.where((F.col("bad") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("h", sure.alias("sure")).orderBy(F.desc("sure"), "h").limit(MOST_FEATURES).toArrow()
    model = Model(np.sort(best["h"].to_numpy().view(np.uint64)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for a, data, off in slices(batch.column(0)):
                b, h, of = features(data, off)
                row, col, count = model.counts(h, of, b.docs)
                edge = np.searchsorted(row, np.arange(b.docs + 1))
                yield pa.RecordBatch.from_pylist([{"toxic": toxic[a + i], "col": col[edge[i] : edge[i + 1]].tolist(), "n": count[edge[i] : edge[i + 1]].tolist()} for i in range(b.docs)], pa.schema([("toxic", pa.bool_()), ("col", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]))

    seen = rows.mapInArrow(found, "toxic boolean, col array<long>, n array<long>")
    seen = seen.orderBy(F.xxhash64("toxic", "col", "n")).limit(sample).toArrow().to_pylist()  # repeated ids could make more
    row = np.repeat(np.arange(len(seen)), [len(s["col"]) for s in seen])
    col, count = (np.array([i for s in seen for i in s[k]], np.int64) for k in ("col", "n"))
    toxic = np.array([s["toxic"] for s in seen])
    hits = np.bincount(row, count, len(seen))
    hurt = toxic & (hits > 0)
    cuts = np.quantile(hits[hurt], [1 / 3, 2 / 3]) if hurt.any() else np.zeros(2)
    # a toxic text without a feature is of the lowest toxic grade
    grade = np.where(toxic, 1 + np.where(hits > 0, np.searchsorted(cuts, hits, "right"), 0), 0)
    model.weights, model.thresholds = fit_ordinal(row, col, np.log1p(count), grade, len(model.hashes))
    return model


def judged(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The table with `severity` (expected, 0 to 3), `grade` (the nearest) and `toxic` (grade 1 or
    more is the likelier); the new columns' names."""
    names, at = fresh(docs, "severity", "grade", "toxic"), docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, expected = model.score(batch.column(at).cast(pa.string()))
            yield appended(batch, **dict(zip(names, (pa.array(expected), pa.array(np.rint(expected).astype(np.int32)), pa.array(some >= 0.5)), strict=True)))

    return docs.mapInArrow(score, widened(docs, dict(zip(names, ("double", "integer", "boolean"), strict=True)))), names


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not toxic, with the same columns."""
    out, names = judged(docs, learn(docs, labels))
    return out.where(~F.col(q(names[2]))).select(*[F.col(q(c)) for c in docs.columns])

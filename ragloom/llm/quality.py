"""Quality rules: a decision list learned from labelled statistics.

Sequential covering: of the labelled rows two thirds grow a rule, adding the threshold condition with
the largest information gain until no good row is covered, and one third prunes it, dropping last
conditions while that raises the share of bad rows among those covered. A rule that is right often
enough on the pruning rows joins the list; the rows it covers leave, and the next is grown. The list
is an ordered Spark conditional over the statistics' columns: a row that a rule matches is rejected, any
other is kept.

The rules are learned from at most `sample` labelled rows, the first by a hash of the id. Without labels of both
kinds the list is empty and only the base rules reject. Null and empty texts have 0 in every count, so
the base rules reject them. Rows that are repeated are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .prefix import labelled_sample
from .textbytes import appended, fresh, q, widened

Rule = list[tuple[str, str, float]]

SAMPLE, MOST_RULES, MOST_CONDITIONS = 50_000, 24, 4
LEAST_PRECISION, LEAST_COVER = 0.97, 8


def measured(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The table with the statistics of its texts as further columns, and the columns' names."""
    names = dict(zip([*stats.COUNTS, *stats.FEATURES], fresh(docs, *stats.COUNTS, *stats.FEATURES), strict=True))
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = stats.measure(batch.column(at).cast(pa.string()))
            yield appended(batch, **{names[k]: pa.array(v) for k, v in m.items()})

    return docs.mapInArrow(add, widened(docs, {name: "long" if k in stats.COUNTS else "double" for k, name in names.items()})), names


def base_failed(names: dict[str, str]) -> Column:
    n, repeat = F.col(q(names["n_words"])), F.col(q(names["n_repeat_words"]))
    return (n < 50) | (repeat * 100 > n * 50)


def _matches(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, value in rule:
        out &= x[name] > value if sign == ">" else x[name] <= value
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, tuple[str, str, float]] | None:
    """The condition with the largest gain: bad rows covered times the bits by which it raises their share."""
    p, n = bad.sum(), len(bad)
    best = None
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        ranked, hits = v[order], np.cumsum(bad[order])
        cut = np.flatnonzero(ranked[1:] > ranked[:-1])
        if not len(cut):
            continue
        below, all_below = hits[cut], cut + 1.0
        for sign, hit, all_hit in (("<=", below, all_below), (">", p - below, n - all_below)):
            gain = hit * (np.log2(np.maximum(hit, 1e-9) / all_hit) - np.log2(p / n))
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0] + 1e-9:
                best = float(gain[i]), (name, sign, float((ranked[cut[i]] + ranked[cut[i] + 1]) / 2))
    return best if best and best[0] > 1e-9 else None


def cover(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """The decision list. x: the features' columns; bad: which rows are to be rejected; prune:
    which rows prune."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (bad & left & ~prune).sum() >= LEAST_COVER:
        rule: Rule = []
        rows = left & ~prune
        while len(rule) < MOST_CONDITIONS and not bad[rows].all():
            found = _best({k: v[rows] for k, v in x.items()}, bad[rows])
            if not found:
                break
            rule.append(found[1])
            rows &= _matches(rule[-1:], x)
        if not rule:
            break

        def worth(r: Rule) -> float:
            m = _matches(r, x) & left & prune
            hit, n = int((m & bad).sum()), int(m.sum())
            return (2 * hit - n) / n if n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        m = _matches(rule, x) & left
        right, held = int((m & bad).sum()), m & prune
        if right < LEAST_COVER or right < LEAST_PRECISION * m.sum() or (held & bad).sum() < LEAST_PRECISION * held.sum():
            break
        rules.append(rule)
        left &= ~m
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """The decision list for `docs` from `labels` (id, 0 for bad or 1 for good)."""
    some = labelled_sample(labels.select(F.col(q(id_col)).alias("_id"), (F.col(q(label_col)) == 0).alias("_bad")).where("_bad is not null"), sample, "_id")
    # the broadcast has at most `sample` rows of 16 bytes
    rows = docs.select(F.col(q(id_col)).alias("_id"), F.col(q(text_col)).cast("string").alias("text")).join(F.broadcast(some), "_id")
    rows, names = measured(rows)
    rows = rows.where(~base_failed(names)).select("_bad", (F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(3)) == 0).alias("_prune"), *[F.col(names[k]) for k in stats.FEATURES])
    # repeated ids could make more rows than the sample has
    got = rows.orderBy(F.xxhash64(*[F.col(c) for c in rows.columns])).limit(sample).toArrow()
    x = {k: got[names[k]].to_numpy() for k in stats.FEATURES}
    bad, prune = (np.array(got[k].to_pylist(), bool) for k in ("_bad", "_prune"))
    return cover(x, bad, prune) if len(bad) else []


def verdict(rules: list[Rule], names: dict[str, str]) -> Column:
    """The number of the first rule that matches, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, value in rule:
            c = F.col(q(names[name]))
            test = test & (c > value if sign == ">" else c <= value)
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(0) if out is not None else F.lit(0)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The table with its statistics, `base_failed`, `rule` and `kept`; the new columns' names."""
    out, names = measured(docs, text_col)
    more = dict(zip(("base_failed", "rule", "kept"), fresh(out, "base_failed", "rule", "kept"), strict=True))
    out = out.withColumn(more["base_failed"], base_failed(names)).withColumn(more["rule"], verdict(rules, names))
    return out.withColumn(more["kept"], ~F.col(q(more["base_failed"])) & (F.col(q(more["rule"])) == 0)), names | more


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the base rules and the learned list keep, with the same columns."""
    out, names = judged(docs, learn(docs, labels))
    return out.where(F.col(q(names["kept"]))).select(*[F.col(q(c)) for c in docs.columns])

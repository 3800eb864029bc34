"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over byte trigrams, smoothed
log-odds of the languages on either side, gives a margin per trigram, scaled so that the training
texts of the two sides lie at +1 and -1 on average. A text gets the language whose codeword has the
least squared hinge loss, weighted by how well each bit separates its sides; the score is the
softmax of the negative losses, and a text whose two nearest codewords lie close is flagged ambiguous.

All texts with a language in the training rows are counted; the counts that reach the driver are
bounded by languages x 32,768. A null text, or one without a letter, is `und` with score 0, and so is
every text if nothing can be learned. Equal scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import LOWER, appended, fresh, q, slices, widened

BITS = 15
DIMS = 1 << BITS
AMBIGUOUS = 0.8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CLEAN = LOWER.copy()
_CLEAN[[i for i in range(128) if not _LETTER[i]]] = 32


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the byte trigrams of each text between two spaces, offsets): A-Z and the capitals of
    Latin-1 lowered, ASCII other than letters as spaces. A text has as many as it has bytes."""
    x = _CLEAN[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    x[capital] += 32
    first = off[:-1][np.diff(off) > 0]
    wide = np.concatenate([[32], x, [32]]).astype(np.uint32)
    left, right = wide[:-2].copy(), wide[2:].copy()
    left[first] = 32
    right[first[1:] - 1] = 32
    code = left << np.uint32(16) | wide[1:-1] << np.uint32(8) | right
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64), off


def lettered(texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    c = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = np.diff(c[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(ch.isalpha() for ch in texts[i].as_py())
    return out


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of +1 and -1. Up to 7 languages have every split into two sides once; more have random
    splits, four times as many as would tell them apart, none repeated."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1, *c] for c in product((1, -1), repeat=n - 1) if -1 in c], float).T
    rng, out = np.random.default_rng(seed), set()
    while len(out) < 4 * int(np.ceil(np.log2(n))) + 8:
        c = np.where(rng.random(n) < 0.5, 1.0, -1.0)
        if abs(c.sum()) < n:
            out.add(tuple(c * c[0]))
    code = np.array(sorted(out)).T
    return code if len(np.unique(code, axis=0)) == n else codewords(n, seed + 1)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # bits x DIMS
    middle: np.ndarray  # by bit: the margin halfway between the two sides
    half: np.ndarray  # half of their distance

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x languages. margins: texts x bits, per trigram."""
        z = (margins - self.middle) / self.half
        return (np.maximum(0, 1 - z[:, None, :] * self.code) ** 2 * (self.half / self.half.sum())).sum(2)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        names, scores, close = [], [], []
        for a, data, off in slices(texts):
            n = len(off) - 1
            best, score, flag = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            some = np.flatnonzero(lettered(texts.slice(a, n), data, off)) if self.langs else np.zeros(0, np.int64)
            if len(some):
                grams, _ = trigrams(data, off)
                full = np.flatnonzero(np.diff(off) > 0)
                margins = np.zeros((n, len(self.odds)))
                for k, odds in enumerate(self.odds):
                    margins[full, k] = np.add.reduceat(odds[grams], off[full]) / np.diff(off)[full]
                p = np.exp(-4 * self.losses(margins[some]))
                p /= p.sum(1, keepdims=True)
                best[some], score[some] = p.argmax(1), p.max(1)
                flag[some] = p.max(1) < AMBIGUOUS
            names += [self.langs[i] if i >= 0 else "und" for i in best.tolist()]
            scores.append(score)
            close.append(flag)
        return names, np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, bool), *close])


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts of every language over all rows for which `train` holds."""
    rows = docs.where(train & F.col(q(lang_col)).isNotNull() & F.col(q(text_col)).isNotNull()).select(F.col(q(text_col)).cast("string").alias("text"), F.col(q(lang_col)).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        total = np.zeros((0, DIMS), np.int64)
        for batch in batches:
            code = np.array([seen.setdefault(x, len(seen)) for x in batch.column(1).to_pylist()], np.int64)
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros((len(seen) - len(total), DIMS), np.int64)])
            for a, data, off in slices(batch.column(0)):
                grams, _ = trigrams(data, off)
                of = np.repeat(code[a : a + len(off) - 1], np.diff(off))
                for k in np.unique(of):
                    total[k] += np.bincount(grams[of == k], minlength=DIMS)
        for lang, k in seen.items():
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[k][at])], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    n = np.zeros((len(langs), DIMS))
    n[[at[x] for x in counts["lang"].to_pylist()], counts["gram"].to_numpy()] = counts["n"].to_numpy()
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((code.shape[1], DIMS)), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    # each language weighs the same, however many texts it has
    share = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * DIMS)
    sides = [[share[c == s].mean(0) for s in (1, -1)] for c in code.T]
    odds = np.array([np.log(a) - np.log(b) for a, b in sides])
    high, low = np.array([[(a * o).sum(), (b * o).sum()] for (a, b), o in zip(sides, odds, strict=True)]).T
    return Model(langs, code, odds, (high + low) / 2, (high - low) / 2)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The table with `lang_pred`, `score` and `ambiguous`; the new columns' names."""
    names, at = fresh(docs, "lang_pred", "score", "ambiguous"), docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, close = model.predict(batch.column(at).cast(pa.string()))
            yield appended(batch, **dict(zip(names, (pa.array(lang, pa.string()), pa.array(score), pa.array(close)), strict=True)))

    return docs.mapInArrow(predict, widened(docs, dict(zip(names, ("string", "double", "boolean"), strict=True)))), names

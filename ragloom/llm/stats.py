"""Counts and ratios of every whole text, computed from its bytes by numpy passes over Arrow batches.

Words are runs of bytes other than the space and 0x09 to 0x0D. Nulls and empty texts have 0 in every
count and ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textbytes import Bytes, slices, windows, with_doc

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the rules may test: each a number that grows with something a reader would notice.
FEATURES = ["words", "word_length", "symbol_share", "dup_line_share", "repeat_word_share", "upper_share", "digit_share", "punctuation_share", "distinct_word_share", "line_words", "top_word_share", "bang_share", "word_entropy"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table(SYMBOLS)
_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_MARK = _table("!\"'(),-./:;?@[\\]^_`{}~+=")
_BANG = _table("!?")


def repeated(hashes: np.ndarray, docs: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of `width` words that is found twice or more in its text."""
    out = np.zeros(len(hashes), bool)
    h, at = windows(hashes, docs, width)
    if len(h):
        keys = with_doc(h, docs[at])
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(width):
            out[at[twice] + k] = True
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts (int64) and features (float64) of a column of texts."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in [*COUNTS, *FEATURES]}
    for _, data, off in slices(texts):
        b = Bytes(data, off)
        h, docs = b.words(), b.word_doc
        n = b.per_doc(docs)
        chars = b.count(((data & 0xC0) != 0x80) & b.inside)
        symbols = b.count(_SYMBOL[data])
        starts, ends, line_doc = b.lines()
        lines = b.per_doc(line_doc)
        keys = with_doc(b.hashes(starts, ends), line_doc)
        order = np.argsort(keys)
        again = order[1:][keys[order][1:] == keys[order][:-1]]
        dup = b.per_doc(line_doc[again])
        repeat = b.per_doc(docs[repeated(h, docs)])
        # how often each different word of a text is found in it
        keys = with_doc(h, docs)
        order = np.argsort(keys)
        ranked = keys[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else order
        often, of = np.diff(np.append(at, len(ranked))), docs[order[at]]
        top = np.zeros(b.docs)
        np.maximum.at(top, of, often)
        words, letters = np.maximum(n, 1), np.maximum(chars, 1)
        share = often / words[of]
        new = {
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
            "words": n, "word_length": chars / words, "symbol_share": symbols / letters, "dup_line_share": dup / np.maximum(lines, 1), "repeat_word_share": repeat / words,
            "upper_share": b.count(_UPPER[data]) / letters, "digit_share": b.count(_DIGIT[data]) / letters, "punctuation_share": b.count(_MARK[data]) / letters, "distinct_word_share": b.per_doc(of) / words,
            "line_words": n / np.maximum(lines, 1), "top_word_share": top / words, "bang_share": b.count(_BANG[data]) / letters, "word_entropy": -b.per_doc(of, share * np.log(np.maximum(share, 1e-300))),
        }
        for k, v in new.items():
            got[k].append(v.astype(np.int64 if k in COUNTS else np.float64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64 if k in COUNTS else np.float64) for k, v in got.items()}

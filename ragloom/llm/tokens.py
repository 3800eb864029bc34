"""Token ids of whole texts by a tokenizers file.

For byte-level BPE whose pre-tokens never hold a space but as their first character, a cut before a
space that follows a character other than white space lies between two pre-tokens. So a text is cut
there, the tokenizers library encodes each different piece once, and its ids are kept for the next
time: found by hash, compared byte by byte. Other kinds of tokenizers get every text whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import Bytes, slices

KEPT = 1_200_000  # pieces kept by each Python worker; beyond it new ones are encoded again
LONGEST = 64  # bytes of a piece that is kept
_SLOTS = 1 << 22
_LOADED: dict[str, "Encoder"] = {}


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str) -> "Encoder":
    """One encoder for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Rows:
    """Rows of various lengths in one array that grows."""

    def __init__(self, kind):
        self.flat, self.off, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used, n = int(self.off[self.n]), self.n + len(lengths)
        while len(self.flat) < used + len(flat):
            self.flat = np.resize(self.flat, len(self.flat) * 2)
        while len(self.off) <= n:
            self.off = np.resize(self.off, len(self.off) * 2)
        self.flat[used : used + len(flat)] = flat
        self.off[self.n + 1 : n + 1] = used + np.cumsum(lengths)
        self.n = n

    def lengths(self, at: np.ndarray) -> np.ndarray:
        return self.off[at + 1] - self.off[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.off[at], self.lengths(at))]


class Known:
    """Ids of pieces of text by hash, with linear probing."""

    def __init__(self):
        self.table, self.hash = np.full(_SLOTS, -1, np.int32), np.zeros(KEPT, np.uint64)
        self.bytes, self.ids = Rows(np.uint8), Rows(np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row that has each hash, or -1."""
        out, todo, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            row = self.table[slot]
            there = row >= 0
            same = there & (self.hash[row] == h[todo])
            out[todo[same]] = row[same]
            on = there & ~same
            todo, slot = todo[on], (slot[on] + 1) & (_SLOTS - 1)
        return out

    def add(self, h: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New rows; the hashes differ from one another and from those there."""
        row = np.arange(self.bytes.n, self.bytes.n + len(h))
        self.hash[row] = h
        self.bytes.add(data, sizes)
        self.ids.add(ids, counts)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(row):
            free = self.table[slot] < 0
            self.table[slot[free]] = row[free]
            on = self.table[slot] != row
            row, slot = row[on], (slot[on] + 1) & (_SLOTS - 1)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        t.no_truncation()
        t.no_padding()
        kind = str(t.pre_tokenizer)
        self.by_piece = t.normalizer is None and kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind
        vocab = t.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.known = Known()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the pieces: each text's, and each space after a character surely not white.
        Of characters beyond ASCII, only those led by bytes under which there is no white space count."""
        pad = np.concatenate([np.zeros(4, np.uint8), data])
        b1, b2, b3, b4 = pad[3:-1], pad[2:-2], pad[1:-3], pad[:-4]
        sure = ((b1 > 0x20) & (b1 < 0x7F)) | ((b1 >= 0x80) & (((b2 >= 0xC3) & (b2 < 0xE0)) | ((b2 >= 0x80) & (b2 < 0xC0) & (((b3 >= 0xE4) & (b3 < 0xF0)) | (b4 >= 0xF0)))))
        at = (data == 0x20) & sure
        at[off[:-1][np.diff(off) > 0]] = True
        return np.flatnonzero(at)

    def _new(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of different pieces. Those with one space, at their start, and no white end are
        encoded many together: each begins at a token that opens with a space."""
        out: list = [None] * len(raw)
        text = [r.decode() for r in raw]
        plain = [i for i, t in enumerate(text) if t[0] == " " and len(t) > 1 and t.count(" ") == 1 and not t[1].isspace() and not t[-1].isspace()]
        runs = [plain[a : a + 256] for a in range(0, len(plain), 256)]
        for a in range(0, len(runs), 64):
            some = runs[a : a + 64]
            for run, ids in zip(some, self.whole(["".join([text[i] for i in r]) for r in some]), strict=True):
                at = np.flatnonzero(self.opens[ids])
                if len(at) == len(run):
                    for i, part in zip(run, np.split(ids, at[1:]), strict=True):
                        out[i] = part
        rest = [i for i, o in enumerate(out) if o is None]
        for i, ids in zip(rest, self.whole([text[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice, and where each text's begin."""
        b = Bytes(data, off)
        starts = self.pieces(data, off)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        sizes, h, known = ends - starts, b.hashes(starts, ends), self.known
        row = known.find(h)
        hit = np.flatnonzero(row >= 0)
        hit = hit[known.bytes.lengths(row[hit]) == sizes[hit]]
        same = known.bytes.take(row[hit]) == data[spread(starts[hit], sizes[hit])]
        if len(hit):
            hit = hit[np.logical_and.reduceat(same, np.cumsum(sizes[hit]) - sizes[hit])]
        got = np.zeros(len(row), bool)
        got[hit] = True
        miss = np.flatnonzero(~got)
        raw = data.tobytes()
        first: dict[bytes, int] = {}
        which = np.array([first.setdefault(raw[i:j], len(first)) for i, j in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)], np.int64)
        ids = self._new(list(first))
        new = Rows(np.uint32)
        counts = np.array([len(x) for x in ids], np.int64)
        new.add(np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts)
        lengths = np.zeros(len(row), np.int64)
        lengths[hit], lengths[miss] = known.ids.lengths(row[hit]), new.lengths(which)
        at = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.zeros(at[-1], np.uint32)
        flat[spread(at[hit], lengths[hit])] = known.ids.take(row[hit])
        flat[spread(at[miss], lengths[miss])] = new.take(which)
        if len(miss) and known.bytes.n < KEPT:
            seen = miss[np.unique(which, return_index=True)[1]]  # the first of each, in the order of `first`
            _, one = np.unique(h[seen], return_index=True)
            one = one[(row[seen[one]] < 0) & (sizes[seen[one]] <= LONGEST)][: KEPT - known.bytes.n]
            pick = seen[one]
            known.add(h[pick], data[spread(starts[pick], sizes[pick])], sizes[pick], new.take(one), counts[one])
        return flat, at[np.searchsorted(starts, off)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) for runs of rows; a null counts as an empty text."""
        for a, data, off in slices(texts):
            if self.by_piece:
                yield a, *self._slice(data, off)
            else:
                ids = self.whole(pc.fill_null(texts.slice(a, len(off) - 1), "").to_pylist())
                yield a, np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


def packed(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of ids as a column of little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(flat, "<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())

"""Words and shingles of Arrow text columns as numpy arrays: whole texts, no row-at-a-time Python.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Hashes are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_STATE: dict = {}
#: Bytes of a piece of rows (longer rows are pieces of their own), and powers that a worker keeps.
PIECE, KEPT_POWERS = 1 << 17, (1 << 17) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(seed: int) -> np.ndarray:
    if ("codes", seed) not in _STATE:
        low = np.arange(256, dtype=np.uint64)
        low[65:91] += _U(32)
        _STATE["codes", seed] = mix((low + _U(1 + 1000 * seed)) * _STEP) | _U(1)
    return _STATE["codes", seed]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of longer pieces than usual are not kept."""
    have = _STATE.get("powers")
    if have is None or len(have[0]) < n:
        size = max(KEPT_POWERS, n)
        base = 0xD1342543DE82EF95
        up, down = np.full(size, _U(base)), np.full(size, _U(pow(base, -1, 1 << 64)))
        up[0] = down[0] = _U(1)
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size == KEPT_POWERS:
            _STATE["powers"] = have
    return have


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(off) == 0:
        off = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Ranges of rows of about `most` bytes; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (with the number of words at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[end] = word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each byte range, A-Z counted as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_byte_codes(seed)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, in order and with repeats, and each row's first one.

    A row of fewer words has its whole sequence as one; a row without words has none.
    """
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(out_first[-1]), dtype=np.uint64)
    if len(words) >= k:
        run = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            run += words[j : len(words) - k + 1 + j] * _U((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        run = mix(run)
        row = np.repeat(np.arange(len(count)), np.where(count >= k, made, 0))
        slot = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(count >= k, made, 0))])[:-1], np.where(count >= k, made, 0))
        out[out_first[row] + slot] = run[first[row] + slot]
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = np.array([count[r]], dtype=np.uint64)
        for j in range(first[r], first[r + 1]):
            h = mix(h * _STEP + words[j])
        out[out_first[r]] = h[0]
    return out, out_first


class Recent:
    """What a Python worker has worked out for words: two generations of at most `most` words and one block's new ones.

    Words of more than LONG characters stay for their block only, so the bytes are bounded as well.
    """

    LONG = 64

    def __init__(self, most: int):
        self.most, self.young, self.old, self.long = most, {}, {}, []

    def rest(self) -> None:
        """Between tasks: only one generation stays."""
        for w in self.long:
            self.young.pop(w, None)
        self.old, self.long = {}, []

    def lacking(self, words: set) -> list:
        """The words without a value; the others are in `young` afterwards."""
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    out.append(w)
        self.long = [w for w in out if len(w) > self.LONG]
        return out

"""Vectorised tokenising and hashing over Arrow string buffers.

The Arrow stages of this subpackage work on whole columns: a batch of texts is one byte buffer with offsets, and
tokens, their 64-bit hashes and n-gram hashes are numpy arrays over all texts of the batch, without a Python loop
over rows or words.

A token is a maximal run of ASCII letters, digits and bytes above 0x7F in the lower-cased UTF-8 text, so letters of
every script belong to tokens and ASCII punctuation and white space separate them. Null counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; bounds the numpy temporaries whatever the batch or text size.
BLOCK = 1 << 20
#: Bytes of text in one slice of a batch.
SLICE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True

_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = max(_pow_cache, default=0)
    if have < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            both = []
            for base in (_P, _PINV):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
        _pow_cache.clear()
        _pow_cache[size] = (both[0], both[1])
        have = size
    return _pow_cache[have]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Tokens:
    """Tokens of a slice of texts: text number, byte span in the buffer, and hash of each token."""

    texts: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """bounds[i]:bounds[i + 1] are the tokens of text i."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def filled(column: pa.Array) -> pa.Array:
    """The column as large strings with nulls replaced by empty text."""
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def tokenize(column: pa.Array, lower: bool = True, word: np.ndarray = _WORD) -> Tokens:
    """Tokens of every text of the column."""
    column = filled(column)
    if lower:
        column = pc.utf8_lower(column)
    raw, offsets = buffers(column)
    return tokenize_raw(raw, offsets, word)


def tokenize_raw(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> Tokens:
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[:n] = word[raw]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    start = np.flatnonzero(first)
    last = inside[:n].copy()
    if n:
        last[:-1] &= ~(inside[1:n] & ~first[1:])
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Tokens(len(offsets) - 1, doc, start, end, span_hashes(raw, start, end))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of ascending spans that don't overlap."""
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):  # by blocks of tokens that span about BLOCK bytes
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + BLOCK)))
            base, stop = int(start[lo]), int(end[hi - 1])
            power, inverse = _powers(stop - base + 1)
            total = np.zeros(stop - base + 1, np.uint64)
            np.cumsum((raw[base:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=total[1:])
            s, e = start[lo:hi] - base, end[lo:hi] - base
            hashes[lo:hi] = (total[e] - total[s]) * inverse[s]
            lo = hi
    return mix(hashes)


def grams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first token and hash of every n-gram that lies within one text."""
    m = len(tokens.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(tokens.doc[:m] == tokens.doc[n - 1 :])
    with np.errstate(over="ignore"):
        g = tokens.hash[:m].copy()
        for k in range(1, n):
            g *= _GRAM
            g += tokens.hash[k : k + m]
    return first, mix(g[first])


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text makes a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Arrow int64 with the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: pa.Array | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and row bounds."""
    if not isinstance(values, pa.Array):
        values = pa.array(values)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)

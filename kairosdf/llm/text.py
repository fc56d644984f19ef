"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a bounded slice of documents at a
time, so a Python worker's memory follows the slice (and the longest single
text), never the partition.  A word is a maximal run of bytes other than
0x20 and 0x09-0x0D; A-Z are folded to a-z unless asked otherwise.  Hashes are
64-bit and the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_PERIOD = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_byte = np.arange(256)
IS_SPACE = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))
IS_UPPER = (_byte >= 65) & (_byte <= 90)
IS_LOWER = (_byte >= 97) & (_byte <= 122)
IS_DIGIT = (_byte >= 48) & (_byte <= 57)
IS_CONT = (_byte & 0xC0) == 0x80
LOWER = np.where(IS_UPPER, _byte + 32, _byte).astype(np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that scatters neighbouring values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED_VALUE = _BYTE_VALUE[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


_tables: dict[str, np.ndarray] = {}


def _pow_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["pow"] = _powers(_BASE, _PERIOD + 1)
        _tables["inv"] = _powers(pow(_BASE, -1, 1 << 64), _PERIOD + 1)
    return _tables["pow"], _tables["inv"]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each byte span [start, end) of buf.

    One prefix sum of value(byte) * base**position serves all spans; positions
    restart every _PERIOD bytes, and the few spans across a restart are put
    together piece by piece.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _pow_tables()
    values = (_FOLDED_VALUE if fold else _BYTE_VALUE)[buf]
    for at in range(0, len(values), _PERIOD):
        piece = values[at : at + _PERIOD]
        piece *= power[: len(piece)]
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    out = (total[end] - total[start]) * inverse[start % _PERIOD]
    for i in np.flatnonzero(start // _PERIOD != (end - 1) // _PERIOD):
        h, shift, at = 0, 1, int(start[i])
        while at < end[i]:
            stop = min(int(end[i]), (at // _PERIOD + 1) * _PERIOD)
            part = (int(total[stop]) - int(total[at])) * int(inverse[at % _PERIOD])
            h = (h + part * shift) & _MASK
            shift = shift * pow(_BASE, stop - at, 1 << 64) & _MASK
            at = stop
        out[i] = h
    return mix64(out + (end - start).astype(np.uint64))


@dataclass
class Slice:
    """Some whole documents: first row, bytes, byte offsets, words."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray  # of words
    end: np.ndarray
    words: np.ndarray  # word index at which each document begins, and the end

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, fold: bool = True) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end, fold)

    def counts(self) -> np.ndarray:
        return np.diff(self.words)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def per_doc(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each document."""
        total = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses a text's end."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = IS_SPACE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets] = True
    word = ~space
    start = np.flatnonzero(word & before[:-1])
    after = np.empty(len(buf) + 1, bool)
    after[:-1] = space
    after[-1] = True
    after[offsets] = True
    end = np.flatnonzero(word & after[1:]) + 1
    return start, end


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts, whole, in slices of about `most` bytes."""
    raw, offsets = string_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, at + 65_536)
        own = offsets[at : stop + 1] - offsets[at]
        buf = raw[offsets[at] : offsets[stop]]
        start, end = word_bounds(buf, own)
        yield Slice(at, buf, own, start, end, np.searchsorted(start, own))
        at = stop


_GRAM = mix64(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (also across documents)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _GRAM[0]
    for k in range(1, n):
        out += h[k : k + m] * _GRAM[k]
    return mix64(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, apart from n-gram hashes by its length."""
    with np.errstate(over="ignore"):
        return mix64(np.array([(h * _GRAM[: len(h)]).sum() + np.uint64(len(h)) * np.uint64(0xA24BAED4963EE407)]))[0]


def shingle_sets(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each document, sorted, flat, with offsets.

    Fewer than n words make one shingle; no words make none.
    """
    h, words = s.hashes(), s.words
    grams = ngram_hashes(h, n)
    sets = []
    for d in range(len(s)):
        a, b = words[d], words[d + 1]
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(sequence_hash(h[a:b])[None])
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]], 0 where empty; wraps for unsigned integers."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

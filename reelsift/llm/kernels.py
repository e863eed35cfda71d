"""Array kernels used inside tasks: texts as one byte buffer, words, string hashes.

Every function works on whole texts. A null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Substring hashes are polynomials modulo this prime, at two random bases. Modulo a power of two structured strings (a Thue-Morse
#: string and its complement) would be equal at any base; modulo the prime two unequal strings of n bytes are so with a chance of n / 2**61.
PRIME = (1 << 61) - 1
_RANDOM = np.random.default_rng(20240607)
BASE = [int(_RANDOM.integers(1 << 40, PRIME)) for _ in range(2)]
_POWERS: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
_LOW31, _LOW30, _LOW61 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Bytes whose terms a difference of sums holds without overflow; longer substrings are summed in parts.
_SPAN = 1 << 24
_STEP = 0x9E3779B97F4A7C15
BYTE_VALUE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)


def _times(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """x (less than 2**62) times high * 2**31 + low, modulo PRIME up to one multiple of it."""
    x = (x & _LOW61) + (x >> _61)
    x1, x0 = x >> _31, x & _LOW31
    middle = x1 * low
    middle += x0 * high
    x1 *= high
    x1 <<= np.uint64(1)
    x0 *= low
    x1 += x0
    x1 += middle >> _30
    middle &= _LOW30
    middle <<= _31
    x1 += middle
    return (x1 & _LOW61) + (x1 >> _61)


def _powers(which: int, inverse: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(n-1) modulo PRIME, as high and low parts of 30 and 31 bits."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have[0]) < n:
        base = pow(BASE[which], -1, PRIME) if inverse else BASE[which]
        size = 1 << max(16, int(n - 1).bit_length())
        value = np.ones(size, np.uint64)
        k = 1
        while k < size:
            step = pow(base, k, PRIME)
            value[k : 2 * k] = _times(value[:k], np.uint64(step >> 31), np.uint64(step & ((1 << 31) - 1)))
            k *= 2
        value = np.where(value >= _LOW61, value - _LOW61, value)
        have = value >> _31, value & _LOW31
        if size <= 1 << 20:
            _POWERS[which, inverse] = have
    return have[0][:n], have[1][:n]


def tidy() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers stay alive between tasks and would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches, and ``tidy`` when they end."""

    def tidying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidying


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Hashes:
    """Hashes of any substrings of a byte buffer, by prefix sums of a polynomial modulo PRIME; equal strings have equal hashes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, n = which, len(data)
        value = data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for part in _powers(which, False, n):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(part * value, out=sums[1:])
            self.sums.append(sums)

    def _hash(self, high: np.ndarray, low: np.ndarray, inverse: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """From differences of sums, which are exact modulo 2**64."""
        value = (low & _LOW61) + (low >> _61) + ((high & _LOW30) << _31) + (high >> _30)
        value = _times(value, *inverse)
        return mix(np.where(value >= _LOW61, value - _LOW61, value))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.sums
        inverse = tuple(x[start] for x in _powers(self.which, True, len(high)))
        if not len(start) or (end - start).max() <= _SPAN:
            return self._hash(high[end] - high[start], low[end] - low[start], inverse)
        out = self._hash(high[end] - high[start], low[end] - low[start], inverse)
        for i in np.flatnonzero(end - start > _SPAN):
            cuts = [*range(int(start[i]), int(end[i]), _SPAN), int(end[i])]
            total = sum((int(high[b] - high[a]) << 31) + int(low[b] - low[a]) for a, b in zip(cuts, cuts[1:]))
            at = _powers(self.which, True, len(high))
            value = total % PRIME * ((int(at[0][start[i]]) << 31) + int(at[1][start[i]])) % PRIME
            out[i : i + 1] = mix(np.array([value], np.uint64))
        return out

    def windows(self, width: int) -> np.ndarray:
        """The hash of every substring of ``width`` bytes, in order."""
        high, low = (x[width:] - x[:-width] for x in self.sums)
        return self._hash(high, low, _powers(self.which, True, len(high)))


def anchors(data: np.ndarray, width: int) -> np.ndarray:
    """A scrambled value of every substring of ``width`` bytes, from values of its halves: cheaper than ``Hashes`` where all are
    wanted. Equal substrings have equal values; whether substrings of equal values are equal is for a hash of them to decide."""
    value, size = BYTE_VALUE[data], 1
    while size < width:
        step = min(size, width - size)  # halves may overlap
        right = value[step:]
        left = value[:-step] >> np.uint64(29)
        left ^= value[:-step]
        left *= np.uint64(_STEP)
        left += right
        value, size = left, size + step
    return mix(value)


def string_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each of the strings that lie one after another in a buffer, in bounded memory."""
    out = [Hashes(data[offsets[i] : offsets[j]]).of(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(token: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A value for each run of ``size`` hashes, equal for equal runs. It finds candidates, whose hashes are compared afterwards."""
    power = np.full(len(token), np.uint64(_STEP))
    power[:1] = 1
    back = np.full(len(token), np.uint64(pow(_STEP, -1, 1 << 64)))
    back[:1] = 1
    sums = np.append(np.uint64(0), np.cumsum(mix(token) * np.multiply.accumulate(power), dtype=np.uint64))
    return (sums[at + size] - sums[at]) * np.multiply.accumulate(back)[at]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one buffer, and the offsets of the texts in it."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_binary()) for c in column.chunks], pa.large_binary()).combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    np.logical_or(~solid[:-1], edge[1:-1], out=before[1:])
    start = np.flatnonzero(solid & before)
    after = np.empty(len(data), bool)
    after[-1:] = True
    np.logical_or(~solid[1:], edge[1:-1], out=after[:-1])
    end = np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte strings data[start:end], as one Arrow array."""
    size = end - start
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    if len(start) and (start[1:] == end[:-1]).all():  # one after another: no copy by place
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[start[0] : end[-1]]))])
    where = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[where]))])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as sorted disjoint maximal runs (runs that touch are one)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]

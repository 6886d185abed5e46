"""Vectorised hashing of text inside Spark tasks.

Everything here works on the bytes of many documents laid end to end: one
``uint8`` array and the documents' offsets in it.  Hashes only select
candidates; operators verify with whole contents or 128-bit digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


_POW_CACHE: dict[int, np.ndarray] = {}


def _cached_powers(base: int, n: int) -> np.ndarray:
    got = _POW_CACHE.get(base)
    if got is None or len(got) < n:
        got = _POW_CACHE[base] = _powers(base, max(n, 1 << 16))
    return got[:n]


def gram_hashes(values: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, or of those that start ``at`` some places, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, length, acc, acc_len = values, 1, None, 0
    rest = k
    while True:
        if rest & 1:
            if acc is None:
                acc, acc_len = power, length
            else:
                m = len(values) - acc_len - length + 1
                acc = acc[:m] * U(pow(base, length, 1 << 64))
                acc += power[acc_len : acc_len + m]
                acc_len += length
        rest >>= 1
        if not rest:
            break
        shifted = power[length:]
        power = power[: len(power) - length] * U(pow(base, length, 1 << 64))
        power += shifted
        length *= 2
    return mix(acc[:n] if at is None else acc[at])


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    out, length = values, 1
    while 2 * length <= w:
        out = np.minimum(out[: len(out) - length], out[length:])
        length *= 2
    if length < w:
        out = np.minimum(out[:n], out[w - length : w - length + n])
    return out[:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def chunks(offsets: np.ndarray, most: int = 500_000):
    """Ranges of rows that hold about ``most`` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of items in benchmark matching, after A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are ``inside``, never across documents.

    Returns starts, ends, hashes and the documents' offsets among the words.
    """
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    ok = inside[buf]
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = ok[edges]
    last[edges - 1] = ok[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[buf] * _cached_powers(_BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _cached_powers(_BASE_INV, n)[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64) * U(0xA24BAED4963EE407)), np.searchsorted(starts, offsets)


class ByteWindows:
    """Windows of ``size`` bytes, each named by the least hash of the ``gram``-byte strings in it."""

    def __init__(self, size: int = 50, gram: int = 24):
        self.size, self.gram = size, gram

    def units(self, buf, offsets):
        return _TABLE[buf], offsets, None


class WordWindows:
    """Windows of ``size`` white-space words, each named by the least hash of the ``gram``-word strings in it."""

    def __init__(self, size: int = 13, gram: int = 5):
        self.size, self.gram = size, gram

    def units(self, buf, offsets):
        starts, ends, hashes, off = words(buf, offsets, ~SPACE)
        return hashes, off, (starts, ends)


def window_runs(spec, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document that share the same name: starts, ends, names.

    A window's name depends on its content alone, so equal windows always get
    the same name: joining on names loses no repeat.  Names change about twice
    in (size - gram + 2) units.
    """
    size = spec.size
    names = sliding_min(gram_hashes(values, spec.gram), size - spec.gram + 1)
    empty = np.empty(0, np.int64)
    if not len(names):
        return empty, empty, np.empty(0, np.uint64)
    good = np.ones(len(names), bool)
    for a, b in zip(np.maximum(offsets[:-1], offsets[1:] - size + 1).tolist(), offsets[1:].tolist()):
        good[a:b] = False
    # a run never crosses documents, even where the next starts with the same name
    new = np.ones(len(names) + 1, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:-1])
    new[offsets[:-1][offsets[:-1] < len(names)]] = True
    new[1:-1] |= ~good[:-1]
    ends = new[1:].copy()
    ends[:-1] |= ~good[1:]
    starts = np.flatnonzero(new[:-1] & good)
    return starts, np.flatnonzero(ends & good) + 1, names[starts]


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    k = np.searchsorted(ordered, values)
    k[k == len(ordered)] = 0
    return ordered[k] == values

"""Vectorised views of Arrow text columns, shared by the operators that run on Arrow batches.

A batch of texts is looked at as one byte buffer with offsets.  Words are maximal runs
of bytes other than space and 0x09-0x0D; every word gets a 64-bit polynomial hash
from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial; its inverse modulo 2**64 removes the position.
BASE = 0x9E3779B97F4A7C15
INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim  # not every C library has it
except (OSError, AttributeError):
    _LIBC = None


def trim() -> None:
    """Gives memory that is free in this process back to the system: workers are used again, and what one task needed should not stay with the next one's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Texts are handled in slices of about so many bytes, which bounds the working memory.
SLICE = 2 << 20


def _powers(n: int, b: int) -> np.ndarray:
    out = np.full(n, b, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def powers(n: int, b: int = BASE) -> np.ndarray:
    if b not in _POW or len(_POW[b]) < n:
        _POW[b] = _powers(max(n, SLICE + (1 << 18)), b)
    return _POW[b][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE):
    """(first row, end row, bytes, offsets) of runs of whole texts of about so many bytes."""
    raw, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of several texts: starts, ends (bytes), first (n + 1 word offsets of the texts), hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.raw = raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~SPACE[raw]
        begin = inside[1:-1] & ~inside[:-2]
        cut = offsets[1:-1]
        cut = cut[cut < len(raw)]
        begin[cut] = inside[1:-1][cut]
        self.starts = np.flatnonzero(begin)
        stop = inside[1:-1] & ~inside[2:]
        last = offsets[1:-1] - 1
        last = last[last >= 0]
        stop[last] = inside[1:-1][last]
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = span_hash(raw, self.starts, self.ends) if hashes else None

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words at every start, and where they stay inside one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(BASE) + self.hash[i : n - k + 1 + i]
        end = np.repeat(self.first[1:], np.diff(self.first))
        return mix(out), np.arange(n - k + 1) + k <= end[: n - k + 1]


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial: the hash of [s, e) is (P[e] - P[s]) / BASE**s."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    sums = prefix(raw) if sums is None else sums
    x = (sums[ends] - sums[starts]) * powers(len(raw) + 1, INV)[starts]
    return mix(x + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the place of its least value (the first of equals)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # least of runs of 1, 2, 4 ... values; two runs that overlap make w
    least, size = h, 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < w:
        least = np.minimum(least[: n], least[w - size : w - size + n])
    least = least[:n]
    # a run of equal least values keeps its place until the run passes it
    change = np.flatnonzero(changes(least))
    stop = np.append(change[1:], n)
    # values that are the least of some run: few, so the first fitting one is near
    top, size = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), 1
    while 2 * size <= w:
        top, size = np.maximum(top[:-size], top[size:]), 2 * size
    if size < w:
        top = np.maximum(top[: len(h)], top[w - size : w - size + len(h)])
    chosen = np.flatnonzero(h == top[: len(h)])
    value, k = least[change], np.searchsorted(chosen, change)
    open_ = np.flatnonzero(h[chosen[k]] != value)
    while len(open_):
        k[open_] += 1
        open_ = open_[h[chosen[k[open_]]] != value[open_]]
    at = chosen[k]
    place = np.repeat(at, stop - change)
    late = np.flatnonzero(place < np.arange(n))  # equal values within w of each other
    for d in range(w):
        if not len(late):
            break
        hit = h[late + d] == least[late]
        place[late[hit]] = late[hit] + d
        late = late[~hit]
    return place


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first always does."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Which bytes of a number a mask names.
_PLANES = [np.flatnonzero([m >> i & 1 for i in range(8)]) for m in range(256)]
#: Arrays of up to so many numbers are not compressed one by one: a corpus of n slices sends n buckets such arrays each, and the shuffle compresses them together.
SMALL = 1 << 10


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes; planes of zeros take no room, others no more than their bytes."""
    x = np.ascontiguousarray(x).view(np.uint64)
    n = len(x)
    if not n:
        return bytes(6)
    top = int(np.bitwise_or.reduce(x))
    mask = sum(1 << i for i in range(8) if top >> 8 * i & 255)
    planes = x.view(np.uint8).reshape(-1, 8)[:, _PLANES[mask]].T
    head = n.to_bytes(6, "little") + bytes([mask])
    if n <= SMALL:
        return head + planes.tobytes()
    out = [head]
    for plane in np.ascontiguousarray(planes):
        raw = plane.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if np.count_nonzero(np.bincount(plane[:4096])) < 200 else raw
        small = small if len(small) < n else raw
        out += [len(small).to_bytes(6, "little"), small]
    return b"".join(out)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:6], "little")
    out = np.zeros((n, 8), np.uint8)
    if not n:
        return out.view(np.uint64).ravel()
    own, at = _PLANES[data[6]], 7
    if n <= SMALL:
        out[:, own] = np.frombuffer(data, np.uint8, n * len(own), at).reshape(-1, n).T
        return out.view(np.uint64).ravel()
    for i in own.tolist():
        size = int.from_bytes(data[at : at + 6], "little")
        raw = data[at + 6 : at + 6 + size]
        out[:, i] = np.frombuffer(raw if size == n else pa.decompress(raw, n, codec="zstd", asbytes=True), np.uint8)
        at += 6 + size
    return out.view(np.uint64).ravel()


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, its first value first; cumsum undoes it."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))

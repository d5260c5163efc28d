"""UTF-8 texts of an Arrow column as flat byte arrays, and hashes of their tokens.

Everything here works on one bounded slice of documents inside a task.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX
    h = h ^ (h >> _SHIFT)
    h = h * _MIX
    return h ^ (h >> _SHIFT)


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grow(_BASE, n), self._grow(_INVERSE, n)
        return self.up, self.down

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        p, m = np.ones(n, np.uint64), 1
        while m < n:
            k = min(m, n - m)
            p[m:m + k] = p[:k] * np.uint64(pow(base, m, 1 << 64))
            m += k
        return p


POWERS = Powers()


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
                              else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of documents of at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def cut(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


NOT_BLANK = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tokens(data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
    """Starts and ends of maximal runs of member bytes, none across documents; first token of each document."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = members[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[full] = inside[full]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code * base**position, from which the hash of any stretch follows."""
    up, _ = POWERS.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.multiply(codes, up[:len(codes)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of tokens; equal bytes give equal hashes in every slice."""
    return stretch_hashes(prefix_sums(BYTE_CODES[data]), starts, ends)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = prefix_sums(codes)
    _, down = POWERS.upto(n)
    h = sums[k:] - sums[:-k]
    h *= down[:n]
    del sums
    h ^= h >> _SHIFT
    h *= _MIX
    h ^= h >> _SHIFT
    return h


def sliding(values: np.ndarray, width: int, combine=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values."""
    out, step = values, 1
    while step * 2 <= width:
        out = combine(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return combine(out[:-rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a stretch of ``length`` from one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0

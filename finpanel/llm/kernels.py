"""Vectorised byte and word kernels on the buffers of Arrow string columns.

All of them work on a flat UTF-8 buffer with document offsets. A null text is an empty one here; operators that
tell the two apart do so on the column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers, and seeds of the two hashes; any odd 64-bit values would do.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
SPACE = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])
#: ASCII digits, lower-case letters and everything outside ASCII.
ALNUM = np.array([48 <= i <= 57 or 97 <= i <= 122 or i >= 128 for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)

P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values of XXH64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur finaliser)."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of member bytes; runs end with their document."""
    inside = member[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, doc


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << U64(r) | x >> U64(64 - r)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each row of a matrix of bytes."""
    n, length = rows.shape
    at = 0
    with np.errstate(over="ignore"):
        s = U64(seed)
        if length >= 32:
            lanes = np.ascontiguousarray(rows[:, : length // 32 * 32]).view("<u8")
            v = [np.full(n, x, dtype=U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for i in range(0, lanes.shape[1], 4):
                v = [_round(v[j], lanes[:, i + j]) for j in range(4)]
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(n, dtype=U64), x)) * P1 + P4
            at = length // 32 * 32
        else:
            h = np.full(n, s + P5, dtype=U64)
        h += U64(length)
        if length - at >= 8:
            lanes = np.ascontiguousarray(rows[:, at : at + (length - at) // 8 * 8]).view("<u8")
            for i in range(lanes.shape[1]):
                h = _rotl(h ^ _round(np.zeros(n, dtype=U64), lanes[:, i]), 27) * P1 + P4
            at += lanes.shape[1] * 8
        if length - at >= 4:
            lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(U64)
            h = _rotl(h ^ lane * P1, 23) * P2 + P3
            at += 4
        for i in range(at, length):
            h = _rotl(h ^ rows[:, i].astype(U64) * P5, 11) * P1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
    return h


def xxh64_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range."""
    out = np.empty(len(start), dtype=U64)
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(order)).tolist(), strict=True):
        n = int(ordered[a]) if b > a else 0
        most = max(1, (8 << 20) // max(n, 1))
        for i in range(a, b, most):
            rows = order[i : min(i + most, b)]
            cells = np.lib.stride_tricks.sliding_window_view(data, n)[start[rows]] if n else np.zeros((len(rows), 0), np.uint8)
            out[rows] = xxh64(cells, seed)
    return out


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: equal bytes have equal hashes, whatever their place."""
    return xxh64_ranges(data, start, end - start, BASES[which])


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The hash of each k consecutive word hashes, ignoring documents; k - 1 fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    base = U64(BASES[which])
    for j in range(k):
        h ^= h >> U64(32)  # no polynomial: those have collisions for any base
        h *= base
        h += words[j : j + n]
    return mix(h)


def gram_inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-grams lie in one document."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:n]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)

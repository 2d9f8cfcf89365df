"""Vectorised text primitives shared by the Arrow-batch kernels.

Everything here works on the UTF-8 buffer of an Arrow string column, so no
Python string is made per word.  White space is ``[\\x20\\x09-\\x0D]``, which is
ASCII and therefore safe to find on bytes.  Hashes are 64-bit polynomials over
a fixed random byte table, finished by a multiply-xor mixer; two different
words collide with probability about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_C = U64(0xD6E8FEB86659FD93)
_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached up to 4M entries."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = out
        if size <= 1 << 22:
            _POWERS[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(col, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column holding about max_bytes each (one row at least)."""
    _, off = text_buffer(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    full = off[:-1][off[1:] > off[:-1]]  # the first bytes of rows that have any
    start[full] = word[full]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; values are uint64 symbols."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(_P, len(values)), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_P_INV, len(values))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _C)


def words(col, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column and the index of each row's first word (n + 1 values)."""
    buf, off = text_buffer(col)
    starts, ends, first = word_spans(buf, off)
    return span_hashes((_BYTE_LOWER if lower else _BYTE)[buf], starts, ends), first


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, rows ignored: len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _C
        out += h[j : j + n]
    return mix(out)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a run of k words of one row starts."""
    n = np.diff(first) - (k - 1)
    n = np.maximum(n, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return base + np.arange(total)


def ragged(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that gather the given rows of a ragged array one after the other, and their new offsets."""
    n = first[rows + 1] - first[rows]
    new = np.concatenate(([0], np.cumsum(n)))
    if not new[-1]:
        return np.zeros(0, np.int64), new
    return np.repeat(first[rows] - new[:-1], n) + np.arange(new[-1]), new


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def all_words(col, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """words() of a whole column, worked off in pieces so that byte-level arrays stay small."""
    parts, first, total = [], [np.zeros(1, np.int64)], 0
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.array([], pa.string())
    for i, j in pieces(col):
        h, f = words(col.slice(i, j - i), lower)
        parts.append(h)
        first.append(f[1:] + total)
        total += len(h)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(first)


def string_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and n + 1 offsets."""
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def kept_words(col, keep: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space; keep has a flag for each word of the column."""
    out, at = [], 0
    for i, j in pieces(col):
        buf, off = text_buffer(col.slice(i, j - i))
        starts, ends, first = word_spans(buf, off)
        flags = keep[at : at + len(starts)]
        at += len(starts)
        rows = row_of(first)[flags]
        starts, n = starts[flags], (ends - starts)[flags] + 1
        to = np.concatenate(([0], np.cumsum(n)))
        data = np.full(to[-1], 32, np.uint8)
        at_byte = np.repeat(starts - to[:-1], n) + np.arange(to[-1])
        inside = np.ones(to[-1], bool)
        inside[to[1:] - 1] = False
        data[inside] = buf[at_byte[inside]]
        # the space after a row's last word goes
        last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, np.int64)
        drop = np.zeros(to[-1], bool)
        drop[to[last + 1] - 1] = True
        size = np.bincount(rows, weights=n, minlength=j - i).astype(np.int64) - (np.bincount(rows, minlength=j - i) > 0)
        out.append(string_array(data[~drop], np.concatenate(([0], np.cumsum(size)))))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())

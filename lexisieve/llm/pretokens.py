"""Splitting into pre-tokens with arrays, and a cache of what each distinct one encodes to.

The split is that of public_tokenizers.PATTERN: contractions, letters, digits
and other signs with one leading space, and runs of white space whose last
character stays with what follows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexisieve.llm import arrays as A

OTHER, LETTER, DIGIT, SPACE = range(4)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        kind = np.zeros(0x110000, np.uint8)
        kind[:] = [{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
        kind[WHITE] = SPACE
        _TABLES.extend((kind, A.mix(np.arange(1, 0x110001, dtype=np.uint64))))
    return _TABLES[0], _TABLES[1]


def split(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all pre-tokens of rows of code points, and the index of each row's first (n + 1 values)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _tables()[0][codes]
    row = np.zeros(n + 1, bool)
    row[off[:-1][off[1:] > off[:-1]]] = True
    row[n] = True
    start = row[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    last = white & ~row[1:] & ~np.append(white[1:], True)  # a word follows in the same row
    start |= last
    start[1:][(last & (codes == 32))[:-1]] = False
    at = np.flatnonzero(start & (codes == 39))
    if len(at):
        padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
        edge = np.concatenate((row, np.ones(2, bool)))
        one, two = np.where(edge[at + 1], 0, padded[at + 1]), np.where(edge[at + 1] | edge[at + 2], 0, padded[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[at[short | pair] + 1] = False
        for found, size in ((at[short], 2), (at[pair], 3)):
            end = found + size
            start[end[end < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, off)


class Encoder:
    """Encodes string columns; each distinct pre-token is encoded once per cache fill by `one`: str -> list of ids."""

    def __init__(self, one: Callable[[str], list[int]], cache: int = 600_000):
        self.one, self.cache = one, cache
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, fresh: dict[int, str]) -> None:
        lists = [self.one(t) for t in fresh.values()]
        n = len(self.known)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in lists for i in x), np.int32)))
        known = np.concatenate((self.known, np.fromiter(fresh, np.uint64, len(fresh))))
        slot = np.concatenate((self.slot, np.arange(n, n + len(fresh))))
        order = np.argsort(known)
        self.known, self.slot = known[order], slot[order]

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column and n + 1 offsets; null counts as empty."""
        col = pc.fill_null(col, "")
        codes = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), "<u4")
        off = np.concatenate(([0], np.cumsum(pc.utf8_length(col).to_numpy(zero_copy_only=False), dtype=np.int64)))
        starts, rows = split(codes, off)
        ends = np.append(starts[1:], len(codes))
        h = A.span_hashes(_tables()[1][codes], starts, ends)
        uniq, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, uniq), max(0, len(self.known) - 1))
        new = self.known[place] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            if len(self.known) > self.cache:
                self.__init__(self.one, self.cache)
                new[:] = True
            raw = codes.tobytes()
            self._learn({int(u): raw[4 * starts[k] : 4 * ends[k]].decode("utf-32-le") for u, k in zip(uniq[new], index[new], strict=True)})
        token = self.slot[np.searchsorted(self.known, uniq)][inverse] if len(uniq) else np.zeros(0, np.int64)
        at, to = A.ragged(self.first, token)
        return self.ids[at], to[rows]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(name: str, make: Callable[[], Callable[[str], list[int]]]) -> Encoder:
    """The Encoder of this Python worker for one vocabulary; it outlives the task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(make())
    return _ENCODERS[name]


def id_lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))

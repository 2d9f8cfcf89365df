"""Exact substring de-duplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of 10 words, the reference
index; every rolling 10-word window of every document probes it.  A window of
20 words always holds one whole block of each of its occurrences, so each
repeat of 20 words or more has a hit on both sides.  A hit is extended to both
sides, as far as a window of 20 words that holds it: of each such window all
but the first occurrence are marked, and marks that overlap or follow one
another grow together to the maximal exact repeats, whose words go.  Extension
works on windows and not on pairs of a hit's two sides, as a passage in a third
of all documents has quadratically many pairs.

Anchors and probes travel as 32-bit remainders inside hash-range buckets (a
false hit only costs a comparison); windows as two 64-bit hashes of their
words' hashes with the document in which the chunk sees them first, so that two
different windows out of 10**13 meet with odds of about 10**-13.  Answers are
bits in the chunk's own order.  The documents are exchanged once: the three
passes share the exchange.

Defined results: a null or blank text has no words and its text stays as it
is; rows of equal doc_id are taken in the order of a hash of their texts; rows
without a doc_id come after all others in the same order; repeated rows count
as copies, one of which is first; extra columns are carried along;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.llm import arrays as A
from lexisieve.llm import chunks as C

LAST = np.iinfo(np.int64).max
SECOND = np.uint64(0xA5A5A5A5A5A5A5A5)
SENT = "bucket long, chunk long, entries binary, flags binary"
ANSWER = "chunk long, bucket long, stage int, bits binary"


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _text(table: pa.Table):
    col = table.column("text")
    return col.chunk(0) if col.num_chunks == 1 else col.combine_chunks()


class Chunk:
    """Word hashes of a chunk, its rolling windows of `block` words and their bucket-and-remainder keys."""

    def __init__(self, table: pa.Table, block: int, buckets: int):
        self.table = _ordered(table)
        self.block = block
        self.h, self.first = A.all_words(_text(self.table)) if len(self.table) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.at = A.within(self.first, block)
        self.grams = A.ngrams(self.h, block)
        self.others = A.ngrams(A.mix(self.h ^ SECOND), block)
        own = self.grams[self.at]
        self.keys = (C.bucket_of(own, buckets) << np.uint64(32)) | (own & np.uint64(0xFFFFFFFF))
        self.uniq, self.counts = np.unique(self.keys, return_counts=True)

    def anchored(self) -> np.ndarray:
        """Flags over uniq: the value is that of a reference block."""
        offset = self.at - self.first[A.row_of(self.first)[self.at]] if len(self.at) else self.at
        out = np.zeros(len(self.uniq), bool)
        out[np.searchsorted(self.uniq, np.unique(self.keys[offset % self.block == 0]))] = True
        return out

    def windows(self, hits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes (two each) of the windows of `size` words that hold a hit; hits are flags over uniq."""
        value = self.uniq[hits]
        hit = np.zeros(len(self.h) + 1, np.int64)
        if len(value):
            place = np.minimum(np.searchsorted(value, self.keys), len(value) - 1)
            hit[self.at[value[place] == self.keys] + 1] = 1
        total = np.cumsum(hit)
        start = A.within(self.first, size)
        start = start[total[start + (size - self.block) + 1] > total[start]]
        out = np.zeros((len(start), 2), np.uint64)
        for j in range(0, size, self.block):
            step = min(j, size - self.block)
            out[:, 0] = A.mix(out[:, 0] + self.grams[start + step])
            out[:, 1] = A.mix(out[:, 1] + self.others[start + step])
        return start, out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two hashes each, ascending, and where each comes first."""
    order = np.lexsort((h[:, 1], h[:, 0]))  # stable: of equal rows the first stays first
    lead = _leads(h[order])
    return h[order][lead], order[lead]


def _leads(h: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the row before."""
    return np.append(True, (h[1:] != h[:-1]).any(axis=1)) if len(h) else np.zeros(0, bool)


def _probe(block: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = Chunk(table, block, buckets)
        flags, many = chunk.anchored(), chunk.counts > 1
        rows = [(b, C.pack_sorted((chunk.uniq[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), np.packbits(flags[i:j]).tobytes() + np.packbits(many[i:j]).tobytes()) for b, i, j in C.cuts(chunk.uniq >> np.uint64(32))]
        return _sent(rows, key)

    return run


def _sent(rows: list, key) -> pa.Table:
    number = key[0].as_py()
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([number] * len(rows), pa.int64()), "entries": A.binaries([r[1] for r in rows]), "flags": A.binaries([r[2] for r in rows])})


def _answered(table: pa.Table, key, stage: int, answers: list[np.ndarray]) -> pa.Table:
    n = len(answers)
    return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * n, pa.int64()), "stage": pa.array([stage] * n, pa.int32()), "bits": A.binaries([np.packbits(a).tobytes() for a in answers])})


def _match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Which anchors and probes of one bucket meet: a reference block's value that occurs at least twice."""
    lists = [C.unpack_sorted(x) for x in table.column("entries").to_pylist()]
    flags = [f for f in table.column("flags").to_pylist()]
    half = [(len(v) + 7) // 8 for v in lists]
    anchored = np.concatenate([C.bits(f[:m], len(v)) for f, v, m in zip(flags, lists, half, strict=True)])
    many = np.concatenate([C.bits(f[m:], len(v)) for f, v, m in zip(flags, lists, half, strict=True)])
    value, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    n = count + np.bincount(place[many], minlength=len(value))
    hit = (n > 1) & (np.bincount(place[anchored], minlength=len(value)) > 0)
    per = hit[place]
    return _answered(table, key, 1, np.split(per, np.cumsum([len(v) for v in lists])[:-1]))


def _hits(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """Stage 1 answers as flags over chunk.uniq."""
    return _flags(answers, 1, C.cuts(chunk.uniq >> np.uint64(32)), len(chunk.uniq))


def _flags(answers: pa.Table, stage: int, runs: list, n: int) -> np.ndarray:
    got = {(s, b): x for s, b, x in zip(answers.column("stage").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)}
    out = np.zeros(n, bool)
    for b, i, j in runs:
        out[i:j] = C.bits(got[stage, b], j - i)
    return out


def _extend(block: int, size: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, block, buckets)
        start, h = chunk.windows(_hits(chunk, answers), size)
        uniq, index = _distinct(h)
        ids = chunk.table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        row = np.searchsorted(chunk.first, start[index], "right") - 1
        rows = [(b, uniq[i:j].tobytes(), C.pack_ints(ids[row[i:j]])) for b, i, j in C.cuts(C.bucket_of(uniq[:, 0], buckets))]
        return _sent(rows, key)

    return run


def _settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each window of one bucket, which chunk holds its first occurrence."""
    lists = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("entries").to_pylist()]
    ids = np.concatenate([C.unpack_ints(x) for x in table.column("flags").to_pylist()])
    size = np.array([len(v) for v in lists])
    chunk = np.repeat(table.column("chunk").to_numpy(), size)
    value = np.concatenate(lists)
    order = np.lexsort((chunk, ids, value[:, 1], value[:, 0]))
    per = np.zeros(len(value), bool)
    per[order[_leads(value[order])]] = True
    return _answered(table, key, 2, np.split(per, np.cumsum(size)[:-1]))


def _remove(block: int, size: int, buckets: int, names: list[str], keep_clean: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs, block, buckets)
        start, h = chunk.windows(_hits(chunk, answers), size)
        uniq, index = _distinct(h)
        first = _flags(answers, 2, C.cuts(C.bucket_of(uniq[:, 0], buckets)), len(uniq))
        repeat = np.ones(len(start), bool)
        repeat[index[first]] = False
        edge = np.zeros(len(chunk.h) + 1, np.int64)
        np.add.at(edge, start[repeat], 1)
        np.add.at(edge, start[repeat] + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[chunk.first[1:]] - total[chunk.first[:-1]]
        text = A.kept_words(_text(chunk.table), ~gone)
        if keep_clean:
            text = pa.compute.if_else(pa.array(n_removed == 0), _text(chunk.table).cast(pa.string()), text)
        out = {n: text if n == "text" else chunk.table.column(n) for n in names}
        return pa.table(out | {"n_words": pa.array(np.diff(chunk.first)), "n_removed": pa.array(n_removed.astype(np.int64))})

    return run


def remove_repeats(docs: DataFrame, size: int = 20, block: int = 10, keep_clean: bool = False) -> DataFrame:
    """docs with repeated passages cut out of text, and the columns n_words and n_removed.

    A word goes if a window of `size` consecutive words that covers it also
    starts earlier (in a smaller doc_id, or earlier in the document).  text
    becomes the kept words joined by one space; with keep_clean a text that
    loses nothing stays as it is.  2 * block - 1 <= size must hold, or a window
    need not contain a whole block.
    """
    if not 0 < 2 * block - 1 <= size:
        raise ValueError("a window has to contain a whole block: 2 * block - 1 <= size")
    import pyarrow.compute  # noqa: F401

    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "chunk")]
    docs, buckets, _ = C.chunked(docs.select(names))
    by_chunk = docs.groupBy("chunk")
    sent = by_chunk.applyInArrow(_probe(block, buckets), SENT)
    hits = sent.groupBy("bucket").applyInArrow(_match, ANSWER)
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(block, size, buckets), SENT)
    firsts = windows.groupBy("bucket").applyInArrow(_settle, ANSWER)
    schema = T.StructType([docs.schema[n] for n in names]).add("n_words", "long").add("n_removed", "long")
    answers = hits.unionByName(firsts).groupBy("chunk")
    return by_chunk.cogroup(answers).applyInArrow(_remove(block, size, buckets, names, keep_clean), schema)

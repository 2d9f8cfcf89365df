"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols.  Every adjacent pair that is in the
vocabulary waits in the bucket of its merge rank, which holds positions in the
list; a three-level bitmap over the ranks finds the lowest non-empty bucket by
find-first-set.  A merge links its symbol out and queues the two new pairs; an
entry whose pair has changed meanwhile is stale and is skipped when it comes
up.  The lowest rank is found in a constant number of steps; the positions of a
bucket lie in a heap, as equal ranks merge from the left, so a pre-token of n
bytes takes n log n steps at worst.

Defined results: a null text counts as empty and has no ids; repeated rows
have equal results; extra columns are carried along; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisieve.llm import arrays as A
from lexisieve.llm.pretokens import id_lists, worker_encoder


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class RankQueue:
    """Positions by rank; pop() gives the leftmost position of the lowest rank."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.low[a] = word = word & (word - 1)
            if not word:
                self.mid[b] &= self.mid[b] - 1
                if not self.mid[b]:
                    self.top &= top - 1
        return rank, position


class Merger:
    """Encodes single pre-tokens by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def encode(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        pairs, queue, byte = self.pairs.get, RankQueue(), self.byte
        ids = [byte[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [-1] * n  # the rank that each position waits for
        for i in range(n - 1):
            rank = pairs(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                due[i] = rank
                queue.push(rank, i)
        while (item := queue.pop()) is not None:
            rank, i = item
            if due[i] != rank:
                continue
            j = after[i]
            k = after[j]
            ids[i], after[i], due[j], due[i] = rank, k, -1, -1
            if k < n:
                before[k] = i
                new = pairs(rank << 32 | ids[k])
                if new is not None:
                    due[i] = new
                    queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = pairs(ids[h] << 32 | rank)
                if new is None:
                    due[h] = -1
                elif due[h] != new:
                    due[h] = new
                    queue.push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


def _encoder(ranks: dict[bytes, int], name: str):
    def run(batches):
        for batch in batches:
            encoder = worker_encoder(name, lambda: Merger(ranks).encode)
            text = batch.column(batch.schema.get_field_index("text"))
            for i, j in A.pieces(text, 2 << 20):
                lists = id_lists(*encoder.encode(text.slice(i, j - i)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), lists], names=[*batch.schema.names, "ids"])

    return run


def _decoder(tokens: list[bytes], ids: str):
    def run(batches):
        first = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            names = [n for n in batch.schema.names if n != ids]
            lists = batch.column(batch.schema.get_field_index(ids))
            for i in range(0, len(batch), 256):
                part = lists.slice(i, 256).fill_null([]) if lists.null_count else lists.slice(i, 256)
                flat, n = part.flatten().to_numpy(zero_copy_only=False), np.array([len(x) for x in part.to_numpy(zero_copy_only=False)], np.int64)
                at, to = A.ragged(first, flat.astype(np.int64))
                off = to[np.concatenate(([0], np.cumsum(n)))]
                got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n_).slice(i, 256) for n_ in [*names, ids]), got], names=[*names, ids, "decoded"])

    return run


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)])


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """docs with ids: array<int>, the byte-level BPE of text."""
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    ranks = ranks or default_ranks()
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return docs.mapInArrow(_encoder(ranks, name), _with(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids: str = "ids") -> DataFrame:
    """encoded with decoded: binary, the bytes that its ids stand for (not necessarily valid UTF-8)."""
    ranks = ranks or default_ranks()
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    encoded = encoded.drop("decoded")
    ordered = encoded.select(*[c for c in encoded.columns if c != ids], F.col(ids))
    return ordered.mapInArrow(_decoder(tokens, ids), _with(ordered, "decoded", T.BinaryType()))

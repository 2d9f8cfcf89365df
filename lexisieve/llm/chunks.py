"""All-to-all exchange between chunks of documents and buckets of hashes.

Corpus-wide questions about words or windows ("how often does it occur?",
"does it occur elsewhere?") are asked per chunk, a few megabytes of whole
documents: a chunk sends each of its distinct hashes once to the bucket that
owns the hash, and the bucket answers in the chunk's own order.  The answer
therefore needs no keys, often a single bit, and a hash that a third of all
documents share costs one entry per chunk.  Neither side grows with the corpus
beyond what its number of chunks or buckets is set to.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 1_500_000


def chunked(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs with a column chunk, the number of buckets that suits them, and their bytes of text.

    Documents are dealt by a hash of doc_id and text, so that neither copies
    nor rows of one doc_id gather.  Chunks and buckets grow with the square root
    of the corpus, from 4 to 64 MB and from BUCKET_ENTRIES to five times as
    many, so that a chunk keeps enough entries for each bucket.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    grown = max(1.0, math.sqrt(total / 2**31))
    size, entries = min(64 << 20, CHUNK_BYTES * grown), BUCKET_ENTRIES * min(5.0, grown)
    chunks = max(1, math.ceil(total / size))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), max(1, math.ceil(total / 6 / entries)), total


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The owner of each hash, ascending with the hash."""
    return ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of an ascending bucket column."""
    if not len(bucket):
        return []
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct uint32 values as gaps of 3 bytes where they fit, else 4."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype)).astype(np.uint32)
    if len(gaps) and gaps.max() < 1 << 24:
        return b"\3" + np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return b"\4" + gaps.astype("<u4").tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    if data[0] == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, :3] = raw.reshape(-1, 3)
        return np.cumsum(wide.view("<u4").ravel(), dtype=np.uint32)
    return np.cumsum(raw.view("<u4"), dtype=np.uint32)


def pack_ints(values: np.ndarray) -> bytes:
    """Any int64 values as offsets from the least one in as few bytes as the largest needs."""
    if not len(values):
        return b""
    least = int(values.min())
    rel = (values - least).astype("<u8")
    width = max(1, (int(rel.max()).bit_length() + 7) // 8)
    return least.to_bytes(8, "little", signed=True) + bytes([width]) + np.ascontiguousarray(rel.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    width, raw = data[8], np.frombuffer(data, np.uint8, offset=9)
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.view("<i8").ravel() + int.from_bytes(data[:8], "little", signed=True)


def bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)

"""MinHash near-duplicate removal by min-max hashing.

Each permutation yields two signature values, the smallest and the largest
hash of a document's shingle set; either one agrees between two sets with
probability equal to their Jaccard similarity, so a signature of 2p values
takes p hash evaluations per shingle.  Values of different permutations are
banded; documents that share a band are candidates, and every link is
confirmed on the full shingle sets.

Plan: documents with equal sets fall into one class (map-side combined
aggregate), classes are exploded into bands, each bucket names its smallest
member, and the star edges to it give candidate groups.  A candidate group is
compared exactly inside one task while it is small, by the rarest shingles of each set.  A larger one is dealt
out in chunks that share a few pivots; whatever the pivots have not tied to
the group's main component is then compared with all of the group, block by
block.  No pair is ever a row of a table: tasks return spanning edges.

Defined results: a null or blank text has an empty set and links with
nothing; a row with a null doc_id links with nothing, its component_id is null
and it is kept; rows sharing a doc_id count as one document (their n_shingles
are those of their own texts); extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm import arrays as A
from lexisieve.llm.spark_utils import connected_components, persist_table

SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"
SMALL = 600  # documents of a candidate group, or of a chunk of one, compared in one task
LONG = 4000  # shingles from which on a document counts as several of them
PIVOTS = 64


def shingles(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a string column (A-Z lower-cased) and row offsets; a text of fewer words is one shingle."""
    h, first = A.words(col, lower=True)
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(off[-1], np.uint64)
    full = np.repeat(n_words >= k, n)
    out[full] = A.ngrams(h, k)[A.within(first, k)]
    for short in range(1, k):
        rows = np.flatnonzero(n_words == short)
        if len(rows):
            out[off[rows]] = A.mix(A.ngrams(h, short)[first[rows]] + np.uint64(short))
    return out, off


def distinct_shingles(col, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    values, off = shingles(col, k)
    return [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1010))
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def band_keys(values: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) int64 keys from the min-max signatures of non-empty shingle sets."""
    n_perm = (bands * rows + 1) // 2
    mult, add = permutations(n_perm)
    low = (values >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((2 * n_perm, len(off) - 1), np.uint64)
    for p in range(n_perm):
        x = (low ^ add[p]) * mult[p]
        x ^= x >> np.uint32(15)
        sig[p] = np.minimum.reduceat(x, off[:-1])
        sig[n_perm + p] = np.maximum.reduceat(x, off[:-1])
    keys = np.empty((len(off) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(off) - 1, b + 1, np.uint64)
        for r in range(rows):
            key = A.mix(key ^ (sig[(b + r * bands) % (2 * n_perm)] + np.uint64(0x9E3779B97F4A7C15)))
        keys[:, b] = key
    return keys.view(np.int64)


def sketcher(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for i, j in A.pieces(text):
                values, off = shingles(text.slice(i, j - i), k)
                n = np.zeros(j - i, np.int64)
                fp = np.zeros((2, j - i), np.uint64)
                for r in np.flatnonzero(np.diff(off)):
                    u = np.unique(values[off[r] : off[r + 1]])
                    n[r], fp[0, r], fp[1, r] = len(u), u.sum(), A.mix(u ^ np.uint64(0xABCDEF)).sum()
                some = np.flatnonzero(n)
                keys = np.zeros((0, bands), np.int64)
                if len(some):
                    keys = band_keys(values, np.append(off[some], off[-1]), bands, rows)
                sizes = np.zeros(j - i, np.int64)
                sizes[some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def set_maker(k: int):
    """(doc_id, candidate group, text) -> (id, grp, packed sorted shingle hashes)."""

    def run(batches):
        for batch in batches:
            for i, j in A.pieces(batch.column(2)):
                part = batch.slice(i, j - i)
                packed = [s.tobytes() for s in distinct_shingles(part.column(2), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), A.binaries(packed)], names=["id", "grp", "shingles"])

    return run


def linked(sets: list[np.ndarray], queries: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning edges among sets of the links that queries have with any set: 100 * intersection >= percent * union.

    Two linked sets share one of their rarest shingles: with at least
    percent / 100 of either set in common, one of the first n - ceil(percent *
    n / 100) + 1 of each in order of rarity is common.  Sets that meet there
    and aren't in one tree yet are counted in full.
    """
    sizes = np.array([len(s) for s in sets])
    off = np.concatenate(([0], np.cumsum(sizes)))
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_rarity = np.empty(len(counts), np.int64)
    by_rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(sets)), sizes)
    ranks = by_rarity[codes]
    order = np.lexsort((ranks, owner))
    ranks = ranks[order]  # each set's shingles, the rarest first
    head = sizes + (-percent * sizes) // 100 + 1
    early = np.flatnonzero(np.arange(len(ranks)) - off[owner] < head[owner])
    early = early[np.argsort(ranks[early], kind="stable")]
    postings, first = owner[early], np.concatenate(([0], np.cumsum(np.bincount(ranks[early], minlength=len(counts)))))
    root, edges, flag = np.arange(len(sets)), [], np.zeros(len(counts), bool)
    for q in queries:
        at, _ = A.ragged(first, ranks[off[q] : off[q] + head[q]])
        near = np.unique(postings[at])
        near = near[(root[near] != root[q]) & (100 * np.minimum(sizes[near], sizes[q]) >= percent * np.maximum(sizes[near], sizes[q]))]
        if not len(near):
            continue
        own = ranks[off[q] : off[q + 1]]
        flag[own] = True
        at, cuts = A.ragged(off, near)
        common = np.add.reduceat(flag[ranks[at]].astype(np.int64), cuts[:-1])
        flag[own] = False
        for m in near[100 * common >= percent * (sizes[q] + sizes[near] - common)]:
            if root[m] != root[q]:
                root[root == root[m]] = root[q]
                edges.append((int(q), int(m)))
    return edges


def comparer(percent: int):
    """A block of rows (grp, id, shingles, query) -> spanning edges (u, v) of the links of its queries, group by group."""

    def run(table: pa.Table) -> pa.Table:
        grp, ids = table.column("grp").to_numpy(), table.column("id").to_numpy()
        query, packed = table.column("query").to_numpy(), table.column("shingles").to_pylist()
        order = np.argsort(grp, kind="stable")
        cuts = np.flatnonzero(np.diff(grp[order])) + 1
        us, vs = [], []
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(packed[r], np.uint64) for r in rows]
            for a, b in linked(sets, np.flatnonzero(query[rows]), percent):
                us.append(ids[rows[a]])
                vs.append(ids[rows[b]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    return rows.groupBy("block").applyInArrow(comparer(percent), "u long, v long")


def components(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs (doc_id long, text string).

    Links join documents whose k-word shingle sets have a Jaccard similarity of
    at least percent / 100.  With the defaults a pair at the threshold 0.8 is
    missed with probability (1 - 0.8**6)**40 = 5e-6, one at 0.85 with 6e-9.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = persist_table(docs.mapInArrow(sketcher(k, bands, rows), SIGNATURE), "minhash-sketch")
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    key = ["fp1", "fp2", "n_shingles"]
    classes = persist_table(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "minhash-classes")

    banded = classes.select("rep", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head < tail").select("band", "head")
    stars = banded.join(heads, "band").where("rep <> head").select(F.col("rep").alias("u"), F.col("head").alias("v")).distinct()
    # rows that share a doc_id hold one document together
    same = usable.join(classes.select(*key, "rep"), key).groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("u", "v")
    same = persist_table(same, "minhash-same")
    groups = connected_components(stars.unionByName(same))
    members = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    # members grow with the corpus: a sort-merge join at any size
    sets = docs.join(members.hint("merge"), "doc_id").select("doc_id", "grp", "text").mapInArrow(set_maker(k), "id long, grp long, shingles binary")
    sets = persist_table(sets.distinct(), "minhash-sets")
    each = F.greatest(F.lit(1), F.ceil(F.length("shingles") / (8 * LONG)))  # what a document counts as
    sizes = persist_table(sets.groupBy("grp").agg(F.count("*").alias("n"), F.sum(each).alias("size")), "minhash-sizes")
    sets = sets.join(sizes, "grp")

    n_small = sizes.where(F.col("size") <= SMALL).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, n_small // 300)
    small = sets.where(F.col("size") <= SMALL).select(F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("string").alias("block"), "grp", "id", "shingles", F.lit(True).alias("query"))
    edges = _compare(small, percent)
    large = sets.where(F.col("size") > SMALL)
    if not large.limit(1).count():
        found = persist_table(edges.unionByName(same), "minhash-links")
    else:
        found = _large_links(large, edges.unionByName(same), percent)
    labels = connected_components(found)
    out = (
        sketch.join(classes.select(*key, "rep"), key, "left")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _large_links(large: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links inside candidate groups of more than SMALL documents, added to edges."""
    n_chunks = F.ceil(F.col("size") / SMALL).cast("int")
    large = large.select("grp", "id", "shingles", "n", n_chunks.alias("chunks")).withColumn("rank", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    dealt = large.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("chunks")))
    own = dealt.select(F.concat_ws(":", "grp", "chunk").alias("block"), "grp", "id", "shingles", F.lit(True).alias("query"))
    # about PIVOTS documents of each group go to all its chunks
    pivots = large.where(F.col("rank") * F.col("n") < F.lit(PIVOTS) * F.lit(1 << 40))
    shared = pivots.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(F.concat_ws(":", "grp", "chunk").alias("block"), "grp", "id", "shingles", F.lit(True).alias("query"))
    first = persist_table(_compare(own.unionByName(shared), percent).unionByName(edges), "minhash-links")
    labels = connected_components(first)

    named = dealt.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = named.groupBy("grp", "component").agg(F.count("*").alias("many"))
    main = per.groupBy("grp").agg(F.max_by("component", F.struct("many", "component")).alias("main"))
    rest = persist_table(named.join(main, "grp").where("component <> main"), "minhash-rest")
    counts = rest.groupBy("grp").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("q_blocks"))
    ask = rest.join(counts, "grp").withColumn("q", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("q_blocks")))
    ask = ask.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to")).select(F.concat_ws(":", "grp", "q", "to").alias("block"), "grp", "id", "shingles", F.lit(True).alias("query"))
    answer = dealt.join(counts, "grp").select("*", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q")).select(F.concat_ws(":", "grp", "q", "chunk").alias("block"), "grp", "id", "shingles", F.lit(False).alias("query"))
    return persist_table(_compare(ask.unionByName(answer), percent).unionByName(first), "minhash-links")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one document of each near-duplicate group, documents without words among them.

    Of repeated rows, equal in doc_id and text, one stays; rows of one kept
    doc_id with different texts, and rows without a doc_id, all stay.
    """
    kept = components(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.where("doc_id is not null").join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))

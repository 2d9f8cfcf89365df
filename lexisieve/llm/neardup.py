"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are collapsed first.  Each vector has a home cell, that of its
nearest centroid; as a query it also visits every cell whose dividing
hyperplane is near enough to hide a link.  For a link of cosine t, a vector u
and a vector v on the other side of the hyperplane between their cells can
only meet if u's distance from it is at most sqrt(1 - t * t), so no link is
lost and each is counted once for either end: u visits v's only home cell and
v visits u's.  Cells are compared in blocks of bounded size; a block returns
counts and spanning edges, never pairs.

Defined results: a vector that is null, empty, zero, holds a null or
non-finite component, or has another length than most has no links and is its
own component; a row with a null vec_id as well, and its component_id is null;
repeated rows of one vec_id and vector count as one vector; rows of one vec_id
with different vectors are vectors of their own that share an id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm import vectors as V
from lexisieve.llm.spark_utils import connected_components, discard, persist_table

BLOCK = 8192
CELL = BLOCK  # vectors a cell is meant to hold: moving a vector to a cell costs as much as thousands of products
MIN_CELLS, MAX_CELLS = 8, 1024


def _assign(centroids: np.ndarray, threshold: float):
    """(id, n, embedding) -> those columns with cell and home, one row for each cell visited."""
    gap = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    reach = np.sqrt(1 - threshold * threshold) + 1e-9

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                s = V.unit(V.matrix(part.column(2))) @ centroids.T
                home = s.argmax(axis=1)
                row = np.arange(len(s))
                visits = s[row, home][:, None] - s <= reach * gap[home] + 1e-12
                visits[row, home] = True
                at, cell = np.nonzero(visits)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(cell), pa.array(cell == home[at])], names=["id", "n", "embedding", "cell", "home"])

    return run


def _links(threshold: float):
    """A block of rows (id, n, embedding, base) -> (u, n, v): linked vectors of each query, and spanning edges."""

    def run(table: pa.Table) -> pa.Table:
        own_id, n, base = (table.column(c).to_numpy() for c in ("id", "n", "base"))
        x = V.unit(V.matrix(table.column("embedding"))) if len(own_id) else np.zeros((0, 1))
        b, q = np.flatnonzero(base), np.flatnonzero(~base)
        rough, low = x.astype(np.float32), threshold - 1e-6 * (x.shape[1] + 8)  # single precision errs by less
        own = np.isin(own_id[q], own_id[b])
        us, ns, vs = [], [], []
        ids, place = np.unique(own_id, return_inverse=True)
        root, edges = np.arange(len(ids)), []
        for i in range(0, len(q), 512):
            part = q[i : i + 512]
            near = (rough[part] @ rough[b].T >= low).sum(axis=1) > own[i : i + 512]
            part = part[near]
            hit = x[part] @ x[b].T >= threshold
            hit &= own_id[part][:, None] != own_id[b]
            for r, row in zip(part, hit, strict=True):
                found = b[row]
                if not len(found):
                    continue
                us.append(int(own_id[r]))
                ns.append(int(n[found].sum()))
                vs.append(None)
                # one spanning edge to each other tree that the row is linked to
                trees, first = np.unique(root[place[found]], return_index=True)
                for tree, at in zip(trees, first, strict=True):
                    if tree != root[place[r]]:
                        root[root == tree] = root[place[r]]
                        edges.append((place[r], place[found[at]]))
        us += [int(ids[a]) for a, _ in edges]
        vs += [int(ids[c]) for _, c in edges]
        ns += [0] * len(edges)
        return pa.table({"u": pa.array(us, pa.int64()), "n": pa.array(ns, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id long, embedding array<float>)."""
    kind = V.element_kind(vectors.schema["embedding"].dataType)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    size = vectors.where(V.usable("embedding")).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if size is None:
        return none
    taking = F.col("vec_id").isNotNull() & V.usable("embedding") & (F.size("embedding") == size["d"])
    # repeated rows go first; equal vectors are one class of n vectors, numbered once and for all as the table is written
    classes = vectors.where(taking).distinct().groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = persist_table(classes.select(F.monotonically_increasing_id().alias("id"), "rep", "n", "embedding"), "near-classes")
    n = classes.count()
    centroids = V.kmeans(V.unit(V.sample(classes, "embedding", n)), min(MAX_CELLS, max(MIN_CELLS, n // CELL)), spherical=True)
    visits = classes.select("id", "n", "embedding").mapInArrow(_assign(centroids, threshold), f"id long, n long, embedding {kind}, cell long, home boolean")
    visits = persist_table(visits, "near-visits")
    per = visits.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("bases"), F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
    per = per.where("bases > 0")
    visits_in = visits.join(F.broadcast(per), "cell")  # at most MAX_CELLS rows

    def own(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asks = visits_in.select("*", own("asks").alias("a"), each("bases").alias("b")).withColumn("base", F.lit(False))
    bases = visits_in.where("home").select("*", own("bases").alias("b"), each("asks").alias("a")).withColumn("base", F.lit(True))
    cols = [F.concat_ws(":", "cell", "a", "b").alias("block"), "id", "n", "embedding", "base"]
    found = asks.select(cols).unionByName(bases.select(cols)).groupBy("block").applyInArrow(_links(threshold), "u long, n long, v long")
    found = persist_table(found, "near-links")
    discard(visits)
    links = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    labels = connected_components(found.where("v is not null").select("u", "v"))
    named = classes.join(links, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = persist_table(named.join(least, "component").select("embedding", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-named")
    discard(classes, found, labels)
    # back to the rows: equal vectors share a class
    flagged = vectors.select("vec_id", F.when(taking, F.col("embedding")).alias("embedding"))
    out = flagged.join(named, "embedding", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split by repeated 2-means until each part holds a list's
share, so the lists come out balanced.  Graph ties each centroid to its nearest
ones and finds the few nearest lists by a best-first walk.  A vector goes to the
list of its nearest centroid and, near a boundary, to further lists whose
distance is within `boundary` of the nearest (at most `copies`).  A query keeps
the lists whose distance is within `ratio` of the nearest one, or of the mean
distance of a vector from its own centroid if that is more (a query that is all
but a centroid itself has next to nothing near it), at least the `lists`
nearest, and more if these hold fewer than `least` vectors together.  It is
measured against all centroids by a product, as what it keeps may be many.

Lists lie in the order of the splits, and a run of them that holds about BLOCK
vectors is a group: a task has the vectors of a group, or of a part of it, and
the queries that keep any of its lists, and compares each query with the lists
that it keeps, exactly and in double precision.

No count of lists is fixed for a query, so recall holds as lists grow in number.
Where vectors have no clusters many lists lie within `ratio`, and the work is
then a share of queries times vectors.

Repeated rows of one vec_id and vector count once.  A group of equal vectors,
however large, counts k + 1 times at most: of equal candidates only the k + 1
smallest ids can be among anyone's k nearest (the window's group limit prunes
them before the shuffle), and equal queries are searched once.  The number of lists is bounded (MAX_LISTS), and so is what is
broadcast; a group with many vectors or many queries is split in blocks.

Defined results: a vector that is null, empty, zero, holds a null or
non-finite component, or has another length than most takes no part, as query
or candidate, and so does a row with a null vec_id; rows sharing a vec_id
count once as candidates, by their nearest vector, and are each a query; ties go to the smaller vec_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.llm import vectors as V
from lexisieve.llm.spark_utils import persist_table

SAMPLE = 50_000  # vectors that the lists are fitted on at most
LIST = 128
MAX_LISTS = 8192
BLOCK = 8192
DEGREE = 24


def balanced(x: np.ndarray, lists: int, seed: int = 9) -> np.ndarray:
    """Centroids of about `lists` parts of x of nearly equal size: 2-means, halved at the median of the distance difference."""
    goal, out, todo = max(1.0, len(x) / lists), [], [x]
    while todo:
        part = todo.pop()
        if len(part) <= 1.5 * goal or len(part) < 2:
            out.append(part.mean(axis=0))
            continue
        two = V.kmeans(part, 2, spherical=False, seed=seed, rounds=5)
        if len(two) < 2:
            out.append(part.mean(axis=0))
            continue
        lean = part @ (two[0] - two[1])
        split = np.argsort(lean, kind="stable")
        near = int((lean <= ((two[0] ** 2).sum() - (two[1] ** 2).sum()) / 2).sum())
        half = min(max(near, len(part) // 3), len(part) - len(part) // 3)  # neither side under a third
        todo += [part[split[:half]], part[split[half:]]]
    return np.array(out)


class Graph:
    """The centroids and their neighbour graph, searched best-first."""

    def __init__(self, centroids: np.ndarray):
        self.c, self.norm = centroids, (centroids**2).sum(axis=1)
        n = len(centroids)
        near = np.empty((n, min(DEGREE, n)), np.int64)
        for i in range(0, n, 1024):
            d = self.norm - 2 * centroids[i : i + 1024] @ centroids.T
            near[i : i + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        back: list[set[int]] = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):  # both ways, so that no centroid is out of reach of its neighbours
            for j in row:
                if len(back[j]) < 2 * DEGREE:
                    back[j].add(i)
        self.near = [np.array(sorted(s)) for s in back]
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(int))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found and their distances, nearest first."""
        seen = np.zeros(len(self.c), bool)

        def measure(at: np.ndarray) -> np.ndarray:
            diff = self.c[at] - q
            return np.sqrt((diff * diff).sum(axis=1))

        seen[self.entry] = True
        best = [(-d, int(i)) for i, d in zip(self.entry, measure(self.entry), strict=True)]
        todo = [(-d, i) for d, i in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = self.near[i][~seen[self.near[i]]]
            seen[fresh] = True
            for e, j in zip(measure(fresh), fresh, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(best, (-e, int(j)))
                    heapq.heappush(todo, (e, int(j)))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.array([d for d, _ in found])

    def measure(self, q: np.ndarray) -> np.ndarray:
        """(queries, lists) distances to all centroids."""
        return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + self.norm - 2 * q @ self.c.T))


def _post(centroids: np.ndarray, boundary: float, copies: int, span: int):
    """(vec_id, embedding) -> those with group and lists, one row for each group of `span` lists the vector belongs to."""
    norm = (centroids**2).sum(axis=1)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                x = V.matrix(part.column(1))
                d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + norm - 2 * x @ centroids.T))
                k = min(copies, d.shape[1])
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                own = np.take_along_axis(d, near, axis=1)
                at, col = np.nonzero(own <= (1 + boundary) * own.min(axis=1, keepdims=True))
                lists = near[at, col]
                order = np.lexsort((lists, at))
                at, lists = at[order], lists[order]
                group = lists // span
                lead = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (group[1:] != group[:-1])))
                held = pa.ListArray.from_arrays(pa.array(np.append(lead, len(at)), pa.int32()), pa.array(lists, pa.int32()))
                take = pa.array(at[lead])
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(group[lead]), held], names=["vec_id", "embedding", "group", "lists"])

    return run


def _route(graph: Graph, sizes: np.ndarray, ratio: float, scale: float, lists: int, least: int):
    """(vec_id, embedding) of queries -> those with lists, the lists to search, ascending."""

    def run(batches):
        for batch in batches:
            x = V.matrix(batch.column(1))
            to, off = [np.zeros(0, np.int64)], [0]
            for i in range(0, len(batch), 256):
                for d in graph.measure(x[i : i + 256]):
                    order = np.argsort(d, kind="stable")
                    held = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
                    keep = (d[order] <= (1 + ratio) * max(d[order[0]], scale)) | (held < least)
                    keep[:lists] = True
                    to.append(np.sort(order[keep]))
                    off.append(off[-1] + len(to[-1]))
            kept = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(to), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], names=["vec_id", "embedding", "lists"])

    return run


def _nearest(k: int):
    """A block of rows (vec_id, embedding, lists, ask) -> the k nearest vec_ids to each of its queries in the lists that it keeps."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, ask = table.column("vec_id").to_numpy(), table.column("ask").to_numpy()
        x = V.matrix(table.column("embedding"))
        norm = (x * x).sum(axis=1)
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(table.column("lists")).to_numpy()) if len(ids) else np.zeros(0, np.int64)
        held = pc.list_flatten(table.column("lists")).to_numpy()
        order = np.lexsort((ids[row], held))
        found: dict[int, list[np.ndarray]] = {}
        for members in np.split(row[order], np.flatnonzero(np.diff(held[order])) + 1):
            b, q = members[~ask[members]], members[ask[members]]
            if not len(b) or not len(q):
                continue
            y = x[b]
            each = np.flatnonzero(np.diff(ids[b], prepend=-1 - ids[b][:1]))  # the first row of each vec_id
            for i in range(0, len(q), 256):
                part = q[i : i + 256]
                if len(each) <= k:
                    for r in part:
                        found.setdefault(int(r), []).append(b)
                    continue
                # squares from a product choose, with what its rounding may hide; the distances below decide
                d2 = norm[part, None] + norm[b] - 2 * x[part] @ y.T
                own = d2 if len(each) == len(b) else np.minimum.reduceat(d2, each, axis=1)
                most = np.partition(own, k - 1, axis=1)[:, k - 1] + 1e-10 * (norm[part] + norm[b].max())
                for r, some in zip(part, ~(d2 > most[:, None]), strict=True):
                    found.setdefault(int(r), []).append(b[some])
        us, vs, ds = [], [], []
        for r, parts in found.items():
            near = np.unique(np.concatenate(parts))
            diff = x[near] - x[r]
            d = np.sqrt((diff * diff).sum(axis=1))
            top = np.lexsort((ids[near], d))
            top = top[np.sort(np.unique(ids[near[top]], return_index=True)[1])][:k]  # a vec_id counts by its nearest vector
            us += [ids[r]] * len(top)
            vs += ids[near[top]].tolist()
            ds += d[top].tolist()
        return pa.table({"query_id": pa.array(us, pa.int64()), "vec_id": pa.array(vs, pa.int64()), "score": pa.array(ds, pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, boundary: float = 0.1, copies: int = 4, ratio: float = 0.28, lists: int = 16, least: int = 1000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query the k nearest other rows found, by Euclidean distance."""
    kind = V.element_kind(vectors.schema["embedding"].dataType)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("ask")).where("vec_id is not null").where(V.usable("embedding"))
    per = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if per is None:
        return vectors.sparkSession.createDataFrame([], empty)
    n, vectors = per["count"], vectors.where(F.size("embedding") == per["d"])
    distinct = vectors.select("embedding").distinct()
    sample = V.sample(distinct, "embedding", distinct.count(), SAMPLE)
    fitted, rest = apart(sample)
    centroids = balanced(fitted, max(1, min(MAX_LISTS, n // LIST)))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    bases = vectors.select("vec_id", "embedding").distinct().withColumn("_n", rank).where(F.col("_n") <= k + 1).drop("_n")
    span = max(1, BLOCK * len(centroids) // (n * copies))  # lists of about BLOCK vectors together, with their copies
    groups = -(-len(centroids) // span)
    posted = persist_table(bases.mapInArrow(_post(centroids, boundary, copies, span), f"vec_id long, embedding {kind}, group long, lists array<int>"), "ann-postings")
    sizes = _counts(posted.select(F.explode("lists").alias("list")), "list", len(centroids))
    asked = vectors.where("ask").select("vec_id", "embedding")
    classes = persist_table(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding"), "ann-queries")
    route = _route(Graph(centroids), sizes, ratio, spread_of(rest, centroids), lists, least)
    routes = persist_table(classes.mapInArrow(route, f"vec_id long, embedding {kind}, lists array<int>"), "ann-routes")

    def group_of(x):
        return F.floor(x / F.lit(span)).cast("long")

    routed = routes.withColumn("group", F.explode(F.array_distinct(F.transform("lists", group_of))))
    routed = routed.withColumn("lists", F.filter("lists", lambda x: group_of(x) == F.col("group")))

    def parts(count: np.ndarray) -> Column:
        return F.element_at(F.lit(np.maximum(1, -(-count // BLOCK)).tolist()), (F.col("group") + 1).cast("int"))

    b_parts, q_parts = parts(_counts(posted, "group", groups)), parts(_counts(routed, "group", groups))

    def placed(df: DataFrame, own: Column, others: Column, ask: bool) -> DataFrame:
        both = df.withColumns({"_own": F.pmod(F.xxhash64("vec_id", "embedding"), own), "_other": F.explode(F.sequence(F.lit(0), others - 1))})
        b, q = ("_other", "_own") if ask else ("_own", "_other")
        return both.select(F.concat_ws(":", "group", b, q).alias("block"), "vec_id", "embedding", "lists", F.lit(ask).alias("ask"))

    blocks = placed(posted, b_parts, q_parts, False).unionByName(placed(routed, q_parts, b_parts, True))
    found = blocks.groupBy("block").applyInArrow(_nearest(k + 1), "query_id long, vec_id long, score double")
    # at most k + 1 rows from each of the blocks a query visits
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("best"))
    answers = classes.withColumnRenamed("vec_id", "query_id").join(best, "query_id").select("embedding", "best")
    own = asked.withColumnRenamed("vec_id", "query_id").join(answers, "embedding").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def apart(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nine tenths of a sample to fit centroids on and the rest, which they don't know, to measure distances; a small sample is used for both."""
    if len(sample) < 100:
        return sample, sample
    turn = np.random.Generator(np.random.PCG64(3)).permutation(len(sample))
    return sample[turn[len(sample) // 10 :]], sample[turn[: len(sample) // 10]]


def spread_of(sample: np.ndarray, centroids: np.ndarray) -> float:
    """The mean distance of a vector of the sample from its nearest centroid."""
    total, norm = 0.0, (centroids**2).sum(axis=1)
    for i in range(0, len(sample), 1024):
        x = sample[i : i + 1024]
        total += np.sqrt(np.maximum(0, (x * x).sum(axis=1) + (norm - 2 * x @ centroids.T).min(axis=1))).sum()
    return total / max(1, len(sample))


def _counts(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Rows by list or group of lists; at most MAX_LISTS numbers come to the driver."""
    out = np.zeros(n, np.int64)
    for r in rows.groupBy(column).count().collect():
        out[r[column]] = r["count"]
    return out

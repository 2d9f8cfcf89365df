"""Session helpers shared by the operators."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where


_MADE: list[DataFrame] = []  # tables of persist_table that are not deleted yet


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _MADE.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of persist_table that no plan reads any more."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            _MADE[:] = [t for t in _MADE if t.stored_at != path]


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make returns, as a table; the tables that were written on the way are deleted."""
    before = {t.stored_at for t in _MADE}
    out = persist_table(make(), name)
    discard(*[t for t in _MADE if t.stored_at not in before and t.stored_at != out.stored_at])
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


EDGES = 100_000  # a file of edges, about


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all vertices of edges (u, v); component is the smallest id reachable.

    Large-star and small-star steps in turn: the first ties each vertex's larger
    neighbours to its least one, the second its smaller neighbours and itself,
    until every component is a star around its least id.  The number of edges
    never grows, and rounds grow with the logarithm of the longest chain (11
    for a shuffled chain of 5,000, 15 for one of 200,000).  Minima are combined
    before their shuffle; joining them with the edges is left to adaptive
    skew handling, as both sides are tables.  Each step is written to the
    shared folder and the one before is deleted.
    """
    edges, state = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    steps, idle = itertools.cycle((_large_star, _small_star)), 0
    while state[0] and idle < 2:  # neither step has anything left to do
        files = -(-state[0] // EDGES)
        least, moved = next(steps)(edges, files)
        moved, after = _written(moved.coalesce(files))
        discard(edges, least)
        idle = idle + 1 if after == state else 0
        edges, state = moved, after
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    labels.stored_at = edges.stored_at
    return labels


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """edges as a table, their number and a checksum of them, both taken as they are written."""
    seen = Observation()
    table = persist_table(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "cc-edges")
    return table, (seen.get["n"], seen.get["x"] or 0)


def _large_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v), u > v, after each vertex has tied its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = persist_table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(files), "cc-least")
    # the edge u > v is seen from v: u goes to the least neighbour of v
    tied = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
    return least, tied.distinct()


def _small_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v), u > v, after each vertex has tied itself and its smaller neighbours to the least of them."""
    least = persist_table(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "cc-least")
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return least, tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

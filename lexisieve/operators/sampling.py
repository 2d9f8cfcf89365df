"""De-duplication with a stated survivor, stable samples, compositions and review queues.

Nothing here depends on the order in which rows arrive: every choice has a
total order made of a hash and a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisieve.functions.settings import SieveError


class QuotaError(SieveError):
    """Fewer rows than asked for, or one source with too large a share."""


def identity(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL, in hexadecimal."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def stable_rank(source: str, revision: str, label: Column, key: Column) -> Column:
    return joined_hash(F.lit(source), F.lit(revision), label, key)


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row per key, the first in the given order: an aggregate, combined before the shuffle, so a hot key is no burden."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def top_k(df: DataFrame, k: int, *order: Column, exact: bool = False) -> DataFrame:
    out = df.orderBy(*order).limit(k)
    if exact and out.count() < k:
        raise QuotaError(f"fewer than {k} rows")
    return out


def top_k_per_label(df: DataFrame, quotas: dict[str, int], label: str, *order: Column, exact: bool = False) -> DataFrame:
    """The first rows of each label up to its quota, in one scan: the group limit of the window leaves no more than the largest quota of a label in any task."""
    quota = F.create_map(*[F.lit(x) for pair in sorted(quotas.items()) for x in pair])[F.col(label)]
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    ranked = df.where(F.col(label).isin(*quotas)).withColumn("_n", rank).where(F.col("_n") <= max(quotas.values()))
    out = ranked.where(F.col("_n") <= quota).drop("_n")
    if exact:
        got = {r[label]: r["count"] for r in out.groupBy(label).count().collect()}
        if short := sorted(k for k, n in quotas.items() if got.get(k, 0) < n):
            raise QuotaError(f"too few rows of {short}")
    return out


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().intersect(b.select(key).distinct())


def conflict_free(df: DataFrame, key: str, label: str, *order: Column) -> DataFrame:
    """Drops every key whose rows disagree about the label; keeps the first row of the others."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    grouped = df.groupBy(key).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.min_by(F.struct(*df.columns), rank).alias("_row"))
    return grouped.where("_low = _high").select("_row.*")


def compose(sources: list[tuple[str, DataFrame, int]], key: str, *order: Column, most_share: float = 1.0, exact: bool = True) -> DataFrame:
    """Takes each source's quota in turn, never a key that was taken before; adds source_id.

    Sources are few and later ones depend on earlier ones; only the keys already
    chosen (at most the sum of the quotas) are held against the next source.
    """
    chosen = None
    for source, rows, quota in sources:
        rows = keep_first(rows, F.col(key), *order).withColumn("source_id", F.lit(source))
        if chosen is not None:
            rows = without(rows, chosen, key)
        own = top_k(rows, quota, *order, exact=exact)
        chosen = own if chosen is None else chosen.unionByName(own)
    if most_share < 1.0:
        worst = source_shares(chosen).agg(F.max("share")).first()[0]
        if worst is not None and worst > most_share + 1e-12:
            raise QuotaError(f"one source makes up {worst:.3f} of the rows")
    return chosen


def source_shares(df: DataFrame, source: str = "source_id") -> DataFrame:
    per = df.groupBy(source).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def opaque_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(joined_hash(*parts), 1, 24))


def review_buffer(sources: list[tuple[str, DataFrame, int]], existing: DataFrame, key: str, *order: Column, exact: bool = True) -> DataFrame:
    """compose() over what no existing intake of any source holds."""
    return compose([(s, without(rows, existing, key), quota) for s, rows, quota in sources], key, *order, exact=exact)


def round_robin(df: DataFrame, source: str, *order: Column, limit: int = 500) -> DataFrame:
    """The first row of every source, then every second, and so on, `limit` rows (500 at most) with their turn and position."""
    if not 0 < limit <= 500:
        raise QuotaError("limit: 1 to 500")
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    queue = df.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", source).limit(limit)
    return queue.withColumn("position", F.row_number().over(Window.orderBy("turn", source)))  # of `limit` rows

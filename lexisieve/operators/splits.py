"""Split manifests and leakage between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE = ("regression", "tuning")


def direct_leaks(cases: DataFrame, key: str = "text", hidden: str = "evaluation") -> DataFrame:
    """(visible_id, hidden_id) of equal texts in visible and hidden splits; cases has id, split and key."""
    h = F.sha2(F.col(key), 256).alias("_h")
    a = cases.where(F.col("split").isin(*VISIBLE)).select(h, F.col("id").alias("visible_id"))
    b = cases.where(F.col("split") == hidden).select(h, F.col("id").alias("hidden_id"))
    return a.join(b, "_h").select("visible_id", "hidden_id")


def normalized_leaks(cases: DataFrame, text: str, key: str) -> DataFrame:
    """Leaks of equal keys (see leak_key) that are not equal texts."""
    return direct_leaks(cases, key).join(direct_leaks(cases, text), ["visible_id", "hidden_id"], "left_anti")


def leak_classes(cases: DataFrame, key: str, hidden: str = "evaluation") -> DataFrame:
    """(h, visible, hidden) counts of each text class on both sides: the same finding without pairs, for large groups of copies."""
    per = cases.groupBy(F.sha2(F.col(key), 256).alias("h")).agg(F.count_if(F.col("split").isin(*VISIBLE)).alias("visible"), F.count_if(F.col("split") == hidden).alias("hidden"))
    return per.where("visible > 0 and hidden > 0")


def reconcile(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, issue): cases that only one side has, or that the sides place in different splits or corpora."""
    m = manifest.select("case_id", F.col("corpus_id").alias("m_corpus"), F.col("split").alias("m_split"))
    c = cases.select("case_id", F.col("corpus_id").alias("c_corpus"), F.col("split").alias("c_split"))
    both = m.join(c, "case_id", "full_outer")
    issue = (
        F.when(F.col("c_split").isNull(), "missing-from-corpus")
        .when(F.col("m_split").isNull(), "missing-from-manifest")
        .when(F.col("m_corpus") != F.col("c_corpus"), "corpus-differs")
        .when(F.col("m_split") != F.col("c_split"), "split-differs")
    )
    return both.select("case_id", issue.alias("issue")).where("issue is not null")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, corpus_id, split, side) of assignments that only one manifest holds; any row asks for a new version."""
    cols = ["case_id", "corpus_id", "split"]
    return old.select(cols).exceptAll(new.select(cols)).withColumn("side", F.lit("old")).unionByName(new.select(cols).exceptAll(old.select(cols)).withColumn("side", F.lit("new")))


def moved(base: DataFrame, new: DataFrame) -> DataFrame:
    """Base assignments that a new manifest lost or moved."""
    n = new.select("case_id", F.col("corpus_id").alias("n_corpus"), F.col("split").alias("n_split"))
    same = F.col("n_corpus").eqNullSafe(F.col("corpus_id")) & F.col("n_split").eqNullSafe(F.col("split"))
    return base.join(n, "case_id", "left").where(~same).select("case_id", "split", "n_split")


def build_manifest(base: DataFrame, cases: DataFrame) -> DataFrame:
    """Base assignments as they are, and those of new cases, by case_id."""
    cols = ["case_id", "corpus_id", "split"]
    return base.select(cols).unionByName(cases.select(cols).join(base.select("case_id"), "case_id", "left_anti")).orderBy("case_id")

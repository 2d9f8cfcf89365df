"""Annotation batches: export, two-reviewer merge, adjudication, re-audit.

A decision row: case_id, privacy_status (pending, approved, exclude), label,
matches (in order), slices (as a set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISION = ("label", "matches", "slices")


def page(cases: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A batch of at most 500 cases in the order of key."""
    if offset < 0 or not 0 < limit <= 500:
        raise ValueError("offset: 0 or more; limit: 1 to 500")
    return cases.orderBy(key).offset(offset).limit(limit)


def decision_key(prefix: str = "") -> Column:
    """Label, matches in their order, slices in any order."""
    return F.struct(F.col(prefix + "label").alias("label"), F.col(prefix + "matches").alias("matches"), F.array_sort(F.col(prefix + "slices")).alias("slices"))


def _sided(batch: DataFrame, side: str) -> DataFrame:
    return batch.select("case_id", *[F.col(c).alias(f"{side}_{c}") for c in ("privacy_status", *DECISION)])


def merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(case_id, outcome, label, matches, slices): exclude before pending before disagreement before consensus; a case that one side lacks is `unpaired`."""
    both = _sided(primary, "p").join(_sided(secondary, "s"), "case_id", "full_outer")

    def either(status: str) -> Column:
        return (F.col("p_privacy_status") == status) | (F.col("s_privacy_status") == status)

    outcome = (
        F.when(F.col("p_privacy_status").isNull() | F.col("s_privacy_status").isNull(), "unpaired")
        .when(either("exclude"), "exclude")
        .when(either("pending"), "pending")
        .when(~decision_key("p_").eqNullSafe(decision_key("s_")), "disagreement")
        .otherwise("consensus")
    )
    both = both.withColumn("outcome", outcome)
    return both.select("case_id", "outcome", *[F.when(F.col("outcome") == "consensus", F.col(f"p_{c}")).alias(c) for c in DECISION])


def adjudicate(merged: DataFrame, third: DataFrame) -> DataFrame:
    """Disagreements take the third reviewer's decision (`adjudicated`, or `unresolved` while pending); the rest stays."""
    both = merged.join(_sided(third, "t"), "case_id", "left")
    due = F.col("outcome") == "disagreement"
    outcome = F.when(due & (F.col("t_privacy_status") == "approved"), "adjudicated").when(due & (F.col("t_privacy_status") == "exclude"), "exclude").when(due, "unresolved").otherwise(F.col("outcome"))
    both = both.withColumn("outcome", outcome)
    return both.select("case_id", "outcome", *[F.when(F.col("outcome") == "adjudicated", F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in DECISION])


def apply_decisions(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """cases (case_id, label, matches, slices, ...) with decided labels, matches and slices; others stay under review as they are."""
    own = decided.where(F.col("outcome").isin("consensus", "adjudicated")).select("case_id", F.lit(True).alias("_d"), *[F.col(c).alias(f"_{c}") for c in DECISION])
    both = cases.join(own, "case_id", "left")
    return both.select(*[F.when(F.col("_d"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in DECISION else F.col(c) for c in cases.columns])


def reaudit_set(cases: DataFrame, false_positives: DataFrame) -> DataFrame:
    """The cases named by false_positives (case_id), blinded for another look."""
    blind = {"label": F.lit("review"), "matches": F.filter("matches", lambda m: F.lit(False)), "slices": F.array().cast("array<string>")}
    return cases.join(false_positives.select("case_id").distinct(), "case_id", "left_semi").withColumns({k: v for k, v in blind.items() if k in cases.columns})


def reaudit_apply(cases: DataFrame, audited: DataFrame, columns: tuple[str, ...], fixed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases with `columns` of audited ones replaced, transitions of the first column, rows whose `fixed` columns differ)."""
    new = audited.select("case_id", F.lit(True).alias("_a"), *[F.col(c).alias(f"_{c}") for c in (*columns, *fixed)])
    both = cases.join(new, "case_id", "left")
    out = both.select(*[F.when(F.col("_a"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in cases.columns])
    touched = both.where("_a")
    transitions = touched.groupBy(F.col(columns[0]).alias("before"), F.col(f"_{columns[0]}").alias("after")).agg(F.count("*").alias("n"))
    differs = F.lit(False)
    for c in fixed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out, transitions, touched.where(differs).select("case_id")


def batch_problems(batch: DataFrame, cases: DataFrame, most: int = 500) -> DataFrame:
    """(case_id, rule): cases that are unknown, repeated or changed, labels that contradict the matches, and a batch over `most` rows.

    batch: case_id, text, privacy_status, label, matches array<struct<start,end,...>>; cases: case_id, text.
    """
    twice = batch.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated").alias("rule"))
    both = batch.join(cases.select("case_id", F.col("text").alias("_text")), "case_id", "left")
    n = F.size("matches")
    rules = F.array_compact(F.array(
        F.when(F.col("_text").isNull(), F.lit("unknown")),
        F.when(F.col("_text") != F.col("text"), F.lit("text")),
        F.when(F.coalesce(~F.col("privacy_status").isin("pending", "approved", "exclude"), F.lit(True)), F.lit("status")),
        F.when((F.col("label") == "positive") & (n == 0), F.lit("positive-without-match")),
        F.when((F.col("label") == "hard-negative") & (n > 0), F.lit("negative-with-match")),
        F.when(F.exists("matches", lambda m: (m["start"] < 0) | (m["end"] <= m["start"]) | (m["end"] > F.length("text"))), F.lit("span")),
    ))
    over = batch.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast(batch.schema["case_id"].dataType).alias("case_id"), F.lit("too-long").alias("rule"))
    return twice.unionByName(both.select("case_id", F.explode(rules).alias("rule"))).unionByName(over)


def exclusion_problems(excluded: DataFrame, cases: DataFrame, fields: tuple[str, ...] = ("text", "split")) -> DataFrame:
    """case_id of excluded rows that the corpus doesn't hold with the same fields."""
    own = cases.select("case_id", F.lit(True).alias("_c"), *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.coalesce("_c", F.lit(False))
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return excluded.join(own, "case_id", "left").where(~same).select("case_id")

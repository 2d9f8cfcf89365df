"""Confusion counts, rates, ablation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.settings import SieveError

OCCURRENCE = ("case_id", "start", "end", "term")


def outcome(gold: Column, found: Column) -> Column:
    return F.when(gold & found, "tp").when(gold, "fn").when(found, "fp").otherwise("tn")


def confusion(rows: DataFrame, gold: str, found: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn of boolean columns, in all or by groups."""
    o = outcome(F.col(gold), F.col(found))
    return rows.groupBy(*by).agg(*[F.count_if(o == k).alias(k) for k in ("tp", "fp", "fn", "tn")])


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and, where tn is there, accuracy; null where a denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})
    out = out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", F.try_divide(tp + F.col("tn"), tp + fp + fn + F.col("tn"))) if "tn" in counts.columns else out


def set_occurrences(gold: DataFrame, found: DataFrame, key: tuple[str, ...] = OCCURRENCE) -> DataFrame:
    """tp, fp, fn over distinct occurrence keys: one aggregate over both sides."""
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("f")).unionByName(found.select(*key, F.lit(0).alias("g"), F.lit(1).alias("f")))
    per = both.groupBy(*key).agg(F.max("g").alias("g"), F.max("f").alias("f"))
    return per.agg(F.count_if((F.col("g") == 1) & (F.col("f") == 1)).alias("tp"), F.count_if(F.col("g") < F.col("f")).alias("fp"), F.count_if(F.col("g") > F.col("f")).alias("fn"))


def multiset_occurrences(gold: DataFrame, found: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """tp, fp, fn with repeats: a key counts as often as the side that has it less often."""
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("f")).unionByName(found.select(*key, F.lit(0).alias("g"), F.lit(1).alias("f")))
    per = both.groupBy(*key).agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    hit = F.least("g", "f")
    return per.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("tp", hit), ("fp", F.col("f") - hit), ("fn", F.col("g") - hit))])


def slice_metrics(rows: DataFrame, gold: str, found: str, slices: str) -> DataFrame:
    """confusion() by slice; a case counts in each of its slices."""
    return confusion(rows.withColumn("slice", F.explode(slices)), gold, found, "slice")


def totals(rows: DataFrame, gold: str, found: str, by: str) -> DataFrame:
    """confusion() by group and, in the row whose group is null, over all."""
    o = outcome(F.col(gold), F.col(found))
    return rows.rollup(by).agg(F.count("*").alias("cases"), *[F.count_if(o == k).alias(k) for k in ("tp", "fp", "fn", "tn")])


def ablation(predictions: DataFrame, gold: DataFrame, baseline: str, full: str, key: tuple[str, ...] = OCCURRENCE) -> DataFrame:
    """What each profile adds to the baseline, from one aggregate over (profile, key) rows.

    Per profile: added_tp, added_fp, removed_tp, removed_fp against the
    baseline, unique_tp (right occurrences that no other profile but `full`
    adds), and fn, the gold occurrences it misses.
    """
    marks = predictions.select(*key, "profile").unionByName(gold.select(*key, F.lit("_gold").alias("profile")))
    per = marks.groupBy(*key).agg(F.collect_set("profile").alias("by"))
    names = predictions.select("profile").distinct()
    right, base = F.array_contains("by", "_gold"), F.array_contains("by", baseline)
    others = F.size(F.filter("by", lambda p: ~p.isin("_gold", baseline, full)))
    # each occurrence meets each profile: only their names are broadcast
    every = per.join(F.broadcast(names.where(F.col("profile") != baseline)))
    own = F.array_contains("by", F.col("profile"))
    return every.groupBy("profile").agg(
        F.count_if(own & ~base & right).alias("added_tp"),
        F.count_if(own & ~base & ~right).alias("added_fp"),
        F.count_if(~own & base & right).alias("removed_tp"),
        F.count_if(~own & base & ~right).alias("removed_fp"),
        F.count_if(own & ~base & right & (others == 1)).alias("unique_tp"),
        F.count_if(right & ~own).alias("fn"),
    )


def case_results(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, results): for each case an ordered array of (profile, found, matches)."""
    per = predictions.groupBy("case_id", "profile").agg(F.count("*").alias("n"))
    nested = per.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("profile", "n"))).alias("results"))
    return cases.select("case_id").join(nested, "case_id", "left").withColumn("results", F.coalesce("results", F.array().cast(nested.schema["results"].dataType)))


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], *by: str) -> DataFrame:
    """The value at rank ceil(q * n)."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, q in quantiles.items()])


def gates(metrics: DataFrame, most_fp_rate: float = 0.005, short_ms: float = 1.0, long_ms: float = 15.0) -> DataFrame:
    """Adds fp_rate, one boolean per gate and passed; metrics has fp, tn and, optionally, short_p95_ms and long_p95_ms."""
    rate = F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))
    out = metrics.withColumn("fp_rate", rate).withColumn("gate_fp_rate", rate <= most_fp_rate)
    names = ["gate_fp_rate"]
    for column, limit in (("short_p95_ms", short_ms), ("long_p95_ms", long_ms)):
        if column in metrics.columns:
            out = out.withColumn(f"gate_{column}", F.col(column) <= limit)
            names.append(f"gate_{column}")
    passed = F.lit(True)
    for n in names:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def deltas(metrics: DataFrame, baseline: str, columns: tuple[str, ...] = ("tp", "fp", "fn", "tn")) -> DataFrame:
    """Differences of each profile's counts from the baseline profile's."""
    base = metrics.where(F.col("profile") == baseline).select(*[F.col(c).alias(f"_{c}") for c in columns])
    if base.count() != 1:
        raise SieveError(f"the metrics have no row, or more than one, of {baseline!r}")
    return metrics.join(F.broadcast(base)).select("profile", *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in columns])


def inconsistent(metrics: DataFrame) -> DataFrame:
    """Rows whose counts or rates contradict each other; metrics has tp, fp, fn, tn, cases, positives and the rates."""
    def off(name: str, value: Column) -> Column:
        return ~F.coalesce(F.abs(F.col(name) - value) <= 1e-12, F.col(name).isNull() & value.isNull())

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    wrong = (tp + fp + fn + F.col("tn") != F.col("cases")) | (tp + fn != F.col("positives")) | off("precision", F.try_divide(tp, tp + fp)) | off("recall", F.try_divide(tp, tp + fn))
    return metrics.where(wrong)


def prediction_problems(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_id, issue): cases without exactly one prediction, unknown cases, spans out of range, flags that contradict the matches."""
    per = predictions.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_or(F.col("detected") != (F.size("matches") > 0)).alias("odd"), F.max(F.array_max(F.transform("matches", lambda m: m["end"]))).alias("end"))
    both = cases.select("case_id", F.length("text").alias("length")).join(per, "case_id", "full_outer")
    issue = F.when(F.col("length").isNull(), "unknown-case").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("odd"), "flag").when(F.col("end") > F.col("length"), "span")
    return both.select("case_id", issue.alias("issue")).where("issue is not null")

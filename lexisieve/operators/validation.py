"""Corpus validation: each rule yields rows (id, rule); a valid corpus yields none.

Cases: id, text, label, expected_matches array<struct<start,end,canonical_term>>,
slices array<string>, source struct<kind,name,reference,revision,
redistribution_allowed>, license, split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("positive", "hard-negative", "review")
SPLITS = ("regression", "tuning", "evaluation", "private")
KINDS = ("curated", "licensed", "private")
ID = "^[a-z0-9][a-z0-9._-]{0,127}$"


def _rule(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.lit(name))


def span_problems(cases: DataFrame, spans: str = "expected_matches", text: str = "text") -> DataFrame:
    """(id, pos, rule): spans that are empty, out of range, out of order or overlap an earlier one."""
    m = F.col(spans)

    def of(i):
        return F.get(m, i)

    def furthest(i):  # running maximum of the ends before i
        return F.coalesce(F.array_max(F.transform(F.slice(m, F.lit(1), i), lambda x: x["end"])), F.lit(0))

    rows = cases.select("id", text, F.posexplode(F.transform(m, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), furthest(i).alias("before"), of(i - 1)["start"].alias("last")))).alias("pos", "m"))
    bad = F.array_compact(F.array(
        _rule("span-range", (F.col("m.start") < 0) | (F.col("m.end") <= F.col("m.start")) | (F.col("m.end") > F.length(text))),
        F.when((F.col("pos") > 0) & (F.col("m.start") < F.col("m.last")), F.lit("span-order")),
        F.when((F.col("pos") > 0) & (F.col("m.start") < F.col("m.before")), F.lit("span-overlap")),
    ))
    return rows.select("id", "pos", F.explode(bad).alias("rule"))


def case_problems(cases: DataFrame, allowed_slices: list[str]) -> DataFrame:
    """(id, rule) of all rules on single cases, in one pass over the rows."""
    n = F.size("expected_matches")
    s, private = F.col("source"), F.col("source.kind") == "private"
    rules = [
        _rule("id", ~F.col("id").rlike(ID)),
        _rule("text", (F.length("text") < 1)),
        _rule("label", ~F.col("label").isin(*LABELS)),
        _rule("split", ~F.col("split").isin(*SPLITS)),
        _rule("positive-without-match", (F.col("label") == "positive") & (n == 0)),
        _rule("negative-with-match", (F.col("label") == "hard-negative") & (n > 0)),
        _rule("slices-empty", F.size("slices") == 0),
        _rule("slices-unknown", F.size(F.array_except("slices", F.array(*map(F.lit, allowed_slices)))) > 0),
        _rule("slices-repeated", F.size(F.array_distinct("slices")) < F.size("slices")),
        _rule("source-kind", ~s["kind"].isin(*KINDS)),
        _rule("licensed-reference", (s["kind"] == "licensed") & (s["reference"].isNull() | s["revision"].isNull())),
        _rule("private-reference", private & (s["reference"].isNotNull() | s["revision"].isNotNull())),
        _rule("regression-redistribution", (F.col("split") == "regression") & ~s["redistribution_allowed"]),
        _rule("private-split", (F.col("split") == "private") != private),
        _rule("private-license", private & ((F.col("license") != "LicenseRef-Private") | s["redistribution_allowed"])),
    ]
    return cases.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def repeated_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("id").count().where("count > 1").select("id", F.lit("id-repeated").alias("rule"))


def validate(cases: DataFrame, allowed_slices: list[str]) -> DataFrame:
    """All problems of a corpus as (id, rule)."""
    parts = [case_problems(cases, allowed_slices), repeated_ids(cases), span_problems(cases).select("id", "rule")]
    return reduce(DataFrame.unionByName, parts)


def summary(cases: DataFrame) -> DataFrame:
    """Case counts by split and label."""
    return cases.groupBy("split", "label").agg(F.count("*").alias("n"))


def unknown_fields(raw_json: DataFrame, allowed: list[str], column: str = "value") -> DataFrame:
    """(field) names of JSON objects (one a row) that are not allowed: the reader itself drops them in silence."""
    keys = F.json_object_keys(F.col(column))
    return raw_json.select(F.explode(F.array_except(keys, F.array(*map(F.lit, allowed)))).alias("field")).distinct()

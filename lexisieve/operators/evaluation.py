"""Runs over many detectors or profiles: the matcher matrix, ablation, comparison, and checks of the reports they give."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.columns import MATCH, Sieve, found_by
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import Settings, SieveError, profile
from lexisieve.operators import metrics
from lexisieve.sources.readers import written

BASELINE, CONTROL, FULL = "exact-alias", "segmented-prerequisites", "all-enabled"
SINGLE = {
    "repeated": ("repeated",),
    "separator": ("separator",),
    "whitespace": ("whitespace_gap",),
    "mixed": ("mixed_gap",),
    "keyboard": ("keyboard",),
    "jamo": ("jamo_composition",),
    "choseong": ("choseong",),
    CONTROL: ("choseong", "keyboard", "jamo_composition"),
    "segmented": ("choseong", "keyboard", "jamo_composition", "segmented_input"),
    "fuzzy": ("fuzzy",),
}


def matcher_matrix(**changes) -> dict[str, Settings]:
    """The twelve profiles of an ablation: exact and alias alone, with each other matcher, the control that segmented input needs, and all."""
    out = {BASELINE: profile("strict", **changes)}
    out |= {name: profile("strict", **{f"{m}_matching": True for m in on}, **changes) for name, on in SINGLE.items()}
    return out | {FULL: profile("aggressive", **changes)}


def base_of(name: str) -> str:
    """The profile that a profile is measured against."""
    return CONTROL if name == "segmented" else BASELINE


def predictions(cases: DataFrame, lexicon: Lexicon, profiles: dict[str, Settings], text: str = "text") -> DataFrame:
    """Rows (columns of cases without text, profile, term, matched_text, start, end, method, score) of every profile."""
    keep = [c for c in cases.columns if c != text]
    found = found_by({p: Sieve(lexicon, settings=s) for p, s in profiles.items()}, text)
    rows = cases.select(*keep, found.alias("_f")).select(*keep, F.inline_outer("_f")).where("profile is not null")
    return rows.select(*keep, *MATCH.names, "profile")


def ablation_run(cases: DataFrame, gold: DataFrame, lexicon: Lexicon, profiles: dict[str, Settings] | None = None, **changes) -> DataFrame:
    """Per profile what it adds to and removes from its base, right and wrong (see metrics.ablation), without cases under review.

    cases: case_id, text and, optionally, label; gold: case_id, start, end, term.
    """
    profiles = profiles or matcher_matrix(**changes)
    if "label" in cases.columns:
        cases = cases.where("label <> 'review'")
    found = written(predictions(cases.select("case_id", "text"), lexicon, profiles).select("case_id", "start", "end", "term", "profile").distinct(), "ablation")
    gold = written(gold.select("case_id", "start", "end", "term"), "gold")
    parts = []
    for base in sorted({base_of(p) for p in profiles if p != BASELINE}):
        own = [p for p in profiles if p != base and base_of(p) == base]
        parts.append(metrics.ablation(found.where(F.col("profile").isin(base, *own)), gold, base, FULL).where(F.col("profile").isin(*own)).withColumn("base", F.lit(base)))
    return reduce(DataFrame.unionByName, parts)


def comparison_run(cases: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]], spans: dict[str, bool] | None = None) -> DataFrame:
    """(detector, cases, tp, fp, fn, tn, rates, occurrence_tp, occurrence_fp, occurrence_fn) of detectors over the same cases.

    cases: case_id, text, gold boolean, expected array<struct<start,end,term>>.
    A detector gives (case_id, detected, matches array<struct<start,end,term>>)
    for every case, else SieveError; one that can't tell spans (spans[name] is
    False) has null occurrence counts.
    """
    gold = cases.select("case_id", F.inline("expected")).select("case_id", "start", "end", "term")
    parts = []
    for name in sorted(detectors):
        out = detectors[name](cases.select("case_id", "text"))
        if bad := metrics.prediction_problems(cases, out).limit(5).collect():
            raise SieveError(f"{name}: {[(r['case_id'], r['issue']) for r in bad]}")
        judged = cases.join(out.select("case_id", "detected"), "case_id")
        row = metrics.rates(metrics.confusion(judged, "gold", "detected")).withColumn("cases", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
        if (spans or {}).get(name, True):
            own = metrics.set_occurrences(gold, out.select("case_id", F.inline("matches")).select("case_id", "start", "end", "term"))
            row = row.join(F.broadcast(own.select(*[F.col(c).alias(f"occurrence_{c}") for c in ("tp", "fp", "fn")])))  # one row each
        else:
            row = row.withColumns({f"occurrence_{c}": F.lit(None).cast("long") for c in ("tp", "fp", "fn")})
        parts.append(row.withColumn("detector", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def report_problems(profiles: DataFrame, baseline: str) -> DataFrame:
    """(profile, rule) of a report whose counts contradict one another.

    profiles: profile, cases, positives, negatives, tp, fp, fn, tn,
    occurrence_tp, occurrence_fn, d_tp, d_fp, d_fn, d_tn, fp_rate, passed.
    Deltas, rates and gates are computed again and compared.
    """
    base = profiles.where(F.col("profile") == baseline)
    if base.count() != 1:
        raise SieveError(f"the report has no row, or more than one, of {baseline!r}")
    b = base.select(*[F.col(c).alias(f"_{c}") for c in ("tp", "fp", "fn", "tn")], (F.col("occurrence_tp") + F.col("occurrence_fn")).alias("_gold"))
    again = metrics.gates(profiles.select("profile", F.col("fp").alias("fp"), "tn").distinct()).select("profile", F.col("fp_rate").alias("_rate"), F.col("passed").alias("_passed"))
    both = profiles.join(F.broadcast(b)).join(again, "profile", "left")

    def off(a, b):
        return F.coalesce(F.abs(a - b) > 1e-12, F.lit(True))

    rules = {
        "cases": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") != F.col("cases"),
        "positives": F.col("tp") + F.col("fn") != F.col("positives"),
        "negatives": F.col("fp") + F.col("tn") != F.col("negatives"),
        "gold": F.col("occurrence_tp") + F.col("occurrence_fn") != F.col("_gold"),
        "deltas": reduce(lambda x, y: x | y, [off(F.col(f"d_{c}"), F.col(c) - F.col(f"_{c}")) for c in ("tp", "fp", "fn", "tn")]),
        "rate": off(F.col("fp_rate"), F.col("_rate")),
        "gate": F.col("passed") != F.col("_passed"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    twice = profiles.groupBy("profile").count().where("count > 1").select("profile", F.lit("repeated").alias("rule"))
    return both.select("profile", F.explode(broken).alias("rule")).distinct().unionByName(twice)


def hidden_report(report: DataFrame, leaks: int, attestation: dict, corpus_sha256: str) -> DataFrame:
    """The totals of a hidden evaluation that may be shown: profile, counts and rates, no case.

    The attestation has to name the same corpus, no leak, and two different
    people who approved; report is checked as report_problems does.
    """
    if attestation.get("corpus_sha256") != corpus_sha256:
        raise SieveError("the attestation is of another corpus")
    if leaks or attestation.get("leaks") != 0:
        raise SieveError("hidden cases are known elsewhere")
    approvals = attestation.get("approvals") or []
    if len(approvals) < 2 or len(set(approvals)) != len(approvals):
        raise SieveError("two different approvals are needed")
    bad = metrics.inconsistent(report)
    if rows := bad.select("profile").limit(5).collect():
        raise SieveError(f"contradictory counts: {[r['profile'] for r in rows]}")
    return report.select("profile", "cases", "positives", "tp", "fp", "fn", "tn", "precision", "recall")

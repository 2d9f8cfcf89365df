"""Provenance of dictionary entries: record checks and reconciliation with the term lists.

candidates: candidate_id, surface, normalized_surface, canonical,
normalized_canonical, representation, matcher, target_layer, classification,
status, source_id, evaluation_refs array<string>, review struct<status,
decision_reference>.  sources: source_id, kind, name, reference, revision,
license, license_status, redistribution_allowed.

A record that breaks a rule is reported by its key and the rule's name, and
`sound_sources` and `sound_candidates` leave it out: it is dropped and named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the fields of a record may hold.
IDENTIFIER = "^[a-z0-9][a-z0-9._-]{0,127}$"
SOURCE_VALUES = {"kind": ("curated", "licensed"), "license_status": ("pending", "approved", "rejected")}
CANDIDATE_VALUES = {
    "representation": ("literal", "alias"),
    "matcher": ("exact", "exact_token", "token_prefix"),
    "target_layer": ("core", "ai-candidate"),
    "classification": ("positive", "hard-negative", "review"),
    "status": ("candidate", "packaged", "rejected"),
}
REVIEWS = ("pending", "approved", "rejected")


def _rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of the rules that a row breaks; a rule that has no answer counts as broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def _repeated(df: DataFrame, key: str, rule: str) -> DataFrame:
    return df.groupBy(key).count().where(f"count > 1 and {key} is not null").select(F.col(key).alias("key"), F.lit(rule).alias("rule"))


def _own_source_rules() -> dict[str, Column]:
    texts = {f"source-{c}": F.length(F.trim(c)) == 0 for c in ("name", "revision", "license")}
    values = {f"source-{c}": ~F.col(c).isin(*allowed) for c, allowed in SOURCE_VALUES.items()}
    licensed = (F.coalesce(F.col("kind"), F.lit("")) == "licensed") & F.col("reference").isNull()
    return {"source-id": ~F.col("source_id").rlike(IDENTIFIER), "source-reference": licensed, "source-redistribution": F.col("redistribution_allowed").isNull()} | texts | values


def source_problems(sources: DataFrame) -> DataFrame:
    """(key, rule) of source records."""
    return _rules(sources, "source_id", _own_source_rules()).unionByName(_repeated(sources, "source_id", "source-repeated"))


def _own_candidate_rules() -> dict[str, Column]:
    texts = {c: F.length(F.trim(c)) == 0 for c in ("surface", "normalized_surface", "canonical", "normalized_canonical")}
    values = {c: ~F.col(c).isin(*allowed) for c, allowed in CANDIDATE_VALUES.items()}
    refs = F.exists("evaluation_refs", lambda r: r.isNull() | (r == ""))
    decision = (F.coalesce(F.col("review.status"), F.lit("")) == "approved") & F.col("review.decision_reference").isNull()
    return {"candidate-id": ~F.col("candidate_id").rlike(IDENTIFIER)} | texts | values | {"evaluation_refs": refs, "review-status": ~F.col("review.status").isin(*REVIEWS), "decision": decision}


def candidate_problems(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, rule) of candidate records: their own fields, their source, and what a packaged entry needs."""
    known = sources.select("source_id", F.col("license_status").alias("_license"), F.col("redistribution_allowed").alias("_redistribution"), F.lit(True).alias("_known")).dropDuplicates(["source_id"])
    literals = packaged(candidates).where("representation = 'literal'").select(F.col("normalized_surface").alias("normalized_canonical"), F.lit(True).alias("_literal")).distinct()
    both = candidates.join(known, "source_id", "left").join(literals, "normalized_canonical", "left")
    in_package, from_known = F.coalesce(F.col("status") == "packaged", F.lit(False)), F.coalesce("_known", F.lit(False))
    rules = _own_candidate_rules() | {
        "source-unknown": ~from_known,
        "packaged-layer": in_package & (F.col("target_layer") != "core"),
        "packaged-classification": in_package & (F.col("classification") != "positive"),
        "packaged-canonical": in_package & (F.col("representation") == "alias") & F.col("_literal").isNull(),
        "packaged-review": in_package & ~F.coalesce(F.col("review.status") == "approved", F.lit(False)),
        "packaged-evaluation": in_package & (F.size("evaluation_refs") < 1),
        "packaged-license": in_package & from_known & ~F.coalesce(F.col("_license") == "approved", F.lit(False)),
        "packaged-redistribution": in_package & from_known & ~F.coalesce("_redistribution", F.lit(False)),
    }
    return _rules(both, "candidate_id", rules).unionByName(_repeated(candidates, "candidate_id", "candidate-repeated"))


def _sound(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(True)) for c in rules.values()])
    good = df.where(~broken)
    return good.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.to_json(F.struct(*df.columns))).alias("_r")).select("_r.*")


def sound_sources(sources: DataFrame) -> DataFrame:
    """The source records without a broken field, one for each id."""
    return _sound(sources, "source_id", _own_source_rules())


def sound_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate records without a broken field, one for each id."""
    return _sound(candidates, "candidate_id", _own_candidate_rules())


def packaged(candidates: DataFrame) -> DataFrame:
    """Entries that may stand in the term lists: packaged, for the core layer, positive, with an approved review."""
    return candidates.where("status = 'packaged' and target_layer = 'core' and classification = 'positive' and review.status = 'approved'")


def reconcile(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(surface, issue): listed terms without a packaged literal, and packaged literals that aren't listed."""
    a = packaged(candidates).where("representation = 'literal'").select(F.col("normalized_surface").alias("surface"), F.lit(True).alias("_a")).distinct()
    b = terms.select(F.col("term").alias("surface"), F.lit(True).alias("_b")).distinct()
    both = a.join(b, "surface", "full_outer")
    return both.select("surface", F.when(F.col("_a").isNull(), "no-candidate").when(F.col("_b").isNull(), "not-packaged").alias("issue")).where("issue is not null")


def unresolved_aliases(aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """Aliases whose canonical term is not in the list."""
    return aliases.join(terms.select("term").distinct(), "term", "left_anti")


def negatives_with_core(candidates: DataFrame) -> DataFrame:
    """(candidate_id, term): hard negatives that contain a packaged core term.

    Containment as an equi-join: every substring of a negative of a length that
    some core term has is looked up, whatever that length is.
    """
    core = packaged(candidates).select(F.col("surface").alias("term")).distinct()
    lengths = core.select(F.length("term").alias("n")).distinct()
    neg = candidates.where("classification = 'hard-negative'").select("candidate_id", "surface")
    at = neg.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.length("surface"), F.lit(1)))).alias("i"))
    parts = at.join(lengths, F.col("i") + F.col("n") - 1 <= F.length("surface"))
    return parts.select("candidate_id", F.substring("surface", F.col("i"), F.col("n")).alias("term")).join(core, "term").select("candidate_id", "term").distinct()


def selected(candidates: DataFrame, sources: DataFrame, matcher: str | None = None) -> DataFrame:
    """Packaged candidates of approved sources, one row per surface."""
    ok = packaged(candidates)
    if matcher:
        ok = ok.where(F.col("matcher") == matcher)
    rows = ok.join(sources.where("license_status = 'approved'").select("source_id"), "source_id", "left_semi")
    return rows.groupBy("surface").agg(F.min_by(F.struct(*rows.columns), "candidate_id").alias("_r")).select("_r.*")

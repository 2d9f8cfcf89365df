"""Intakes of foreign sources as review cases: specification, selection, report.

An intake takes rows (row_number, text, source_label) that a source gave, drops
repeated texts and personal data, ranks the rest by a hash that nobody can
steer, and takes each label's quota.  What it returns is blind: all cases are
under review, without spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.columns import leak_key
from lexisieve.operators import sampling
from lexisieve.operators.signals import is_sensitive
from lexisieve.sources.readers import LICENSES, MATCHES, SOURCE, SourceError, written

ID = r"[a-z0-9][a-z0-9._-]{0,127}"
SHA256 = r"[0-9a-f]{64}"


def _fields(value, names: set[str], what: str) -> dict:
    if not isinstance(value, dict) or set(value) != names:
        raise SourceError(f"{what}: the fields have to be {sorted(names)}")
    return value


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise SourceError(what)


def _is_id(value) -> bool:
    import re

    return isinstance(value, str) and re.fullmatch(ID, value) is not None


def _is_hash(value) -> bool:
    import re

    return isinstance(value, str) and re.fullmatch(SHA256, value) is not None


def _is_count(value) -> bool:
    return type(value) is int and value >= 1


def _is_link(value) -> bool:
    return isinstance(value, str) and value.startswith("https://")


def _is_text(value, most: int) -> bool:
    return isinstance(value, str) and 0 < len(value) <= most


def licensed_spec(spec: dict) -> dict:
    """A checked specification of a licensed source: pinned artifact, open licence, known format, one target policy."""
    _fields(spec, {"source_id", "source_name", "repository", "revision", "artifact", "license", "format", "intake"}, "specification")
    _need(_is_id(spec["source_id"]), "source_id")
    _need(_is_text(spec["source_name"], 200) and _is_text(spec["revision"], 200) and _is_link(spec["repository"]), "source_name, revision or repository")
    a = _fields(spec["artifact"], {"url", "sha256", "size_bytes", "line_count"}, "artifact")
    _need(_is_link(a["url"]) and _is_hash(a["sha256"]) and _is_count(a["size_bytes"]) and _is_count(a["line_count"]), "artifact")
    lic = _fields(spec["license"], {"spdx", "url", "sha256"}, "license")
    _need(lic["spdx"] in LICENSES and _is_link(lic["url"]) and _is_hash(lic["sha256"]), "license")
    f = _fields(spec["format"], {"delimiter", "header_rows", "text_column", "label_column", "allowed_labels"}, "format")
    labels = f["allowed_labels"]
    _need(f["delimiter"] in ("|", "\t", ",") and f["header_rows"] in (0, 1) and type(f["text_column"]) is int and f["text_column"] >= 0, "format")
    if f["label_column"] is None:
        _need(labels is None, "allowed_labels: a source without labels has none")
    else:
        _need(isinstance(labels, list) and bool(labels) and all(isinstance(x, str) for x in labels) and len(set(labels)) == len(labels), "allowed_labels")
    i = _fields(spec["intake"], {"corpus_id", "target_count", "target_by_source_label"}, "intake")
    targets = i["target_by_source_label"]
    _need(_is_id(i["corpus_id"]), "corpus_id")
    _need((i["target_count"] is None) != (targets is None), "exactly one target policy")
    _need(i["target_count"] is None or _is_count(i["target_count"]), "target_count")
    _need(targets is None or (bool(targets) and all(map(_is_count, targets.values())) and set(targets) <= set(labels or ())), "target_by_source_label")
    return dict(spec)


def quarantine_spec(spec: dict) -> dict:
    """A checked specification of a source whose rights are not settled: three pinned artifacts, pending review, exclusions, targets for labels 0 and 1."""
    _fields(spec, {"source_id", "revision", "artifacts", "rights_review", "exclusions", "intake"}, "specification")
    _need(_is_id(spec["source_id"]) and _is_text(spec["revision"], 200), "source_id or revision")
    for name, a in _fields(spec["artifacts"], {"dataset", "license", "provenance"}, "artifacts").items():
        _need(_is_hash(a.get("sha256")) and _is_count(a.get("size_bytes")), name)
    review = _fields(spec["rights_review"], {"status", "blockers"}, "rights_review")
    _need(review["status"] == "pending" and isinstance(review["blockers"], list) and bool(review["blockers"]), "rights_review: pending, with blockers")
    _need(isinstance(spec["exclusions"], list) and all(_is_hash(e.get("artifact_sha256")) for e in spec["exclusions"]), "exclusions")
    i = _fields(spec["intake"], {"corpus_id", "target_by_source_label"}, "intake")
    _need(_is_id(i["corpus_id"]) and set(i["target_by_source_label"]) == {"0", "1"} and all(map(_is_count, i["target_by_source_label"].values())), "intake")
    return dict(spec)


def composition_config(config: dict) -> dict:
    """A checked composition: policy, a share from 0 (excluded) to 1, sources with ids and paths of their own and quotas of 1 or more."""
    _fields(config, {"composition_id", "corpus_id", "split", "selection", "max_source_share", "sources"}, "composition")
    share = config["max_source_share"]
    _need(_is_text(config["composition_id"], 128) and _is_text(config["corpus_id"], 128), "composition_id or corpus_id")
    _need(config["split"] == "tuning" and config["selection"] == "stable-sha256-rank-v1", "split or selection")
    _need(type(share) in (int, float) and 0 < share <= 1, "max_source_share")
    _need(isinstance(config["sources"], list) and bool(config["sources"]), "sources")
    for s in config["sources"]:
        _fields(s, {"source_id", "corpus_path", "expected_corpus_id", "quota"}, "source")
        _need(_is_text(s["source_id"], 128) and _is_text(s["corpus_path"], 4096) and _is_text(s["expected_corpus_id"], 128) and _is_count(s["quota"]), "source")
    for name in ("source_id", "corpus_path"):
        _need(len({s[name] for s in config["sources"]}) == len(config["sources"]), f"{name}: repeated")
    return config | {"max_source_share": float(share)}


def composition_problems(cases: DataFrame) -> DataFrame:
    """(id, rule): cases that may not enter a composition, and review cases that are not blind."""
    s = F.col("source")
    open_data = (F.col("split") == "tuning") & s["redistribution_allowed"] & (s["kind"] != "private")
    blind = (F.size("expected_matches") == 0) & F.col("slices").eqNullSafe(F.array(F.lit("unadjudicated-intake")))
    rules = F.array_compact(F.array(F.when(~F.coalesce(open_data, F.lit(False)), "not-open-tuning"), F.when((F.col("label") == "review") & ~F.coalesce(blind, F.lit(False)), "not-blind")))
    return cases.select("id", F.explode(rules).alias("rule"))


def review_cases(rows: DataFrame, source_id: str, name: str, reference: str | None, revision: str, license_id: str, split: str = "tuning", open_data: bool = True) -> DataFrame:
    """rows (text, identity, ...) as corpus cases under review."""
    source = F.struct(F.lit("licensed").alias("kind"), F.lit(name).alias("name"), F.lit(reference).cast("string").alias("reference"), F.lit(revision).alias("revision"), F.lit(open_data).alias("redistribution_allowed"))
    return rows.select(
        F.concat(F.lit(f"{source_id}-review-"), F.substring("identity", 1, 20)).alias("id"), "text", F.lit("review").alias("label"), F.array().cast(MATCHES).alias("expected_matches"),
        F.array(F.lit("unadjudicated-intake")).alias("slices"), source.cast(SOURCE).alias("source"), F.lit(license_id).alias("license"), F.lit(split).alias("split"),
        F.lit("Under review; foreign labels are no gold.").alias("notes"),
    )


def _judged(rows: DataFrame, source_id: str, revision: str, name: str, **more: Column) -> DataFrame:
    """What selection and report ask of each row, without its text: texts are read and matched once, and what was found is written."""
    identity = sampling.identity(F.col("text"))
    found = rows.select("row_number", "source_label", identity.alias("identity"), is_sensitive(F.col("text")).alias("sensitive"), *[c.alias(k) for k, c in more.items()])
    return written(found, name).withColumn("rank", sampling.stable_rank(source_id, revision, F.col("source_label"), F.col("identity")))


def _with_text(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_number, source_label, identity, text) of the rows chosen, which the quotas bound; a row that the source holds twice comes once."""
    keys = ("row_number", "source_label", "identity")
    c, r = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys]), rows.select("row_number", "source_label", sampling.identity(F.col("text")).alias("identity"), "text")
    return r.join(F.broadcast(c), reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi").dropDuplicates(keys)


def _look(text: Column) -> Column:
    """The hash of the leak key, for texts that have to be alike and not to be shown."""
    return F.unhex(F.sha2(leak_key(text), 256))


def _report(parts: dict[str, DataFrame]) -> DataFrame:
    """(measure, source_label, n) of the rows of each part by label."""
    return reduce(DataFrame.unionByName, [df.groupBy("source_label").agg(F.count("*").alias("n")).select(F.lit(k).alias("measure"), "source_label", "n") for k, df in parts.items()])


def licensed(rows: DataFrame, spec: dict, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, report) of a licensed source's rows (row_number, text, source_label).

    Of equal texts the first row stays, whatever its label; the report counts
    rows by measure and label.
    """
    spec = licensed_spec(spec)
    i = spec["intake"]
    every = _judged(rows, spec["source_id"], spec["revision"], "licensed")
    first = sampling.keep_first(every, F.col("identity"), F.col("row_number"))
    eligible = first.where(~F.col("sensitive"))
    order = (F.col("rank"), F.col("row_number"))
    if i["target_count"] is not None:
        chosen = sampling.top_k(eligible, i["target_count"], *order, exact=exact)
    else:
        chosen = sampling.top_k_per_label(eligible, i["target_by_source_label"], "source_label", *order, exact=exact)
    cases = review_cases(_with_text(chosen, rows), spec["source_id"], spec["source_name"], spec["repository"], spec["revision"], spec["license"]["spdx"])
    return cases, _report({"source": every, "unique": first, "eligible": eligible, "selected": chosen})


def quarantine(rows: DataFrame, excluded: DataFrame, spec: dict, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, report) of rows (row_number, text, source_label 0 or 1) whose rights are pending.

    Rows that look like an excluded text (by leak key), hold personal data, or
    whose key has rows of both labels go; of equal keys the first in rank stays.
    """
    spec = quarantine_spec(spec)
    every = _judged(rows, spec["source_id"], spec["revision"], "quarantine", key=_look(F.col("text")))
    out = written(excluded.select(_look(F.col("text")).alias("key")).distinct(), "excluded")
    apart = sampling.without(every, out, "key")
    harmless = apart.where(~F.col("sensitive"))
    order = (F.col("rank"), F.col("row_number"))
    single = sampling.conflict_free(harmless, "key", "source_label", *order)
    chosen = sampling.top_k_per_label(single, spec["intake"]["target_by_source_label"], "source_label", *order, exact=exact)
    cases = review_cases(_with_text(chosen, rows), spec["source_id"], spec["source_id"], None, spec["revision"], "LicenseRef-Pending", open_data=False)
    return cases, _report({"source": every, "not-excluded": apart, "not-sensitive": harmless, "eligible": single, "selected": chosen})

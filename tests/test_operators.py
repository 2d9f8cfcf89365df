import json

import pytest
from pyspark.sql import functions as F

from lexisieve.operators import annotation, metrics, sampling, signals, splits, validation
from lexisieve.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_signals(spark):
    df = spark.createDataFrame([("mail me at a.b@c.de",), ("010-1234-5678",), ("version 1.2.3",), ("call 123456",), ("aaa \"x\" 😀",), ("가 나",)], "t string")
    assert [r[0] for r in df.select(signals.is_sensitive(F.col("t"))).collect()] == [True, True, False, True, False, False]
    s = df.select(signals.surface_signals(F.col("t")).alias("s")).collect()
    assert s[4][0] == ["ascii-token", "repeated-character", "quoted-marker", "non-bmp-unicode"] and s[5][0] == ["single-hangul-gap"]


def test_sampling(spark):
    df = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "x", 1), (3, "b", "y", 0), (4, "c", "y", 0), (5, "b", "y", 0), (6, None, "x", 0)], "id int, k string, src string, lab int")
    assert rows(sampling.keep_first(df, F.col("k"), F.col("id")), "id") == [(1,), (3,), (4,), (6,)]
    assert rows(sampling.conflict_free(df, "k", "lab", F.col("id")), "id") == [(3,), (4,), (6,)]
    assert rows(sampling.compose([("x", df.where("src = 'x'"), 1), ("y", df, 2)], "k", F.col("id"), exact=False), "id", "source_id")[0] == (1, "x")
    with pytest.raises(sampling.QuotaError):
        sampling.compose([("x", df, 9)], "k", F.col("id"))
    with pytest.raises(sampling.QuotaError):
        sampling.compose([("x", df.where("src = 'x'"), 1), ("y", df, 2)], "k", F.col("id"), most_share=0.5)
    assert [r["id"] for r in sampling.round_robin(df, "src", F.col("id"), limit=3).orderBy("position").collect()] == [1, 3, 2]


def test_splits(spark):
    c = spark.createDataFrame([(1, "t", "tuning"), (2, "t", "evaluation"), (3, "T!", "evaluation"), (4, "u", "private")], "id int, text string, split string").withColumn("key", F.lower(F.regexp_replace("text", "!", "")))
    assert rows(splits.direct_leaks(c), "visible_id", "hidden_id") == [(1, 2)]
    assert rows(splits.normalized_leaks(c, "text", "key"), "visible_id", "hidden_id") == [(1, 3)]
    a = spark.createDataFrame([("1", "c", "tuning"), ("2", "c", "tuning")], "case_id string, corpus_id string, split string")
    b = spark.createDataFrame([("2", "c", "private"), ("3", "c", "tuning")], "case_id string, corpus_id string, split string")
    assert rows(splits.reconcile(a, b), "case_id", "issue") == [("1", "missing-from-corpus"), ("2", "split-differs"), ("3", "missing-from-manifest")]
    assert splits.moved(a, b).count() == 2 and [r["case_id"] for r in splits.build_manifest(a, b).collect()] == ["1", "2", "3"]


def test_validation(spark, tmp_path):
    def case(i, **k):
        return {"id": i, "text": "abc", "label": "positive", "expected_matches": [{"start": 0, "end": 1, "canonical_term": "a"}], "slices": ["s"], "source": {"kind": "curated", "name": "n", "redistribution_allowed": True}, "license": "MIT", "split": "tuning", "notes": ""} | k

    cases = [case("good"), case("twice"), case("twice"), case("Bad id"), case("neg", label="hard-negative"), case("span", expected_matches=[{"start": 2, "end": 9, "canonical_term": "x"}]), case("null", license=None, source=None)]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "corpus_id": "c", "cases": cases}, indent=1))
    df = readers.corpora(spark, str(tmp_path))
    found = set(rows(validation.validate(df, ["s"]), "id", "rule"))
    assert {("twice", "id-repeated"), ("Bad id", "id"), ("neg", "negative-with-match"), ("span", "span-range")} <= found
    assert not any(i == "good" for i, _ in found) and any(i == "null" for i, _ in found)
    raw = spark.createDataFrame([('{"id": 1, "extra": 2}',)], "value string")
    assert rows(validation.unknown_fields(raw, ["id"]), "field") == [("extra",)]


def test_annotation(spark):
    schema = "case_id int, privacy_status string, label string, matches array<int>, slices array<string>"
    p = spark.createDataFrame([(1, "approved", "a", [1], ["x", "y"]), (2, "approved", "a", [1], []), (3, "pending", "a", [], []), (4, "exclude", "a", [], []), (5, "approved", "a", [], [])], schema)
    s = spark.createDataFrame([(1, "approved", "a", [1], ["y", "x"]), (2, "approved", "b", [1], []), (3, "approved", "a", [], []), (4, "pending", "a", [], [])], schema)
    m = annotation.merge(p, s)
    assert rows(m, "case_id", "outcome") == [(1, "consensus"), (2, "disagreement"), (3, "pending"), (4, "exclude"), (5, "unpaired")]
    t = spark.createDataFrame([(2, "approved", "c", [2], []), (3, "approved", "c", [], [])], schema)
    done = annotation.adjudicate(m, t)
    assert rows(done, "case_id", "outcome")[1:3] == [(2, "adjudicated"), (3, "pending")]
    out = annotation.apply_decisions(p.drop("privacy_status"), done)
    assert {r["case_id"]: r["label"] for r in out.collect()}[2] == "c"
    _, moves, odd = annotation.reaudit_apply(p, t, ("label",), fixed=("matches",))
    assert rows(moves, "before", "after", "n") == [("a", "c", 2)] and rows(odd, "case_id") == [(2,)]


def test_metrics(spark):
    j = spark.createDataFrame([(True, True), (True, False), (False, False)], "g boolean, f boolean")
    r = metrics.rates(metrics.confusion(j, "g", "f")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) == (1, 0, 1, 1, 1.0, 0.5)
    none = metrics.rates(metrics.confusion(j.where("false"), "g", "f")).first()
    assert none["tp"] == 0 and none["precision"] is None and none["f1"] is None
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",)], "k string")
    assert tuple(metrics.set_occurrences(a, b, ("k",)).first()) == (1, 1, 1)
    assert tuple(metrics.multiset_occurrences(a, b, ("k",)).first()) == (1, 1, 2)
    m = spark.createDataFrame([("a", 1, 0, 1, 8, 10, 2, 1.0, 0.5), ("b", 1, 1, 1, 7, 10, 2, 0.5, 0.9)], "profile string, tp long, fp long, fn long, tn long, cases long, positives long, precision double, recall double")
    assert rows(metrics.inconsistent(m), "profile") == [("b",)] and rows(metrics.deltas(m, "a"), "profile", "d_fp") == [("a", 0), ("b", 1)]
    cases = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abc")], "case_id int, text string")
    preds = spark.createDataFrame([(1, True, [(0, 9)]), (2, True, []), (4, False, [])], "case_id int, detected boolean, matches array<struct<start:int,end:int>>")
    assert rows(metrics.prediction_problems(cases, preds), "case_id", "issue") == [(1, "span"), (2, "flag"), (3, "missing"), (4, "unknown-case")]


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text("﻿b\n # no\n\na \nb\n", encoding="utf-8")
    assert rows(readers.term_list(spark, str(tmp_path / "t.txt")), "term") == [("a",), ("b",)]
    (tmp_path / "a.tsv").write_text("x\ty\texact_token\nz\ty\n")
    assert rows(readers.alias_list(spark, str(tmp_path / "a.tsv")), "alias", "ok") == [("x", True), ("z", False)]
    (tmp_path / "d.txt").write_text("one|two|1\nthree|0\nbad\n")
    assert rows(readers.delimited(spark, str(tmp_path / "d.txt"), "pipe", label=-1, allowed=["0", "1"]), "line", "text", "source_label", "ok") == [(1, "one|two", "1", True), (2, "three", "0", True), (3, "", "bad", False)]
    assert rows(readers.pipe_last_label(spark, str(tmp_path / "d.txt")), "text") == [("one|two",), ("three",)]
    (tmp_path / "l.tsv").write_text("content\tlable\nhi\t1\nyo\tx\n")
    assert {tuple(r) for r in readers.labelled_tsv(spark, str(tmp_path / "l.tsv")).collect()} == {("hi", 1), ("yo", None)}
    with pytest.raises(readers.SourceError):
        readers.check_artifact(spark, str(tmp_path / "l.tsv"), "0" * 64)
    with pytest.raises(readers.SourceError):
        readers.write_json(spark.range(1), "/in/x", ("/in",))
    assert readers.canonical_hash({"b": 1, "a": [2]}) == readers.canonical_hash(json.loads('{"a":[2],"b":1}'))


def test_provenance_and_generation(spark):
    from lexisieve.operators import generation, provenance

    sources = spark.createDataFrame(
        [("s", "licensed", "n", None, "r", "MIT", "approved", True), ("t", "curated", " ", None, "r", "MIT", "pending", None), ("ok", "curated", "n", None, "r", "MIT", "approved", True), ("ok", "curated", "n", None, "r", "MIT", "approved", True)],
        "source_id string, kind string, name string, reference string, revision string, license string, license_status string, redistribution_allowed boolean",
    )
    assert set(rows(provenance.source_problems(sources), "key", "rule")) == {("s", "source-reference"), ("t", "source-redistribution"), ("t", "source-name"), ("ok", "source-repeated")}
    assert rows(provenance.sound_sources(sources), "source_id") == [("ok",)]

    def record(key, surface, source="ok", layer="core", kind="positive", status="packaged", refs=("e",), review=("approved", "d"), form="literal"):
        return (key, surface, surface, surface, surface, form, "exact", layer, kind, status, source, list(refs), review)

    c = spark.createDataFrame(
        [
            record("1", "bad"),
            record("2", "badge", kind="hard-negative", status="candidate", review=("approved", None)),
            record("3", "odd", source="u", layer="x", kind=None, status="candidate", review=("pending", None)),
            record("4", "far", form="alias", source="t", refs=(), review=("pending", None)),
        ],
        "candidate_id string, surface string, normalized_surface string, canonical string, normalized_canonical string, representation string, matcher string, target_layer string, classification string, status string, source_id string, evaluation_refs array<string>, review struct<status:string,decision_reference:string>",
    )
    broken = {("2", "decision"), ("3", "target_layer"), ("3", "classification"), ("3", "source-unknown")} | {("4", f"packaged-{r}") for r in ("canonical", "review", "evaluation", "license", "redistribution")}
    assert set(rows(provenance.candidate_problems(c, sources), "key", "rule")) == broken
    assert rows(provenance.sound_candidates(c), "candidate_id") == [("1",), ("4",)]
    terms = spark.createDataFrame([("worse",)], "term string")
    assert rows(provenance.reconcile(c, terms), "surface", "issue") == [("bad", "not-packaged"), ("worse", "no-candidate")]
    assert rows(provenance.negatives_with_core(c), "candidate_id", "term") == [("2", "bad")] and rows(provenance.selected(c, sources), "candidate_id") == [("1",)]
    made = generation.from_templates(spark.createDataFrame([("ab",)], "term string"), spark.createDataFrame([("so {surface}!",), ("{surface}",)], "template string"))
    assert rows(made, "text") == [("ab",), ("so ab!",)]
    assert rows(generation.variants(made.select("term").distinct()), "surface") == [("a  b",), ("a * b",), ("a*b",), ("ab",)]
    assert generation.common(made, made.where("text = 'ab'")).count() == 1 and generation.forbidden(made, ["so"]).count() == 1
    for shape in ("standard", "prefix", "hangul"):
        assert generation.synthetic_terms(spark, 50, shape).distinct().count() == 50


def test_batches(spark):
    b = spark.createDataFrame([(1, "abc", "approved", "positive", []), (2, "abx", "odd", "hard-negative", [(0, 9)]), (9, "q", "approved", "review", [])], "case_id int, text string, privacy_status string, label string, matches array<struct<start:int,end:int>>")
    c = spark.createDataFrame([(1, "abc"), (2, "abc")], "case_id int, text string")
    assert set(rows(annotation.batch_problems(b, c), "case_id", "rule")) == {(1, "positive-without-match"), (2, "text"), (2, "status"), (2, "negative-with-match"), (2, "span"), (9, "unknown")}
    assert rows(annotation.exclusion_problems(b, c, ("text",)), "case_id") == [(2,), (9,)]


def test_ablation_has_a_row_for_every_profile(spark):
    from lexisieve.operators import metrics

    key = "case_id long, start int, end int, term string"
    found = spark.createDataFrame([(1, 0, 3, "x", f"p{i}") for i in range(100)], key + ", profile string")
    gold = spark.createDataFrame([(1, 0, 3, "x")], key)
    assert metrics.ablation(found, gold, "p0", "p1").count() == 99


def test_containment_tests_every_short_passage(spark, tmp_path):
    from lexisieve.plans import catalog

    spark.range(10_500).selectExpr("id AS item_id", "concat('<', id, '>') AS text").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.sql("SELECT 1L AS doc_id, concat_ws('', transform(sequence(0, 10499), i -> concat('<', i, '>'))) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.containment_theta_join(spark, str(tmp_path)).count() == 10_500


def test_intake_specifications():
    import copy

    from lexisieve.operators import intake
    from lexisieve.plans.corpus import LICENSED, QUARANTINE
    from lexisieve.sources.readers import SourceError

    assert intake.licensed_spec(LICENSED) == LICENSED and intake.quarantine_spec(QUARANTINE) == QUARANTINE
    config = {"composition_id": "a", "corpus_id": "b", "split": "tuning", "selection": "stable-sha256-rank-v1", "max_source_share": 1, "sources": [{"source_id": "s", "corpus_path": "p", "expected_corpus_id": "c", "quota": 2}]}
    assert intake.composition_config(config)["max_source_share"] == 1.0
    for check, good, path, bad in (
        (intake.licensed_spec, LICENSED, ("extra",), 1),
        (intake.licensed_spec, LICENSED, ("license", "spdx"), "GPL-3.0"),
        (intake.licensed_spec, LICENSED, ("artifact", "sha256"), "0"),
        (intake.licensed_spec, LICENSED, ("artifact", "line_count"), True),
        (intake.licensed_spec, LICENSED, ("repository",), "http://example.org"),
        (intake.licensed_spec, LICENSED, ("format", "label_column"), None),
        (intake.licensed_spec, LICENSED, ("intake", "target_count"), 3),
        (intake.licensed_spec, LICENSED, ("intake", "target_by_source_label"), {"xx": 1}),
        (intake.quarantine_spec, QUARANTINE, ("rights_review", "status"), "approved"),
        (intake.quarantine_spec, QUARANTINE, ("intake", "target_by_source_label"), {"0": 1}),
        (intake.composition_config, config, ("max_source_share",), 0),
        (intake.composition_config, config, ("max_source_share",), float("nan")),
        (intake.composition_config, config, ("sources",), config["sources"] * 2),
        (intake.composition_config, config, ("split",), "evaluation"),
    ):
        spec = copy.deepcopy(good)
        at = spec
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = bad
        with pytest.raises(SourceError):
            check(spec)


def test_intake_needs_its_targets(spark):
    from lexisieve.operators import intake
    from lexisieve.operators.sampling import QuotaError
    from lexisieve.plans.corpus import LICENSED

    r = spark.createDataFrame([(1, "one", "en"), (2, "one", "de"), (3, "mail a@b.org", "en"), (4, "two", "en")], "row_number long, text string, source_label string")
    with pytest.raises(QuotaError):
        intake.licensed(r, LICENSED)
    cases, report = intake.licensed(r, LICENSED | {"intake": LICENSED["intake"] | {"target_by_source_label": {"en": 2}}})
    assert rows(cases, "text", "label", "split") == [("one", "review", "tuning"), ("two", "review", "tuning")]
    assert set(rows(report, "measure", "source_label", "n")) == {("source", "en", 3), ("source", "de", 1), ("unique", "en", 3), ("eligible", "en", 2), ("selected", "en", 2)}
    assert intake.licensed(r.where("false"), LICENSED, exact=False)[0].count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from lexisieve.sources import readers

    path = str(tmp_path / "long.txt")
    with open(path, "w") as f:
        f.write("\ufefftext\tlabel\n" + "".join(f"row {i}\t{i % 2}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = readers.delimited(spark, path, header=True, allowed=["0", "1"])
        assert out.rdd.getNumPartitions() > 1 and out.where("text <> concat('row ', line - 2) or not ok").count() == 0 and out.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_problems_and_hidden_reports(spark):
    from lexisieve.functions.settings import SieveError
    from lexisieve.operators import evaluation, metrics

    m = spark.createDataFrame([("a", 4, 2, 2, 1, 1, 1, 1), ("b", 4, 2, 2, 2, 0, 0, 2)], "profile string, cases long, positives long, negatives long, tp long, fp long, fn long, tn long")
    good = metrics.rates(metrics.gates(m).join(metrics.deltas(m, "a"), "profile").withColumns({"occurrence_tp": F.lit(1), "occurrence_fp": F.lit(0), "occurrence_fn": F.lit(1)}))
    assert evaluation.report_problems(good, "a").count() == 0
    assert rows(evaluation.report_problems(good.withColumn("tp", F.col("tp") + (F.col("profile") == "b").cast("int")), "a"), "rule") == [("cases",), ("deltas",), ("positives",)]
    with pytest.raises(SieveError):
        metrics.deltas(m.unionByName(m), "a")
    signed = {"corpus_sha256": "x", "leaks": 0, "approvals": ["p", "q"]}
    assert evaluation.hidden_report(good, 0, signed, "x").columns == ["profile", "cases", "positives", "tp", "fp", "fn", "tn", "precision", "recall"]
    for attestation, leaks, sha in ((signed, 1, "x"), (signed, 0, "y"), (signed | {"approvals": ["p", "p"]}, 0, "x")):
        with pytest.raises(SieveError):
            evaluation.hidden_report(good, leaks, attestation, sha)


def test_every_query_with_sql_has_the_columns_of_its_sql():
    from lexisieve.plans import catalog, corpus, detection

    assert corpus and detection and set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 110

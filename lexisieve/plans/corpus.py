"""Queries over sources and sinks, intakes, decisions with spans, provenance and reports, with the DuckDB SQL each has to agree with.

Queries on sources write files in the source's format into the shared folder
and read them back with the reader under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.columns import leak_key
from lexisieve.functions.lexicon import Lexicon
from lexisieve.operators import annotation, evaluation, generation, intake, metrics, provenance, splits, validation
from lexisieve.plans.catalog import _SENSITIVE_SQL as SENSITIVE_SQL
from lexisieve.plans.catalog import ANY, TERMS, documents, query, sieve, split_of, table, tokens
from lexisieve.sources import readers as R

TOKENS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS term FROM documents"


def lines(df: DataFrame, name: str) -> str:
    """Writes the one string column of df as text files; their folder."""
    path = R.scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


# ---- sources and sinks


@query(TOKENS)
def source_term_list(spark, sf):
    own = tokens(table(spark, sf, "documents")).select(F.concat(F.lit("  "), "token", F.lit(" ")).alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("",), ("   ",), ("  # another",)], "value string")
    return R.term_list(spark, lines(own.unionByName(noise), "terms"))


@query("SELECT 'a' || vec_id AS alias, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 't' || label END AS term, CASE vec_id % 3 WHEN 0 THEN 'exact_token' WHEN 1 THEN 'token_prefix' ELSE 'other' END AS mode, vec_id % 5 <> 0 AND vec_id % 3 < 2 AS ok FROM embeddings")
def source_alias_list(spark, sf):
    i = F.col("vec_id")
    term = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("label").cast("string")))
    mode = F.when(i % 3 == 0, "exact_token").when(i % 3 == 1, "token_prefix").otherwise("other")
    own = table(spark, sf, "embeddings").select(F.concat_ws("\t", F.concat(F.lit("a"), i.cast("string")), term, mode).alias("value"))
    return R.alias_list(spark, lines(own, "aliases"))


@query("SELECT source AS alias, count(DISTINCT lang) AS rules FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def source_alias_conflicts(spark, sf):
    return R.alias_conflicts(table(spark, sf, "documents").select(F.col("source").alias("alias"), F.col("lang").alias("term"), F.lit("exact_token").alias("mode")))


def _labelled(spark, sf) -> DataFrame:
    odd = F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("toxic").cast("string"))
    return table(spark, sf, "labels").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("t"), odd.alias("l"))


_LABEL = "CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE toxic::VARCHAR END"


@query(f"SELECT 'doc ' || doc_id AS text, {_LABEL} AS source_label, doc_id % 10 <> 0 AS ok FROM labels")
def source_delimited(spark, sf):
    path = lines(_labelled(spark, sf).select(F.concat_ws("\t", "t", "l").alias("value")), "delimited")
    return R.delimited(spark, path, allowed=["0", "1"]).select("text", "source_label", "ok")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS line, n_name AS text FROM nation")
def source_numbered_lines(spark, sf):
    own = table(spark, sf, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1)
    return R.numbered_lines(spark, lines(own, "lines")).select("line", F.col("value").alias("text"))


@query("SELECT 'doc ' || doc_id AS text, CASE WHEN doc_id % 10 <> 0 THEN toxic::INTEGER END AS label FROM labels")
def source_labelled_tsv(spark, sf):
    path = R.scratch_path(spark, "tsv")
    _labelled(spark, sf).select(F.col("t").alias("content"), F.col("l").alias("lable")).write.option("sep", "\t").option("header", True).csv(path)
    return R.labelled_tsv(spark, path)


@query("SELECT DISTINCT 'doc|' || (doc_id // 2) AS text FROM labels WHERE doc_id % 10 <> 0")
def source_pipe_last_label(spark, sf):
    own = _labelled(spark, sf).select(F.concat(F.lit("doc|"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("|"), "l").alias("value"))
    return R.pipe_last_label(spark, lines(own, "pipe"))


_CASE = "named_struct('id', concat('case-', n_nationkey), 'text', n_name, 'label', 'review', 'expected_matches', array(named_struct('start', 0, 'end', 1, 'canonical_term', 'x')), 'slices', array('a'), 'source', named_struct('kind', 'curated', 'name', 'n', 'reference', NULL, 'revision', 'r', 'redistribution_allowed', true), 'license', 'MIT', 'split', 'tuning', 'notes', '')"


@query("SELECT 'corpus-' || n_regionkey AS corpus_id, 'case-' || n_nationkey AS id, n_name AS text, 1 AS n FROM nation")
def source_corpora(spark, sf):
    """Five corpus documents, one a region, found in a folder that also holds a schema."""
    path = R.scratch_path(spark, "corpora")
    nested = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.expr(_CASE)).alias("cases"))
    for r in table(spark, sf, "region").select("r_regionkey").collect():  # a handful of documents of a file each
        own = nested.where(F.col("n_regionkey") == r["r_regionkey"]).select(F.lit(1).alias("schema_version"), F.concat(F.lit("corpus-"), F.col("n_regionkey").cast("string")).alias("corpus_id"), "cases")
        own.coalesce(1).write.json(f"{path}/{r['r_regionkey']}")
    return R.corpora(spark, path).select("corpus_id", "id", "text", F.size("expected_matches").alias("n"))


@query("SELECT sum(length(n_name) + 1)::BIGINT AS bytes, count(*)::INTEGER AS lines FROM nation")
def source_artifact(spark, sf):
    path = lines(table(spark, sf, "nation").select(F.col("n_name").alias("value")).coalesce(1), "artifact")
    return R.artifact(spark, f"{path}/*.txt").select("bytes", F.col("lines").cast("int").alias("lines"))


@query("SELECT 'n' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE repeat('ab', n_nationkey::INTEGER) END AS text, CASE WHEN n_nationkey % 7 = 0 THEN 'odd' ELSE 'strict' END AS profile, n_nationkey % 7 <> 0 AS ok FROM nation")
def source_benchmark_cases(spark, sf):
    i, path = F.col("n_nationkey"), R.scratch_path(spark, "benchmark")
    case = F.struct(F.concat(F.lit("n"), i.cast("string")).alias("name"), F.when(i % 2 == 0, F.col("n_name")).alias("text"), F.when(i % 2 == 1, "ab").alias("pattern"), F.when(i % 2 == 1, i.cast("int")).alias("repeat"), F.when(i % 7 == 0, "odd").otherwise("strict").alias("profile"))
    table(spark, sf, "nation").agg(F.collect_list(case).alias("cases")).coalesce(1).write.json(path)
    return R.benchmark_cases(spark, path)


@query("SELECT doc_id, lang, sha256(text) AS h FROM documents")
def json_sink(spark, sf):
    path = R.scratch_path(spark, "json")
    R.write_json(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.sha2("text", 256).alias("h"))


# ---- intakes


def _hash(c: str) -> str:
    return c * 64


LICENSED = {
    "source_id": "corpus", "source_name": "A corpus", "repository": "https://example.org/corpus", "revision": "r1",
    "artifact": {"url": "https://example.org/corpus.tsv", "sha256": _hash("a"), "size_bytes": 1, "line_count": 1},
    "license": {"spdx": "MIT", "url": "https://example.org/license", "sha256": _hash("b")},
    "format": {"delimiter": "\t", "header_rows": 0, "text_column": 0, "label_column": 1, "allowed_labels": ["de", "en", "es", "fr"]},
    "intake": {"corpus_id": "corpus-review", "target_count": None, "target_by_source_label": {"en": 40, "de": 20}},
}
QUARANTINE = {
    "source_id": "pending", "revision": "r1", "artifacts": {n: {"sha256": _hash("c"), "size_bytes": 1} for n in ("dataset", "license", "provenance")},
    "rights_review": {"status": "pending", "blockers": ["rights"]}, "exclusions": [], "intake": {"corpus_id": "pending-review", "target_by_source_label": {"0": 30, "1": 10}},
}


def _intake_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), "text", F.col("lang").alias("source_label"))


_LICENSED = f"""
WITH r AS (SELECT doc_id, text, lang, sha256(text) AS identity FROM documents),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
e AS (SELECT *, sha256('corpus' || chr(0) || 'r1' || chr(0) || lang || chr(0) || identity) AS rank FROM u WHERE NOT regexp_matches(text, '{SENSITIVE_SQL}')),
c AS (SELECT * FROM e WHERE lang IN ('en', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY rank, doc_id) <= CASE lang WHEN 'en' THEN 40 ELSE 20 END)
"""


@query(_LICENSED + "SELECT 'corpus-review-' || substring(identity, 1, 20) AS id, identity AS h, 'review' AS label, 0 AS n, 'unadjudicated-intake' AS slices, 'https://example.org/corpus' AS reference, 'MIT' AS license, 'tuning' AS split FROM c")
def licensed_intake(spark, sf):
    c = intake.licensed(_intake_rows(spark, sf), LICENSED, exact=False)[0]
    return c.select("id", F.sha2("text", 256).alias("h"), "label", F.size("expected_matches").alias("n"), F.array_join("slices", ",").alias("slices"), F.col("source.reference").alias("reference"), "license", "split")


def _measures(parts: dict[str, str], label: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS measure, {label} AS source_label, count(*) AS n FROM {t} GROUP BY 2" for k, t in parts.items())


@query(_LICENSED + _measures({"source": "r", "unique": "u", "eligible": "e", "selected": "c"}, "lang"))
def licensed_intake_report(spark, sf):
    return intake.licensed(_intake_rows(spark, sf), LICENSED, exact=False)[1]


def _rights_pending(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("row_number"), "text", F.col("quality").cast("string").alias("source_label"), "source")


_KEY = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{Z}\p{Cf}]', '', 'g')"
_QUARANTINE = f"""
WITH k0 AS (SELECT doc_id, text, source, quality::VARCHAR AS label, string_split({_KEY}, '') AS c FROM documents JOIN labels USING (doc_id)),
r AS (SELECT doc_id, text, source, label, array_to_string(list_filter(c, lambda x, i: i = 1 OR c[i - 1] <> x), '') AS key FROM k0),
a AS (SELECT * FROM r WHERE key NOT IN (SELECT key FROM r WHERE source = 'src0')),
s AS (SELECT *, sha256('pending' || chr(0) || 'r1' || chr(0) || label || chr(0) || sha256(text)) AS rank FROM a WHERE NOT regexp_matches(text, '{SENSITIVE_SQL}')),
e AS (SELECT * FROM s QUALIFY min(label) OVER (PARTITION BY key) = max(label) OVER (PARTITION BY key) AND row_number() OVER (PARTITION BY key ORDER BY rank, doc_id) = 1),
c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank, doc_id) <= CASE label WHEN '0' THEN 30 ELSE 10 END)
"""


def _quarantine(spark, sf):
    rows = _rights_pending(spark, sf)
    return intake.quarantine(rows.drop("source"), rows.where("source = 'src0'"), QUARANTINE, exact=False)


@query(_QUARANTINE + "SELECT 'pending-review-' || substring(sha256(text), 1, 20) AS id, sha256(text) AS h, false AS open FROM c")
def quarantine_intake(spark, sf):
    return _quarantine(spark, sf)[0].select("id", F.sha2("text", 256).alias("h"), F.col("source.redistribution_allowed").alias("open"))


@query(_QUARANTINE + _measures({"source": "r", "not-excluded": "a", "not-sensitive": "s", "eligible": "e", "selected": "c"}, "label"))
def quarantine_intake_report(spark, sf):
    return _quarantine(spark, sf)[1]


@query("SELECT 'case-' || doc_id AS id, CASE r WHEN 0 THEN 'not-open-tuning' WHEN 1 THEN 'not-open-tuning' WHEN 2 THEN 'not-blind' END AS rule FROM (SELECT doc_id, doc_id % 6 AS r FROM documents) WHERE r < 3")
def composition_contract(spark, sf):
    i, m = F.col("doc_id"), F.col("doc_id") % 6
    source = F.struct(F.when(m == 0, "private").otherwise("curated").alias("kind"), F.lit(True).alias("redistribution_allowed"))
    hit = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("canonical_term")))
    c = table(spark, sf, "documents").select(
        F.concat(F.lit("case-"), i.cast("string")).alias("id"), F.when(m == 1, "regression").otherwise("tuning").alias("split"), source.alias("source"), F.when(m == 3, "positive").otherwise("review").alias("label"),
        F.when(m.isin(2, 3), hit).otherwise(F.array().cast(R.MATCHES)).alias("expected_matches"), F.array(F.lit("unadjudicated-intake")).alias("slices"),
    )
    return intake.composition_problems(c)


# ---- decisions with spans


def _spanned(spark, sf, other: int) -> DataFrame:
    """Decisions of one reviewer: spans of one character, another one longer for every `other`th case, slices in either order."""
    i = F.col("doc_id")
    end = F.when(i % other == 0, 2).otherwise(1)
    m = F.when(F.col("toxic") == 1, F.array(F.struct(F.lit(0).alias("start"), end.alias("end"), F.lit("x").alias("canonical_term")))).otherwise(F.array().cast(R.MATCHES))
    slices = F.array(F.lit("a"), F.lit("b")) if other > 5 else F.array(F.lit("b"), F.lit("a"))
    return table(spark, sf, "labels").select(i.alias("case_id"), F.lit("approved").alias("privacy_status"), F.when(F.col("toxic") == 1, "positive").otherwise("hard-negative").alias("label"), m.alias("matches"), slices.alias("slices"))


@query("SELECT doc_id AS case_id, CASE WHEN toxic = 1 AND (doc_id % 5 = 0) <> (doc_id % 7 = 0) THEN 'disagreement' ELSE 'consensus' END AS outcome, CASE WHEN outcome = 'consensus' AND toxic = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END END AS \"end\" FROM labels")
def annotation_merge_spans(spark, sf):
    return annotation.merge(_spanned(spark, sf, 5), _spanned(spark, sf, 7)).select("case_id", "outcome", F.get("matches", 0)["end"].alias("end"))


@query("SELECT doc_id AS case_id, CASE WHEN toxic = 1 AND (doc_id % 5 = 0) <> (doc_id % 7 = 0) THEN 'adjudicated' ELSE 'consensus' END AS outcome, CASE WHEN toxic = 1 THEN CASE WHEN outcome = 'adjudicated' THEN CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END END AS \"end\" FROM labels")
def adjudicate_spans(spark, sf):
    merged = annotation.merge(_spanned(spark, sf, 5), _spanned(spark, sf, 7))
    return annotation.adjudicate(merged, _spanned(spark, sf, 3)).select("case_id", "outcome", F.get("matches", 0)["end"].alias("end"))


@query("SELECT doc_id AS case_id, 'review' AS label, 0 AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND contains(text, 'the')")
def reaudit_blinded(spark, sf):
    """False positives of a rash detector come back blind, without the spans they had."""
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").withColumn("found", sieve("exact", lexicon=Lexicon.build(["the"])).contains("text"))
    wrong = d.where("found and toxic = 0").select(F.col("doc_id").alias("case_id"))
    hit = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("canonical_term")))
    c = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.lit("positive").alias("label"), hit.alias("matches"), F.array(F.lit("a")).alias("slices"))
    return annotation.reaudit_set(c, wrong).select("case_id", "label", F.size("matches").alias("n"))


_BATCH = [("repeated", "doc_id % 40 = 0 AND n = 1"), ("unknown", "doc_id % 9 = 0"), ("text", "doc_id % 9 <> 0 AND doc_id % 11 = 0"), ("status", "doc_id % 13 = 0"), ("positive-without-match", "toxic = 1"), ("span", "toxic = 0 AND doc_id % 2 = 0"), ("negative-with-match", "toxic = 0 AND doc_id % 2 = 0")]


@query("WITH b AS (SELECT *, 1 AS n FROM labels UNION ALL SELECT *, 2 FROM labels WHERE doc_id % 40 = 0) " + " UNION ALL ".join(f"SELECT doc_id AS case_id, '{r}' AS rule FROM b WHERE {w}" for r, w in _BATCH) + " UNION ALL SELECT NULL, 'too-long' WHERE (SELECT count(*) FROM b) > 20")
def batch_validation(spark, sf):
    i = F.col("doc_id")
    own = table(spark, sf, "labels")
    own = own.unionByName(own.where(i % 40 == 0))
    hit = F.array(F.struct(F.lit(0).alias("start"), F.lit(99).alias("end")))
    batch = own.select(i.alias("case_id"), F.when(i % 11 == 0, "other").otherwise("text").alias("text"), F.when(i % 13 == 0, "odd").otherwise("approved").alias("privacy_status"), F.when(F.col("toxic") == 1, "positive").otherwise("hard-negative").alias("label"), F.when((F.col("toxic") == 0) & (i % 2 == 0), hit).otherwise(F.array().cast(hit_type())).alias("matches"))
    cases = table(spark, sf, "labels").where(i % 9 != 0).select(i.alias("case_id"), F.lit("text").alias("text"))
    return annotation.batch_problems(batch, cases, 20)


def hit_type() -> str:
    return "array<struct<start:int,end:int>>"


@query("SELECT doc_id AS case_id FROM labels WHERE doc_id % 3 = 0 AND (doc_id % 9 = 0 OR doc_id % 2 = 0)")
def exclusion_validation(spark, sf):
    i = F.col("doc_id")
    cases = table(spark, sf, "labels").where(i % 9 != 0).select(i.alias("case_id"), F.lit("t").alias("text"), F.lit("tuning").alias("split"))
    out = table(spark, sf, "labels").where(i % 3 == 0).select(i.alias("case_id"), F.lit("t").alias("text"), F.when(i % 2 == 0, "evaluation").otherwise("tuning").alias("split"))
    return annotation.exclusion_problems(out, cases)


@query("SELECT doc_id AS case_id, 'a' AS split, CASE WHEN doc_id % 3 = 1 THEN 'b' END AS n_split FROM labels WHERE doc_id % 3 < 2")
def manifest_moved(spark, sf):
    i = F.col("doc_id")
    base = table(spark, sf, "labels").select(i.alias("case_id"), F.lit("c").alias("corpus_id"), F.lit("a").alias("split"))
    new = base.where(F.col("case_id") % 3 != 0).withColumn("split", F.when(F.col("case_id") % 3 == 1, "b").otherwise("a"))
    return splits.moved(base, new)


@query("SELECT 'case-' || (doc_id // 2) AS id, 'id-repeated' AS rule FROM labels GROUP BY 1 HAVING count(*) > 1")
def validate_repeated_ids(spark, sf):
    return validation.repeated_ids(table(spark, sf, "labels").select(F.concat(F.lit("case-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("id")))


@query("SELECT CASE doc_id % 5 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'regression' WHEN 2 THEN 'tuning' ELSE 'private' END AS split, toxic AS label, count(*) AS n FROM labels GROUP BY 1, 2")
def validate_summary(spark, sf):
    return validation.summary(table(spark, sf, "labels").select(split_of("doc_id").alias("split"), F.col("toxic").alias("label")))


# ---- provenance

_RULES = {
    "candidate-id": "k % 17 = 0", "surface": "k % 19 = 0", "representation": "k % 23 = 0", "classification": "k % 29 = 0", "source-unknown": "k % 31 = 0", "decision": "k % 37 = 0", "review-status": "k % 41 = 0",
    "evaluation_refs": "k % 43 = 0", "packaged-layer": "k % 2 = 0 AND k % 47 = 0", "packaged-classification": "k % 2 = 0 AND k % 29 = 0", "packaged-review": "k % 2 = 0 AND (k % 41 = 0)",
    "packaged-evaluation": "k % 2 = 0 AND k % 53 = 0 AND k % 43 <> 0", "packaged-canonical": "k % 2 = 0 AND k % 59 = 0 AND k % 23 <> 0", "packaged-license": "k % 2 = 0 AND k % 31 <> 0 AND k % 7 = 0", "packaged-redistribution": "k % 2 = 0 AND k % 31 <> 0 AND k % 5 = 0",
}


def _candidates(spark, sf) -> DataFrame:
    k = F.col("p_partkey")

    def odd(n, bad, good):
        return F.when(k % n == 0, bad).otherwise(good)

    term = F.concat(F.lit("term"), k.cast("string"))
    approved = odd(41, F.lit("unsure"), F.lit("approved"))
    review = F.struct(approved.alias("status"), odd(37, F.lit(None).cast("string"), F.lit("d1")).alias("decision_reference"))
    return table(spark, sf, "part").select(
        k, odd(17, F.concat(F.lit("Cand "), k.cast("string")), F.concat(F.lit("cand-"), k.cast("string"))).alias("candidate_id"), odd(19, F.lit(" "), term).alias("surface"), term.alias("normalized_surface"), term.alias("canonical"),
        odd(59, F.lit("nowhere"), F.lit("root")).alias("normalized_canonical"), odd(23, F.lit("picture"), F.when(k % 59 == 0, "alias").otherwise("literal")).alias("representation"), F.lit("exact").alias("matcher"),
        odd(47, F.lit("ai-candidate"), F.lit("core")).alias("target_layer"), odd(29, F.lit(None).cast("string"), F.lit("positive")).alias("classification"), F.when(k % 2 == 0, "packaged").otherwise("candidate").alias("status"),
        odd(31, F.lit("nobody"), F.concat(F.lit("s"), (k % 35).cast("string"))).alias("source_id"), F.when(k % 43 == 0, F.array(F.lit(""))).when(k % 53 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e1"))).alias("evaluation_refs"), review.alias("review"),
    )


def _sources(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(35).select(F.concat(F.lit("s"), i.cast("string")).alias("source_id"), F.lit("curated").alias("kind"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("reference"), F.lit("r").alias("revision"), F.lit("MIT").alias("license"), F.when(i % 7 == 0, "pending").otherwise("approved").alias("license_status"), (i % 5 != 0).alias("redistribution_allowed"))


_CANDIDATE_ID = "CASE WHEN k % 17 = 0 THEN 'Cand ' || k ELSE 'cand-' || k END"


def _provenance_sql() -> str:
    rules = dict(_RULES)
    rules["decision"] = "k % 37 = 0 AND k % 41 <> 0"
    rules["packaged-classification"] = "k % 2 = 0 AND k % 29 = 0"
    return "WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(f"SELECT {_CANDIDATE_ID} AS key, '{r}' AS rule FROM p WHERE {w}" for r, w in rules.items())


@query(_provenance_sql())
def provenance_rules(spark, sf):
    return provenance.candidate_problems(_candidates(spark, sf).drop("p_partkey"), _sources(spark))


@query("WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT 'S ' || k AS key, 'source-id' AS rule FROM s WHERE k % 3 = 0 UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'S ' ELSE 's' END || k, 'source-reference' FROM s WHERE k % 5 = 0 UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'S ' ELSE 's' END || k, 'source-license_status' FROM s WHERE k % 7 = 0")
def provenance_source_rules(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, "S ").otherwise("s"), k.cast("string"))
    own = table(spark, sf, "supplier").select(name.alias("source_id"), F.when(k % 5 == 0, "licensed").otherwise("curated").alias("kind"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("reference"), F.lit("r").alias("revision"), F.lit("MIT").alias("license"), F.when(k % 7 == 0, "lost").otherwise("approved").alias("license_status"), F.lit(True).alias("redistribution_allowed"))
    return provenance.source_problems(own)


_PACKAGED = "k % 2 = 0 AND k % 47 <> 0 AND k % 29 <> 0 AND k % 41 <> 0"


@query(f"WITH p AS (SELECT p_partkey AS k FROM part), a AS (SELECT 'term' || k AS surface FROM p WHERE {_PACKAGED} AND k % 23 <> 0 AND k % 59 <> 0), b AS (SELECT 'term' || k AS surface FROM p WHERE k % 4 = 0) SELECT coalesce(a.surface, b.surface) AS surface, CASE WHEN a.surface IS NULL THEN 'no-candidate' ELSE 'not-packaged' END AS issue FROM a FULL JOIN b ON a.surface = b.surface WHERE a.surface IS NULL OR b.surface IS NULL")
def provenance_reconcile(spark, sf):
    listed = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("term"), F.col("p_partkey").cast("string")).alias("term"))
    return provenance.reconcile(_candidates(spark, sf), listed)


@query(f"WITH p AS (SELECT p_partkey AS k FROM part) SELECT {_CANDIDATE_ID} AS candidate_id FROM p WHERE {_PACKAGED} AND k % 19 <> 0 AND k % 31 <> 0 AND k % 7 <> 0")
def provenance_selected(spark, sf):
    c = _candidates(spark, sf).where("p_partkey % 19 <> 0")
    return provenance.selected(c, _sources(spark)).select("candidate_id")


# ---- reports and generated cases


def _by_lang(spark, sf) -> DataFrame:
    d = documents(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").join(table(spark, sf, "labels"), "doc_id")
    d = d.select("lang", (F.col("toxic") == 1).alias("gold"), sieve("exact").contains("text").alias("found"))
    c = metrics.confusion(d, "gold", "found", "lang").withColumnRenamed("lang", "profile")
    return c.withColumns({"cases": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "positives": F.col("tp") + F.col("fn"), "negatives": F.col("fp") + F.col("tn")})


_BY_LANG = f"c AS (SELECT lang AS profile, count(*) FILTER (toxic = 1 AND f) AS tp, count(*) FILTER (toxic = 0 AND f) AS fp, count(*) FILTER (toxic = 1 AND NOT f) AS fn, count(*) FILTER (toxic = 0 AND NOT f) AS tn FROM (SELECT lang, toxic, regexp_matches(text, '{ANY}') AS f FROM documents JOIN labels USING (doc_id)) GROUP BY 1)"


@query(f"WITH {_BY_LANG}, b AS (SELECT * FROM c WHERE profile = 'en') SELECT c.profile, c.tp - b.tp AS d_tp, c.fp - b.fp AS d_fp, c.fn - b.fn AS d_fn, c.tn - b.tn AS d_tn FROM c, b")
def profile_deltas(spark, sf):
    return metrics.deltas(_by_lang(spark, sf), "en")


@query("SELECT unnest(['de', 'de', 'es', 'fr']) AS profile, unnest(['cases', 'positives', 'deltas', 'gate']) AS rule")
def report_consistency(spark, sf):
    """A report with one fault a profile: each is found, and nothing else."""
    m = _by_lang(spark, sf)
    m = metrics.gates(m).drop("gate_fp_rate").join(metrics.deltas(m, "en"), "profile").withColumns({"occurrence_tp": F.lit(3), "occurrence_fp": F.lit(1), "occurrence_fn": F.lit(2)})
    p = F.col("profile")
    m = m.withColumns({"cases": F.col("cases") + F.when(p == "de", 1).otherwise(0), "positives": F.col("positives") - F.when(p == "de", 1).otherwise(0), "d_tp": F.col("d_tp") + F.when(p == "es", 1).otherwise(0), "passed": F.col("passed") != (p == "fr")})
    return evaluation.report_problems(m, "en")


@query(f"WITH {_BY_LANG} SELECT profile FROM c WHERE profile <> 'de'")
def metric_consistency(spark, sf):
    m = metrics.rates(_by_lang(spark, sf)).withColumn("recall", F.when(F.col("profile") == "de", F.col("recall")).otherwise(F.lit(2.0)))
    return metrics.inconsistent(m).select("profile")


_PREDICTED = {"missing": "doc_id % 4 = 0", "repeated": "doc_id % 4 = 1", "flag": "doc_id % 4 = 2"}


@query(" UNION ALL ".join(f"SELECT doc_id AS case_id, '{r}' AS issue FROM documents WHERE {w}" for r, w in _PREDICTED.items()))
def prediction_validation(spark, sf):
    cases, m = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text"), F.col("case_id") % 4
    p = cases.where(m != 0).select("case_id", (m == 2).alias("detected"), F.array().cast("array<struct<start:int,end:int>>").alias("matches"))
    return metrics.prediction_problems(cases, p.unionByName(p.where(m == 1)))


_TERM_VALUES = ", ".join(f"('{t}')" for t in TERMS)


@query(f"SELECT term, 'say ' || term || '!' AS text FROM (VALUES {_TERM_VALUES}) t(term) UNION ALL SELECT term, term || ' ' || term FROM (VALUES {_TERM_VALUES}) t(term)")
def generated_from_templates(spark, sf):
    words = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return generation.from_templates(words, spark.createDataFrame([("say {surface}!",), ("{surface} {surface}",)], "template string")).select("term", "text")


_LETTERS = "array_to_string(string_split(n_name, ''), '{}')"


@query(f"SELECT n_name AS term, slice, CASE slice WHEN 'plain' THEN n_name WHEN 'separator' THEN {_LETTERS.format('*')} WHEN 'whitespace' THEN {_LETTERS.format('  ')} ELSE {_LETTERS.format(' * ')} END AS surface FROM nation, (VALUES ('plain'), ('separator'), ('whitespace'), ('mixed')) v(slice)")
def generated_variants(spark, sf):
    return generation.variants(table(spark, sf, "nation").select(F.col("n_name").alias("term")))


@query("SELECT DISTINCT 'blind-' || substring(sha256('r1' || chr(0) || text), 1, 20) AS id, sha256(text) AS h, 'review' AS label FROM documents")
def generated_blinded(spark, sf):
    return generation.blinded(table(spark, sf, "documents"), "blind-", "r1").select("id", F.sha2("text", 256).alias("h"), "label")


@query("SELECT count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)")
def generated_disjoint(spark, sf):
    d = table(spark, sf, "documents")
    return generation.common(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).agg(F.count("*").alias("n"))


@query("SELECT 'standard' AS shape, 'term' || lpad(i::VARCHAR, 8, '0') AS term FROM range(500) t(i) UNION ALL SELECT 'prefix', 'p' || repeat('x', (i + 1)::INTEGER) FROM range(200) t(i)")
def generated_dictionary(spark, sf):
    parts = [generation.synthetic_terms(spark, n, shape).withColumn("shape", F.lit(shape)) for shape, n in (("standard", 500), ("prefix", 200))]
    return reduce(DataFrame.unionByName, parts).select("shape", "term")


@query("SELECT count(*) AS n, count(DISTINCT lower(text)) AS keys FROM documents WHERE text <> ''")
def leak_key_counts(spark, sf):
    """Texts and their distinct lower-case forms; no two leak keys differ where those are equal."""
    d = table(spark, sf, "documents").where("text <> ''").select(F.sha2(F.lower("text"), 256).alias("low"), F.sha2(leak_key(F.col("text")), 256).alias("key"))
    per = d.groupBy("low").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
    return per.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))

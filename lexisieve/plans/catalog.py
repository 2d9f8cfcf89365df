"""Queries over the driver's tables with the DuckDB SQL that each has to agree with.

`@query(sql)` registers a callable (spark, sf_dir) -> DataFrame.  Korean and
obfuscated spellings don't occur in the tables, so such queries rewrite a word
on both sides and compare what is found with how often the word was there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisieve.functions import columns as K
from lexisieve.functions.columns import Sieve
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import profile
from lexisieve.operators import annotation, metrics, sampling, signals, splits, validation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ("trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting")
ANY = "(" + "|".join(TERMS) + ")"
WHOLE = 1 << 30  # whole texts, however long
OFF = {f"{m}_matching": False for m in ("exact", "alias", "choseong", "repeated", "separator", "whitespace_gap", "mixed_gap", "keyboard", "jamo_composition", "segmented_input", "fuzzy")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions for the CPU-bound kernel where the input has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sieve(*methods: str, lexicon: Lexicon | None = None, **changes) -> Sieve:
    on = OFF | {f"{m}_matching": True for m in methods}
    return Sieve(lexicon or Lexicon.build(TERMS), settings=profile("strict", **on, max_input_length=WHOLE, **changes))


EXACT = sieve("exact")

_SPANS = """
f AS (SELECT {id} AS id, string_split_regex(text, '{re}') AS g, regexp_extract_all(text, '{re}') AS h FROM {src}),
n AS (SELECT id, h, g, unnest(range(1, len(h) + 1)) AS i FROM f),
s AS (SELECT id, h[i] AS term, (list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0))::INTEGER AS a FROM n)
"""


def spans_sql(select: str, src: str = "documents", id_: str = "doc_id", re: str = ANY) -> str:
    """SQL over s(id, term, a): all occurrences of a regular expression and where they start."""
    return f"WITH {_SPANS.format(id=id_, src=src, re=re)} {select}"


# ---- detection


@query(spans_sql("SELECT id AS doc_id, term, a AS start, (a + length(term))::INTEGER AS \"end\", 'exact' AS method FROM s"))
def detect_exact_spans(spark, sf):
    return EXACT.spans(documents(spark, sf)).select("doc_id", "term", "start", "end", "method")


@query(f"SELECT doc_id, regexp_matches(text, '{ANY}') AS found FROM documents")
def contains_flag(spark, sf):
    return documents(spark, sf).select("doc_id", EXACT.contains("text").alias("found"))


@query(spans_sql("SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM s GROUP BY 1"))
def term_counts(spark, sf):
    return EXACT.spans(documents(spark, sf)).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def _mask_sql() -> str:
    out = "text"
    for t in TERMS:
        out = f"replace({out}, '{t}', repeat('*', {len(t)}))"
    return f"SELECT doc_id, sha256({out}) AS masked_sha256 FROM documents"


@query(_mask_sql())
def mask_text(spark, sf):
    return EXACT.mask(documents(spark, sf)).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g')) AS h, length(text) AS n FROM documents")
def normalize_whitespace(spark, sf):
    v = documents(spark, sf).select("doc_id", K.normalize("text").alias("v"))
    return v.select("doc_id", F.sha2("v.text", 256).alias("h"), F.coalesce(F.get("v.ends", F.size("v.ends") - 1), F.lit(0)).cast("long").alias("n"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g')) AS h FROM documents")
def normalize_whitespace_native(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(K.collapse_blanks(F.col("text")), 256).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 4096 THEN 'input_too_long' END AS error, length(text) <= 4096 AS done FROM documents")
def detect_error_rows(spark, sf):
    d = Sieve(Lexicon.build(TERMS), "strict").with_detection(documents(spark, sf))
    return d.select("doc_id", F.col("detection.error").alias("error"), F.col("detection.matches").isNotNull().alias("done"))


@query(spans_sql("SELECT documents.doc_id, n AS found FROM documents JOIN (SELECT doc_id, count(a) AS n FROM documents LEFT JOIN s ON id = doc_id AND (doc_id % 2 = 1 OR term <> 'clown') GROUP BY 1) c USING (doc_id)"))
def whitelist_protect(spark, sf):
    docs = documents(spark, sf).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("clown"), F.lit("clownfish"))).otherwise(F.col("text")))
    own = sieve("exact", lexicon=Lexicon.build(TERMS, ["clownfish"]))
    return docs.select("doc_id", own.matches("text").alias("m")).select("doc_id", F.size("m").cast("long").alias("found"))


def _found(spark, sf, old: str, new: str, own: Sieve, method: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    d = docs.select("doc_id", own.matches("text").alias("m"))
    return d.select("doc_id", F.size(F.filter("m", lambda m: m["method"] == method)).cast("long").alias("found"))


def _count_sql(word: str) -> str:
    return f"SELECT doc_id, (length(text) - length(replace(text, '{word}', ''))) // {len(word)} AS found FROM documents"


KOREAN = Lexicon.build(["바보", "밥보"])
LATIN = Lexicon.build(["idiot"], (), [("idjit", "idiot", "exact_token")])


@query(_count_sql("idiot"))
def separator_obfuscation(spark, sf):
    return _found(spark, sf, "idiot", "i*d!iot", sieve("separator", lexicon=LATIN), "separator")


@query(_count_sql(" idiot "))
def whitespace_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " id  iot ", sieve("whitespace_gap", lexicon=LATIN), "whitespace")


@query(_count_sql(" idiot "))
def mixed_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " id * iot ", sieve("mixed_gap", lexicon=LATIN), "mixed")


@query(_count_sql(" idiot "))
def repeated_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " 바아아보 ", sieve("repeated", lexicon=KOREAN), "repeated")


@query(_count_sql(" idiot "))
def keyboard_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " qkqh ", sieve("keyboard", lexicon=KOREAN), "keyboard")


@query(_count_sql(" idiot "))
def jamo_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " ㅂㅏㅂㅂㅗ ", sieve("jamo_composition", lexicon=KOREAN), "jamo")


@query(_count_sql(" idiot "))
def segmented_jamo_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", " ㅂㅏㅂ * ㅂㅗ ", sieve("jamo_composition", "segmented_input", lexicon=KOREAN), "jamo")


@query(_count_sql(" idiot "))
def segmented_choseong_obfuscation(spark, sf):
    return _found(spark, sf, " idiot ", ". ㅂ ㅂ ", sieve("choseong", "segmented_input", lexicon=KOREAN), "choseong")


@query(_count_sql(" idiot "))
def alias_tokens(spark, sf):
    return _found(spark, sf, " idiot ", " idjit ", sieve("alias", lexicon=LATIN), "alias")


@query(_count_sql(" idiot "))
def choseong_tokens(spark, sf):
    return _found(spark, sf, " idiot ", " ㅂㅂ이 ", sieve("choseong", lexicon=KOREAN), "choseong")


@query(_count_sql(" idiot "))
def fuzzy_detect(spark, sf):
    return _found(spark, sf, " idiot ", " idi0t ", sieve("fuzzy", lexicon=LATIN, fuzzy_max_operations=WHOLE), "levenshtein")


@query(spans_sql("SELECT conv_id, turn, term, a AS start FROM conversations JOIN s ON id = conv_id * 1000 + turn", src="(SELECT conv_id * 1000 + turn AS k, text FROM conversations)", id_="k", re="(anthe|eaule)"))
def conversation_spans(spark, sf):
    return sieve("exact", lexicon=Lexicon.build(["anthe", "eaule"])).spans(spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))).select("conv_id", "turn", "term", "start")


# ---- native fuzzy join and lexicon operators


def tokens(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))


_TERM_ROWS = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") terms(term)"


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TERMS], "term string")


@query(f"SELECT token, term FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM documents), {_TERM_ROWS} WHERE abs(length(token) - length(term)) <= 1 AND levenshtein(token, term) = 1")
def fuzzy_tokens(spark, sf):
    return K.fuzzy_tokens(tokens(table(spark, sf, "documents")), terms(spark))


@query(f"SELECT term, term AS signature FROM {_TERM_ROWS} UNION SELECT term, substring(term, 1, i - 1) || substring(term, i + 1) FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM {_TERM_ROWS})")
def deletion_index(spark, sf):
    return terms(spark).select("term", F.explode(K.deletion_signatures(F.col("term"))).alias("signature"))


@query("SELECT token, row_number() OVER (ORDER BY length(token) DESC, token) AS position FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS token FROM documents)")
def ordered_lexicon(spark, sf):
    from lexisieve.sources.readers import term_positions

    return term_positions(tokens(table(spark, sf, "documents")).distinct().withColumnRenamed("token", "term")).select(F.col("term").alias("token"), "position")


# ---- de-duplication and sampling


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS identity FROM documents GROUP BY text")
def dedupe_exact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", sampling.identity(F.col("text")).alias("identity"))
    return sampling.keep_first(docs, F.col("identity"), F.col("doc_id"))


_RANK = "sha256('corpus' || chr(0) || 'r1' || chr(0) || lang || chr(0) || sha256(text))"


def ranked(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("identity", sampling.identity(F.col("text")))
    return docs.select("doc_id", "lang", "source", "identity", sampling.stable_rank("corpus", "r1", F.col("lang"), F.col("identity")).alias("rank"))


@query(f"SELECT doc_id, {_RANK} AS rank FROM documents ORDER BY rank, doc_id LIMIT 100")
def stable_topk(spark, sf):
    return sampling.top_k(ranked(spark, sf), 100, F.col("rank"), F.col("doc_id")).select("doc_id", "rank")


_QUOTAS = {"en": 40, "de": 20, "fr": 10}


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}, doc_id) AS n FROM documents) WHERE n <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END")
def stratified_topk(spark, sf):
    return sampling.top_k_per_label(ranked(spark, sf), _QUOTAS, "lang", F.col("rank"), F.col("doc_id")).select("doc_id", "lang")


_D, _W = "(^|[^0-9])", "[0-9A-Za-z_]"
_SENSITIVE_SQL = (
    r"(?i)(https?://|www\.|(^|[^0-9a-z_.%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}([^0-9a-z_]|$)"
    rf"|{_D}01[016789][ -]?[0-9]{{3,4}}[ -]?[0-9]{{4}}([^0-9]|$)|{_D}[0-9]{{6}}[ -]?[0-9]{{7}}([^0-9]|$)"
    rf"|{_D}([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}([^0-9]|$)|{_D}[0-9]{{6,}}([^0-9]|$)|(^|[^0-9a-z_])@[a-z0-9_]{{2,}})"
)


@query(f"SELECT doc_id, regexp_matches(text, '{_SENSITIVE_SQL}') AS sensitive FROM documents")
def sensitive_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", signals.is_sensitive(F.col("text")).alias("sensitive"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS key, min(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY text HAVING min(toxic) = max(toxic)")
def conflict_dedupe(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", sampling.identity(F.col("text")).alias("key"), "toxic")
    return sampling.conflict_free(docs, "key", "toxic", F.col("doc_id")).select("doc_id", "key", "toxic")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = 'src0' AND x.text = d.text)")
def exclusion_antijoin(spark, sf):
    docs = ranked(spark, sf)
    return sampling.without(docs, docs.where("source = 'src0'"), "identity").select("doc_id")


@query("SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE source = 'src0' INTERSECT SELECT text FROM documents WHERE source <> 'src0')")
def exclusion_overlap(spark, sf):
    docs = ranked(spark, sf)
    return sampling.overlap(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "identity").agg(F.count("*").alias("shared"))


_FIRST = f"row_number() OVER (PARTITION BY text ORDER BY {_RANK}, doc_id) = 1"
_COMPOSE = f"""
r AS (SELECT doc_id, text, source, {_RANK} AS rank FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS k FROM r WHERE source = 'src1'{{x}}),
a AS (SELECT * FROM a0 WHERE k = 1 ORDER BY rank, doc_id LIMIT 10),
b0 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, doc_id) AS k FROM r WHERE source = 'src2'{{x}}),
b AS (SELECT * FROM b0 WHERE k = 1 AND text NOT IN (SELECT text FROM a) ORDER BY rank, doc_id LIMIT 10)
SELECT doc_id, source AS source_id, 'review-' || substring(sha256('pick' || chr(0) || source || chr(0) || doc_id), 1, 24) AS case_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
"""


def _with_case(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source_id", sampling.opaque_id("review-", F.lit("pick"), F.col("source_id"), F.col("doc_id")).alias("case_id"))


@query("WITH " + _COMPOSE.format(x=""))
def compose_quota(spark, sf):
    r = ranked(spark, sf)
    return _with_case(sampling.compose([(s, r.where(F.col("source") == s), 10) for s in ("src1", "src2")], "identity", F.col("rank"), F.col("doc_id"), exact=False))


@query("WITH old AS (SELECT text FROM documents WHERE source IN ('src3', 'src4')), " + _COMPOSE.format(x=" AND text NOT IN (SELECT text FROM old)"))
def review_buffer(spark, sf):
    r = ranked(spark, sf)
    old = r.where(F.col("source").isin("src3", "src4"))
    return _with_case(sampling.review_buffer([(s, r.where(F.col("source") == s), 10) for s in ("src1", "src2")], old, "identity", F.col("rank"), F.col("doc_id"), exact=False))


@query("SELECT source, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY source")
def source_share(spark, sf):
    return sampling.source_shares(table(spark, sf, "documents"), "source")


@query(f"SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source)::INTEGER AS position FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, doc_id)::INTEGER AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def round_robin_queue(spark, sf):
    return sampling.round_robin(ranked(spark, sf), "source", F.col("rank"), F.col("doc_id"), limit=100).select("doc_id", "source", "turn", "position")


_TRIPLE = "len(list_filter(range(1, length(text) - 1), lambda i: text[i] = text[i + 1] AND text[i] = text[i + 2] AND text[i] <> chr(10))) > 0"
_SIGNALS = {
    "ascii-token": "regexp_matches(text, '[A-Za-z]{3,}')",
    "repeated-character": _TRIPLE,
    "quoted-marker": "regexp_matches(text, '[\"''“”‘’「」『』]')",
    "username-marker": "regexp_matches(text, '[@#][^\\s]{2,}')",
}
_WEIGHT = {"ascii-token": 90, "repeated-character": 50, "quoted-marker": 40, "username-marker": 35}


@query(f"SELECT doc_id, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in _SIGNALS.items())}) AS signals, ({' + '.join(f'CASE WHEN {c} THEN {_WEIGHT[n]} ELSE 0 END' for n, c in _SIGNALS.items())})::INTEGER AS priority FROM documents")
def surface_signals(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", signals.surface_signals(F.col("text")).alias("s"))
    return docs.select("doc_id", F.array_join("s", ",").alias("signals"), signals.surface_priority(F.col("s")).alias("priority"))


# ---- splits and leakage

_SPLIT_SQL = "CASE doc_id % 5 WHEN 0 THEN 'evaluation' WHEN 1 THEN 'regression' WHEN 2 THEN 'tuning' ELSE 'private' END"


def split_of(key: str) -> Column:
    m = F.col(key) % 5
    return F.when(m == 0, "evaluation").when(m == 1, "regression").when(m == 2, "tuning").otherwise("private")


def cases(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", split_of("doc_id").alias("split"))


_PAIRS = f"""
WITH c AS (SELECT doc_id, text, {_SPLIT_SQL} AS split FROM documents)
SELECT a.doc_id AS visible_id, b.doc_id AS hidden_id FROM c a JOIN c b ON a.text = b.text AND a.split IN ('regression', 'tuning') AND b.split = 'evaluation'
"""


@query(_PAIRS)
def direct_leaks(spark, sf):
    return splits.direct_leaks(cases(spark, sf))


@query(f"WITH c AS (SELECT text, {_SPLIT_SQL} AS split FROM documents) SELECT sha256(text) AS h, count(*) FILTER (split IN ('regression', 'tuning')) AS visible, count(*) FILTER (split = 'evaluation') AS hidden FROM c GROUP BY text HAVING visible > 0 AND hidden > 0")
def leak_classes(spark, sf):
    return splits.leak_classes(cases(spark, sf), "text")


@query(_PAIRS)
def normalized_leaks(spark, sf):
    # hidden texts in other clothes: nothing is equal any more, all of it still leaks
    c = cases(spark, sf).withColumn("text", F.when(F.col("split") == "evaluation", F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" !?"))).otherwise(F.col("text")))
    return splits.normalized_leaks(c.withColumn("key", K.leak_key(F.col("text"))), "text", "key")


_LEAK_KEY = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{Z}\p{Cf}]', '', 'g')"


@query(f"WITH k AS (SELECT doc_id, string_split({_LEAK_KEY}, '') AS c FROM documents) SELECT doc_id, sha256(array_to_string(list_filter(c, lambda x, i: i = 1 OR c[i - 1] <> x), '')) AS h FROM k")
def leak_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(K.leak_key(F.col("text")), 256).alias("h"))


@query(ORACLES["leak_normalize"])
def leak_normalize_full(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(K.leak_key_full("text"), 256).alias("h"))


def manifest(spark, sf, shift: int) -> DataFrame:
    """Assignments of all documents but every eleventh; those of every seventh are shifted to another split."""
    docs = table(spark, sf, "documents").where(F.col("doc_id") % 11 != shift)
    moved = F.when(F.col("doc_id") % 7 == shift, F.lit("tuning")).otherwise(split_of("doc_id"))
    return docs.select(F.col("doc_id").alias("case_id"), F.col("source").alias("corpus_id"), moved.alias("split"))


def _manifest_sql(shift: int) -> str:
    return f"(SELECT doc_id AS case_id, source AS corpus_id, CASE WHEN doc_id % 7 = {shift} THEN 'tuning' ELSE {_SPLIT_SQL} END AS split FROM documents WHERE doc_id % 11 <> {shift})"


@query(f"""
SELECT coalesce(m.case_id, c.case_id) AS case_id, CASE WHEN c.split IS NULL THEN 'missing-from-corpus' WHEN m.split IS NULL THEN 'missing-from-manifest' WHEN m.corpus_id <> c.corpus_id THEN 'corpus-differs' WHEN m.split <> c.split THEN 'split-differs' END AS issue
FROM {_manifest_sql(0)} m FULL OUTER JOIN {_manifest_sql(1)} c ON m.case_id = c.case_id WHERE issue IS NOT NULL
""")
def manifest_reconcile(spark, sf):
    return splits.reconcile(manifest(spark, sf, 0), manifest(spark, sf, 1))


@query(f"SELECT *, 'old' AS side FROM ({_manifest_sql(0)} EXCEPT ALL {_manifest_sql(1)}) UNION ALL SELECT *, 'new' FROM ({_manifest_sql(1)} EXCEPT ALL {_manifest_sql(0)})")
def manifest_change(spark, sf):
    return splits.changes(manifest(spark, sf, 0), manifest(spark, sf, 1))


@query(f"SELECT * FROM {_manifest_sql(0)} UNION ALL SELECT * FROM {_manifest_sql(1)} n WHERE case_id NOT IN (SELECT case_id FROM {_manifest_sql(0)})")
def manifest_build(spark, sf):
    return splits.build_manifest(manifest(spark, sf, 0), manifest(spark, sf, 1))


# ---- validation

_HIT = "strpos(text, 'the')"


def marked(spark, sf) -> DataFrame:
    """Cases whose second span overlaps the first, runs backwards or leaves the text, by the remainder of the id."""
    docs = table(spark, sf, "documents")
    a = F.greatest(F.instr("text", "the"), F.lit(1)) - 1
    one = F.struct(a.alias("start"), (a + 3).alias("end"), F.lit("the").alias("canonical_term"))
    r = F.col("doc_id") % 4
    s = F.when(r == 0, a + 2).when(r == 1, a - 1).when(r == 2, F.length("text") - 1).otherwise(a + 3)
    two = F.struct(s.alias("start"), (s + 2).alias("end"), F.lit("x").alias("canonical_term"))
    return docs.select(F.col("doc_id").alias("id"), "text", F.array(one, two).alias("expected_matches"))


@query(f"""
WITH d AS (SELECT doc_id AS id, length(text) AS n, greatest({_HIT}, 1) - 1 AS a, doc_id % 4 AS r FROM documents),
e AS (SELECT id, n, a, CASE r WHEN 0 THEN a + 2 WHEN 1 THEN a - 1 WHEN 2 THEN n - 1 ELSE a + 3 END AS s FROM d)
SELECT id, 0 AS pos, 'span-range' AS rule FROM e WHERE a + 3 > n
UNION ALL SELECT id, 1, 'span-range' FROM e WHERE s < 0 OR s + 2 > n
UNION ALL SELECT id, 1, 'span-order' FROM e WHERE s < a
UNION ALL SELECT id, 1, 'span-overlap' FROM e WHERE s < a + 3
""")
def validate_spans(spark, sf):
    return validation.span_problems(marked(spark, sf))


_VALID = """
WITH d AS (SELECT doc_id, text, lang, toxic, CASE WHEN toxic = 1 THEN 'positive' ELSE 'hard-negative' END AS label, (length(text) % 3 = 0) AS hit FROM documents JOIN labels USING (doc_id))
SELECT 'case-' || doc_id AS id, 'positive-without-match' AS rule FROM d WHERE label = 'positive' AND NOT hit
UNION ALL SELECT 'case-' || doc_id, 'negative-with-match' FROM d WHERE label = 'hard-negative' AND hit
UNION ALL SELECT 'case-' || doc_id, 'slices-unknown' FROM d WHERE lang = 'fr'
UNION ALL SELECT 'case-' || doc_id, 'slices-repeated' FROM d WHERE doc_id % 6 = 0
UNION ALL SELECT 'case-' || doc_id, 'licensed-reference' FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT 'case-' || doc_id, 'private-split' FROM d WHERE doc_id % 5 >= 3
"""


@query(_VALID)
def validate_cases(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    none = F.array().cast("array<struct<start:int,end:int,canonical_term:string>>")
    hit = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("canonical_term")))
    src = F.struct(F.when(F.col("doc_id") % 2 == 0, "licensed").otherwise("curated").alias("kind"), F.col("source").alias("name"), F.lit(None).cast("string").alias("reference"), F.lit("r1").alias("revision"), F.lit(True).alias("redistribution_allowed"))
    c = d.select(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("id"), "text", F.when(F.col("toxic") == 1, "positive").otherwise("hard-negative").alias("label"),
        F.when(F.length("text") % 3 == 0, hit).otherwise(none).alias("expected_matches"),
        F.when(F.col("doc_id") % 6 == 0, F.array("lang", "lang")).otherwise(F.array("lang")).alias("slices"), src.alias("source"), F.lit("MIT").alias("license"), split_of("doc_id").alias("split"),
    )
    return validation.validate(c, ["en", "de", "es"])


# ---- annotation

_SIDE = "(SELECT doc_id AS case_id, CASE WHEN doc_id % {a} = 0 THEN 'exclude' WHEN doc_id % {b} = 0 THEN 'pending' ELSE 'approved' END AS status, CASE WHEN (toxic = 1) <> (doc_id % {c} = 0) THEN 'positive' ELSE 'hard-negative' END AS label, quality FROM labels)"
_ONE, _TWO, _THREE = (dict(a=a, b=b, c=c) for a, b, c in ((17, 13, 1009), (19, 23, 5), (29, 7, 3)))
_MERGED = f"""
SELECT p.case_id, CASE WHEN p.status = 'exclude' OR s.status = 'exclude' THEN 'exclude' WHEN p.status = 'pending' OR s.status = 'pending' THEN 'pending' WHEN p.label <> s.label THEN 'disagreement' ELSE 'consensus' END AS outcome, CASE WHEN outcome = 'consensus' THEN p.label END AS label
FROM {_SIDE.format(**_ONE)} p JOIN {_SIDE.format(**_TWO)} s ON p.case_id = s.case_id
"""


def side(spark, sf, a: int, b: int, c: int) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % a == 0, "exclude").when(i % b == 0, "pending").otherwise("approved")
    label = F.when((F.col("toxic") == 1) != (i % c == 0), "positive").otherwise("hard-negative")
    # the same slices in another order on either side
    slices = F.when(F.lit(a) > 18, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    matches = F.array().cast("array<struct<start:int,end:int,canonical_term:string>>")
    return table(spark, sf, "labels").select(i.alias("case_id"), status.alias("privacy_status"), label.alias("label"), matches.alias("matches"), slices.alias("slices"))


@query("SELECT doc_id FROM labels ORDER BY doc_id LIMIT 50 OFFSET 20")
def batch_page(spark, sf):
    return annotation.page(table(spark, sf, "labels"), "doc_id", 20, 50).select("doc_id")


@query(_MERGED)
def annotation_merge(spark, sf):
    return annotation.merge(side(spark, sf, **_ONE), side(spark, sf, **_TWO)).select("case_id", "outcome", "label")


_ADJUDICATED = f"""
SELECT m.case_id, CASE WHEN m.outcome <> 'disagreement' THEN m.outcome WHEN t.status = 'approved' THEN 'adjudicated' WHEN t.status = 'exclude' THEN 'exclude' ELSE 'unresolved' END AS outcome,
       CASE WHEN m.outcome = 'disagreement' AND t.status = 'approved' THEN t.label ELSE m.label END AS label
FROM ({_MERGED}) m LEFT JOIN {_SIDE.format(**_THREE)} t ON m.case_id = t.case_id
"""


def _adjudicated(spark, sf) -> DataFrame:
    return annotation.adjudicate(annotation.merge(side(spark, sf, **_ONE), side(spark, sf, **_TWO)), side(spark, sf, **_THREE))


@query(_ADJUDICATED)
def adjudicate(spark, sf):
    return _adjudicated(spark, sf).select("case_id", "outcome", "label")


@query(f"SELECT l.doc_id AS case_id, CASE WHEN a.outcome IN ('consensus', 'adjudicated') THEN a.label ELSE 'review' END AS label FROM labels l LEFT JOIN ({_ADJUDICATED}) a ON l.doc_id = a.case_id")
def apply_decisions(spark, sf):
    base = side(spark, sf, **_ONE).withColumn("label", F.lit("review"))
    return annotation.apply_decisions(base, _adjudicated(spark, sf)).select("case_id", "label")


@query(f"SELECT p.label AS before, s.label AS after, count(*) AS n FROM {_SIDE.format(**_ONE)} p JOIN {_SIDE.format(**_TWO)} s ON p.case_id = s.case_id WHERE s.status = 'approved' GROUP BY 1, 2")
def reaudit_transitions(spark, sf):
    audited = side(spark, sf, **_TWO).where("privacy_status = 'approved'")
    return annotation.reaudit_apply(side(spark, sf, **_ONE), audited, ("label", "matches", "slices"))[1]


@query(f"SELECT p.case_id, coalesce(s.label, p.label) AS label FROM {_SIDE.format(**_ONE)} p LEFT JOIN (SELECT * FROM {_SIDE.format(**_TWO)} WHERE status = 'approved') s ON p.case_id = s.case_id")
def reaudit_apply(spark, sf):
    audited = side(spark, sf, **_TWO).where("privacy_status = 'approved'")
    return annotation.reaudit_apply(side(spark, sf, **_ONE), audited, ("label", "matches", "slices"))[0].select("case_id", "label")


@query(f"WITH g AS (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND regexp_matches(text, '{ANY}')) SELECT doc_id AS case_id, 'review' AS label FROM g")
def reaudit_false_positives(spark, sf):
    d = judged(spark, sf).select(F.col("doc_id").alias("case_id"), "gold", "found")
    c = d.select("case_id", F.lit("positive").alias("label"))
    return annotation.reaudit_set(c, d.where("found and not gold"))


# ---- metrics


def judged(spark, sf) -> DataFrame:
    """Labelled documents with gold (toxic) and found (any term)."""
    docs = spread(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "lang", "source", "toxic"))
    return docs.select("doc_id", "lang", "source", (F.col("toxic") == 1).alias("gold"), EXACT.contains("text").alias("found"))


_JUDGED = f"j AS (SELECT doc_id, lang, source, toxic = 1 AS gold, regexp_matches(text, '{ANY}') AS found FROM documents JOIN labels USING (doc_id))"
_COUNTS = "count(*) FILTER (gold AND found) AS tp, count(*) FILTER (found AND NOT gold) AS fp, count(*) FILTER (gold AND NOT found) AS fn, count(*) FILTER (NOT gold AND NOT found) AS tn"


@query(f"WITH {_JUDGED}, c AS (SELECT {_COUNTS} FROM j) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM c")
def sentence_confusion(spark, sf):
    return metrics.rates(metrics.confusion(judged(spark, sf), "gold", "found"))


@query(f"WITH {_JUDGED}, e AS (SELECT *, unnest([lang, source]) AS slice FROM j) SELECT slice, {_COUNTS} FROM e GROUP BY 1")
def slice_metrics(spark, sf):
    return metrics.slice_metrics(judged(spark, sf).withColumn("slices", F.array("lang", "source")), "gold", "found", "slices")


@query(f"WITH {_JUDGED} SELECT lang, count(*) AS cases, {_COUNTS} FROM j GROUP BY ROLLUP (lang)")
def slice_totals_rollup(spark, sf):
    return metrics.totals(judged(spark, sf), "gold", "found", "lang")


@query(f"WITH {_JUDGED}, c AS (SELECT lang AS profile, {_COUNTS} FROM j GROUP BY 1) SELECT *, coalesce(fp / nullif(fp + tn, 0), 0) AS fp_rate, fp_rate <= 0.005 AS gate_fp_rate, gate_fp_rate AS passed FROM c")
def profile_gates(spark, sf):
    return metrics.gates(metrics.confusion(judged(spark, sf), "gold", "found", "lang").withColumnRenamed("lang", "profile"))


PROFILES = {"baseline": TERMS[:4], "left": TERMS[:7], "right": TERMS[:4] + TERMS[7:], "all": TERMS}


def occurrences(spark, sf, words=TERMS) -> DataFrame:
    return sieve("exact", lexicon=Lexicon.build(words)).spans(documents(spark, sf)).select(F.col("doc_id").alias("case_id"), "start", "end", "term")


_GOLD = spans_sql("", re="(" + "|".join(TERMS[:6]) + ")").rstrip() + ", o AS (SELECT id AS case_id, term, a FROM s)"


@query(spans_sql(f"SELECT count(*) FILTER (term IN {TERMS[:6]}) AS tp, count(*) FILTER (term NOT IN {TERMS[:6]}) AS fp, 0::BIGINT AS fn FROM s"))
def occurrence_set_metrics(spark, sf):
    return metrics.set_occurrences(occurrences(spark, sf, TERMS[:6]), occurrences(spark, sf))


@query(spans_sql(f"SELECT sum(least(g, f))::BIGINT AS tp, sum(f - least(g, f))::BIGINT AS fp, sum(g - least(g, f))::BIGINT AS fn FROM (SELECT id, term, count(*) FILTER (term IN {TERMS[:6]}) AS g, count(*) FILTER (term NOT IN {TERMS[:2]}) AS f FROM s GROUP BY 1, 2)"))
def occurrence_multiset_metrics(spark, sf):
    return metrics.multiset_occurrences(occurrences(spark, sf, TERMS[:6]), occurrences(spark, sf, TERMS[2:]), ("case_id", "term"))


def predictions(spark, sf) -> DataFrame:
    every = occurrences(spark, sf)
    by = F.array_compact(F.array(*[F.when(F.col("term").isin(*words), F.lit(p)) for p, words in PROFILES.items()]))
    return every.withColumn("profile", F.explode(by))


def _in(words) -> str:
    return f"term IN ({', '.join(repr(w) for w in words)})"


def _ablation_sql() -> str:
    right, base = _in(TERMS[2:9]), _in(PROFILES["baseline"])
    parts = []
    for p in ("left", "right", "all"):
        own = _in(PROFILES[p])
        others = " + ".join(f"({_in(PROFILES[o])})::INT" for o in ("left", "right"))
        parts.append(f"SELECT '{p}' AS profile, count(*) FILTER ({own} AND NOT {base} AND {right}) AS added_tp, count(*) FILTER ({own} AND NOT {base} AND NOT {right}) AS added_fp, count(*) FILTER (NOT {own} AND {base} AND {right}) AS removed_tp, count(*) FILTER (NOT {own} AND {base} AND NOT {right}) AS removed_fp, count(*) FILTER ({own} AND NOT {base} AND {right} AND ({others}) = 1) AS unique_tp, count(*) FILTER ({right} AND NOT {own}) AS fn FROM s")
    return spans_sql(" UNION ALL ".join(parts))


@query(_ablation_sql())
def ablation_contribution(spark, sf):
    return metrics.ablation(predictions(spark, sf), occurrences(spark, sf, TERMS[2:9]), "baseline", "all")


@query(spans_sql(f"SELECT documents.doc_id AS case_id, r AS results FROM documents LEFT JOIN (SELECT id, concat_ws(',', CASE WHEN count(*) > 0 THEN 'all:' || count(*) END, CASE WHEN count(*) FILTER ({_in(PROFILES['baseline'])}) > 0 THEN 'baseline:' || count(*) FILTER ({_in(PROFILES['baseline'])}) END, CASE WHEN count(*) FILTER ({_in(PROFILES['left'])}) > 0 THEN 'left:' || count(*) FILTER ({_in(PROFILES['left'])}) END, CASE WHEN count(*) FILTER ({_in(PROFILES['right'])}) > 0 THEN 'right:' || count(*) FILTER ({_in(PROFILES['right'])}) END) AS r FROM s GROUP BY id) x ON doc_id = id").replace("r AS results", "coalesce(r, '') AS results"))
def case_results(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    r = metrics.case_results(predictions(spark, sf), c)
    return r.select("case_id", F.array_join(F.transform("results", lambda x: F.concat_ws(":", x["profile"], x["n"].cast("string"))), ",").alias("results"))


@query("SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY 1")
def nearest_rank_percentiles(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "documents"), "n_chars", {"p50": 0.5, "p95": 0.95}, "lang").select("lang", F.col("p50").cast("long"), F.col("p95").cast("long"))


@query(f"SELECT term, count(*) FILTER (toxic = 1) AS support, count(*) FILTER (toxic = 0) AS harm FROM documents JOIN labels USING (doc_id) JOIN {_TERM_ROWS} ON contains(text, term) GROUP BY 1")
def candidate_support(spark, sf):
    docs = spread(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "toxic"))
    hits = EXACT.spans(docs).select("doc_id", "toxic", "term").distinct()
    return hits.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("support"), F.count_if(F.col("toxic") == 0).alias("harm"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_theta_join(spark, sf):
    """Which passages a document contains: an equi-join on the passage's first five words, then the test itself."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"), first.alias("head"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.withColumn("w", F.split("text", " "))
    # a passage can start inside a word, after a line break or a sign: the head without its first word is the key
    tail = F.array_join(F.slice(F.split("passage", " "), 2, 3), " ")
    rest = [F.slice("w", F.lit(k), F.greatest(F.size("w") - k + 1, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)]
    grams = F.array_distinct(F.transform(F.arrays_zip(*rest), lambda x: F.concat_ws(" ", x["w1"], x["w2"], x["w3"])))
    long_items = items.where(F.size(F.split("passage", " ")) >= 5)
    near = docs.select("doc_id", F.explode(grams).alias("key")).join(long_items.select("item_id", tail.alias("key")), "key").select("doc_id", "item_id").distinct()
    full = near.join(docs.drop("w"), "doc_id").join(items, "item_id").where(F.contains("text", "passage"))
    # every passage, however many: Spark broadcasts them only where they are few
    short = docs.drop("w").join(items.where(F.size(F.split("passage", " ")) < 5), F.contains("text", "passage"))
    return full.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id"))

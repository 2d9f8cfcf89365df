"""One query per operator, each over its whole table, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisieve.llm import ann, bpe, langid, lm, minhash, neardup, packing, secrets, substring, urlfilter

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    scored = lm.score(docs.withColumn("learn", ~F.col("held_out")), "learn")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.default_ranks()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).drop("text"), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["ord"] < len(secrets.BASE))
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("secrets")).alias("spans"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.learn(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), k=3, percent=85, bands=32, rows=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_ann": op2_ann,
        "op3_url_filter": op3_url_filter,
        "op4_bpe": op4_bpe,
        "op5_secrets": op5_secrets,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_packing": op7_packing,
        "op8_embedding_neardup": op8_embedding_neardup,
        "op9_language_id": op9_language_id,
        "op10_minhash": op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secrets": _secrets_sql(),
        "op6_substring_dedup": _SUBSTRING_SQL,
        "op8_embedding_neardup": _NEARDUP_SQL,
        "op10_minhash": _MINHASH_SQL,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM rep),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.p) AS t, count(*) AS n
         FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_MINHASH_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 85 * (len(a.g) + len(b.g) - n)),
reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY 1) r ON s.doc_id = r.u
"""

_NEARDUP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY 1) l ON v.vec_id = l.u
LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY 1) r ON v.vec_id = r.u
"""


def _secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.BASE + secrets.ADDED):
        p = r.pattern
        if p.startswith("(?i)"):  # RE2 would fold other alphabets too
            words, rest = p[4:].split(")", 1)
            p = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest
        p = p.replace("'", "''")
        parts.append(f"SELECT doc_id, '{r.kind}' AS kind, {i} AS o, {r.least} AS least, string_split_regex(x, '{p}') AS g, regexp_extract_all(x, '{p}', 0) AS h, regexp_extract_all(x, '{p}', {r.group}) AS q FROM t")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
f AS ({" UNION ALL ".join(parts)}),
n AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM f),
s AS (SELECT doc_id, kind, o, (list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda v: length(v))), 0))::BIGINT AS a, length(h[i]) AS size
      FROM n WHERE length(q[i]) >= least),
p AS (SELECT *, kind || ':' || a || ':' || (a + size) AS span FROM s)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, o) FILTER (o < {len(secrets.BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, o), '') AS spans
FROM t LEFT JOIN p ON t.doc_id = p.doc_id GROUP BY t.doc_id
"""

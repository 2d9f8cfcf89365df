"""URL filter: rules on host and path, and a logistic regression for the rest.

Features are hashed character n-grams of host and path.  The small labelled
table (at most MAX_LABELLED rows, a parameter) is featurised with the same
DataFrame expressions that score; its counts are collected to fit the weights.
Scoring is DataFrame functions only: the weights are an array literal.

A rule fits its host and all subdomains if the path starts with the rule's;
the longest rule that fits wins, the smaller text among equally long ones.

Defined results: a null url or one without `://` has an empty host and path,
which no rule fits, and is judged by the bias alone; repeated rows have equal
results; extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
NGRAMS = (3, 4, 5)
MAX_LABELLED = 5000
EPOCHS, RATE, PENALTY = 40, 0.5, 1e-4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


RULES = (rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, block boolean) of invented addresses."""
    good = product(("docs", "news", "library", "science", "museum", "health", "research", "weather"), ("article", "guide", "en/2019", "wiki", "report"), ("net", "org", "com"))
    bad = product(("casino", "adult", "pills", "cheap-loans", "torrents", "poker", "ads", "winbonus"), ("click", "bonus", "free", "download", "track"), ("net", "biz", "com"))
    rows = [(f"https://{w}.example-{i % 7}.{tld}/{p}/{i}", False) for i, (w, p, tld) in enumerate(good)]
    rows += [(f"http://{w}{i % 9}.{tld}/{p}.php?id={i}", True) for i, (w, p, tld) in enumerate(bad)]
    return spark.createDataFrame(rows, "url string, block boolean")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    u = F.col(url).cast("string")
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def buckets() -> Column:
    """array<int>: the bucket of each character n-gram of host and path."""
    chars = F.regexp_extract_all(F.concat(F.lit("^"), F.col("host"), F.lit("|"), F.col("path"), F.lit("$")), F.lit("(?s)."), F.lit(0))

    def grams(c: Column, n: int) -> Column:
        at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.concat(*[F.element_at(c, i + k) for k in range(n)])), F.lit(BUCKETS)).cast("int"))

    return F.flatten(F.transform(F.array(chars), lambda c: F.concat(*[grams(c, n) for n in NGRAMS])))


def fit(labelled: DataFrame) -> tuple[float, list[float]]:
    """Bias and weights from a labelled table (url, block), by stochastic gradient steps in the order of the rows' texts.

    Of more than MAX_LABELLED rows those with the least hash of the url are taken.
    """
    some = labelled.where("url is not null and block is not null").select("url", "block").orderBy(F.xxhash64("url"), "url", "block").limit(MAX_LABELLED)
    rows = with_parts(some).select("url", "block", buckets().alias("b")).collect()
    rows.sort(key=lambda r: (hash_of(r["url"]), r["url"], r["block"]))
    bias, w = 0.0, [0.0] * BUCKETS
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 10)
        for r in rows:
            b = r["b"]
            scale = 1 / math.sqrt(max(1, len(b)))
            z = bias + scale * sum(w[i] for i in b)
            step = rate * (float(r["block"]) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += 0.1 * step
            for i in b:
                w[i] += step * scale - rate * PENALTY * w[i]
    return bias, w


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages (url string) with host, path, rule, p_block and verdict."""
    bias, weights = fit(labelled)
    parts = with_parts(pages)
    which = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path), reverse=True):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        which = F.when(fits, F.lit(r.host + r.path)).otherwise(which)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    table = F.lit([float(x) for x in weights])
    total = F.aggregate(buckets(), F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1))
    z = F.lit(bias) + total / F.sqrt(F.greatest(F.lit(1), F.size(buckets())))
    scored = parts.withColumn("p_block", 1 / (1 + F.exp(-z)))
    return scored.withColumns({"rule": which, "verdict": F.coalesce(verdict, F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))})

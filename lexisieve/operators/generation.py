"""Generated cases and term lists: templates, obfuscations, synthetic dictionaries, and checks that sets stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisieve.functions.settings import SieveError


def from_templates(terms: DataFrame, templates: DataFrame, mark: str = "{surface}") -> DataFrame:
    """(term, template, text): every term in every template; both are short curated lists, broadcast only under a checked size."""
    n = templates.limit(100_001).count()
    if n > 100_000:
        raise SieveError("more than 100,000 templates")
    return terms.select("term").crossJoin(F.broadcast(templates.select("template"))).withColumn("text", F.replace("template", F.lit(mark), F.col("term")))


def variants(cases: DataFrame, sign: str = "*", gap: str = "  ") -> DataFrame:
    """cases (term, ...) as rows of each spelling: plain, separator, whitespace, mixed."""
    chars = F.regexp_extract_all(F.col("term"), F.lit("(?s)."), F.lit(0))
    spelled = {"plain": F.col("term"), "separator": F.array_join(chars, sign), "whitespace": F.array_join(chars, gap), "mixed": F.array_join(chars, f" {sign} ")}
    kinds = F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("surface")) for k, v in spelled.items()])
    return cases.select("*", F.explode(kinds).alias("_v")).select(*cases.columns, "_v.slice", "_v.surface")


def blinded(cases: DataFrame, prefix: str, revision: str) -> DataFrame:
    """Review cases with opaque ids, without their design label."""
    key = F.sha2(F.concat_ws("\0", F.lit(revision), F.col("text")), 256)
    return cases.select(F.concat(F.lit(prefix), F.substring(key, 1, 20)).alias("id"), "text", F.lit("review").alias("label")).distinct()


def common(a: DataFrame, b: DataFrame, key: str = "text") -> DataFrame:
    """Keys that two generated sets share; none may."""
    return a.select(key).intersect(b.select(key))


def forbidden(cases: DataFrame, surfaces: list[str], text: str = "text") -> DataFrame:
    """Cases that hold a surface which must not occur (a short list)."""
    bad = F.lit(False)
    for s in surfaces:
        bad = bad | F.contains(text, F.lit(s))
    return cases.where(bad)


def synthetic_terms(spark: SparkSession, n: int, shape: str = "standard") -> DataFrame:
    """(term) of n distinct terms: standard words, prefixes of one another (n <= 5000), or Hangul of three syllables."""
    i = F.col("id")
    ids = spark.range(n)
    if shape == "standard":
        return ids.select(F.concat(F.lit("term"), F.lpad(i.cast("string"), 8, "0")).alias("term"))
    if shape == "prefix":
        if n > 5000:
            raise SieveError("at most 5000 prefixes")
        return ids.select(F.concat(F.lit("p"), F.repeat(F.lit("x"), (i + 1).cast("int"))).alias("term"))
    if shape == "hangul":
        if n > 8000:
            raise SieveError("at most 8000 terms")
        rows = F.array(*[F.lit(chr(0xAC00 + 588 * (k % 19) + 28 * (k % 21))) for k in range(20)])
        pick = [F.get(rows, (F.floor(i / 20**p) % 20).cast("int")) for p in range(3)]
        return ids.select(F.concat(*pick).alias("term"))
    raise SieveError(f"no shape {shape!r}")

"""Sources and sinks.  Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisieve.functions.settings import SieveError

MATCHES = "array<struct<start:int,end:int,canonical_term:string>>"
SOURCE = "struct<kind:string,name:string,reference:string,revision:string,redistribution_allowed:boolean>"
CASE = f"struct<id:string,text:string,label:string,expected_matches:{MATCHES},slices:array<string>,source:{SOURCE},license:string,split:string,notes:string>"
CORPUS = f"schema_version int, corpus_id string, cases array<{CASE}>"
LICENSES = ("MIT", "Apache-2.0", "CC-BY-4.0", "CC-BY-SA-4.0")
DELIMITERS = {"pipe": "|", "tab": "\t", "comma": ","}


class SourceError(SieveError):
    """A source that is not what its specification says."""


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): trimmed lines without blank ones and comments, distinct."""
    t = F.trim(F.regexp_replace("value", "^\\x{FEFF}", ""))
    return spark.read.text(path).select(t.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def ordered_terms(terms: DataFrame) -> DataFrame:
    return terms.orderBy(F.desc(F.length("term")), "term")


def term_positions(terms: DataFrame) -> DataFrame:
    """(term, position) of distinct terms in the order of ordered_terms, without one task that sees them all: ranks inside ranges, and counts of the ranges before."""
    keyed = terms.select("term", F.length("term").alias("_n"), F.substring("term", 1, 3).alias("_head"))
    counts = keyed.groupBy("_n", "_head").agg(F.count("*").alias("_k"))
    order = Window.orderBy(F.desc("_n"), "_head").rowsBetween(Window.unboundedPreceding, -1)  # of ranges, not of terms
    before = counts.select("_n", "_head", F.coalesce(F.sum("_k").over(order), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_n", "_head").orderBy("term"))
    return keyed.withColumn("_own", own).join(before, ["_n", "_head"]).select("term", (F.col("_before") + F.col("_own")).alias("position"))


def alias_list(spark: SparkSession, path: str) -> DataFrame:
    """(alias, term, mode, ok): lines of three tab-separated fields; ok is false where a field is missing or the mode is unknown."""
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    out = lines.select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("alias", "term", "mode"))], F.size(parts).alias("n"))
    full = (F.col("n") == 3) & (F.col("alias") != "") & (F.col("term") != "") & F.col("mode").isin("exact_token", "token_prefix")
    return out.select("alias", "term", "mode", F.coalesce(full, F.lit(False)).alias("ok"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias").agg(F.count_distinct("term", "mode").alias("rules")).where("rules > 1")


def corpora(spark: SparkSession, *paths: str) -> DataFrame:
    """Cases of corpus documents (files, or folders searched for *.json), one row each, with corpus_id and path."""
    raw = spark.read.schema(CORPUS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(list(paths))
    raw = raw.withColumn("path", F.input_file_name()).where(~F.col("path").endswith(".schema.json"))
    return raw.select("path", "corpus_id", F.explode("cases").alias("c")).select("path", "corpus_id", "c.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files, numbered file by file from 1; files are read in splits, of which only counts are compared."""
    m = F.col("_metadata")
    raw = spark.read.text(path).select("value", m["file_path"].alias("_file"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before).select("_file", "_block", "_first", "_before")
    return raw.join(splits, ["_file", "_block"]).select((F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def delimited(spark: SparkSession, path: str, delimiter: str = "tab", text: int = 0, label: int | None = 1, header: bool = False, allowed: list[str] | None = None, longest: int = 4096) -> DataFrame:
    """(line, text, source_label, ok) of unquoted delimited lines; label -1 is the last field, and text then all before it.

    Lines are numbered file by file from 1; ok is false where a field is missing,
    the label is not allowed, or the text is empty or too long.
    """
    sign = DELIMITERS[delimiter]
    quoted = "\\" + sign if sign == "|" else sign
    rows = numbered_lines(spark, path).where(F.col("line") > int(header)).withColumn("value", F.when(F.col("line") == 1, F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.col("value")))
    parts = F.split("value", quoted, -1)
    if label == -1:
        body, tag = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), sign), F.get(parts, F.size(parts) - 1)
    else:
        body, tag = F.get(parts, F.lit(text)), F.get(parts, F.lit(label)) if label is not None else F.lit(None).cast("string")
    out = rows.select("line", body.alias("text"), tag.alias("source_label"))
    ok = F.coalesce((F.length("text") > 0) & (F.length("text") <= longest), F.lit(False))
    if label is not None:
        ok = ok & F.coalesce(F.col("source_label").isin(*allowed) if allowed else F.col("source_label") != "", F.lit(False))
    return out.withColumn("ok", ok)


def pipe_last_label(spark: SparkSession, path: str) -> DataFrame:
    """(text) of distinct lines `text|0` or `text|1`, cut at the last bar."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(.*)\|([01])$", 1).alias("text")).where("text <> ''").distinct()


def labelled_tsv(spark: SparkSession, path: str, text: str = "content", label: str = "lable") -> DataFrame:
    """(text, label int): a tab-separated file with a header; labels other than 0 and 1 become null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False).schema(f"{text} string, {label} string").csv(path)
    return raw.select(F.col(text).alias("text"), F.when(F.col(label).isin("0", "1"), F.col(label).cast("int")).alias("label"))


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, lines) of files."""
    body = F.col("content").cast("string")
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).alias("lines"))


def check_artifact(spark: SparkSession, path: str, sha256: str, size: int | None = None) -> None:
    for r in artifact(spark, path).select("sha256", "bytes").collect():
        if r["sha256"] != sha256 or (size is not None and r["bytes"] != size):
            raise SourceError(f"{path} is not the pinned artifact")


def canonical_hash(payload) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def benchmark_cases(spark: SparkSession, path: str, profiles: tuple[str, ...] = ("strict", "balanced", "aggressive")) -> DataFrame:
    """(name, text, profile, ok) of a JSON benchmark: text as given, or a pattern repeated; ok is false without either, with both, for an unknown profile or a repeated name."""
    case = "struct<name:string,text:string,pattern:string,repeat:int,profile:string>"
    raw = spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(path).select(F.inline("cases"))
    text = F.coalesce("text", F.repeat(F.col("pattern"), F.col("repeat")))
    one = F.col("text").isNull() != (F.col("pattern").isNull() | F.col("repeat").isNull() | (F.col("repeat") < 1))
    twice = raw.groupBy("name").agg((F.count("*") == 1).alias("_single"))
    ok = F.coalesce(one & (F.col("name") != "") & F.col("profile").isin(*profiles) & F.col("_single"), F.lit(False))
    return raw.join(twice, "name").select("name", text.alias("text"), "profile", ok.alias("ok"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in the warehouse where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch path and read from there, so that what reads it twice doesn't make it twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Writes JSON lines; refuses to overwrite, and to write into an input."""
    if any(path.rstrip("/") == i.rstrip("/") or path.startswith(i.rstrip("/") + "/") for i in inputs):
        raise SourceError("the output is one of the inputs")
    df.write.mode("errorifexists").json(path)


def sensitive_or_not(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(flag), df.where(~flag)

"""The corpus pipeline: language ID, near-dedup, substring dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on every document its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of
documents.  n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisieve.llm import langid, minhash, packing, secrets, substring
from lexisieve.llm.spark_utils import discard, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CERTAIN = 0.5  # least probability of the predicted language


def _changed(docs: DataFrame, flag) -> DataFrame:
    return docs.withColumn("n_chars", F.when(flag, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter, or whose language is in doubt, go."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    certain = (F.col("score") >= CERTAIN) & ~F.isnan("score")  # Spark orders NaN above all numbers
    return langid.identify(docs, model).where((F.col("lang_pred") != "und") & certain).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.near_duplicates(docs, k=5, percent=80).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words or more that an earlier document, or part of one, has; documents that keep no word go."""
    cut = substring.remove_repeats(docs.select(*COLUMNS), keep_clean=True)
    return _changed(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), F.col("n_removed") > 0)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _changed(secrets.redact(docs.select(*COLUMNS)), F.size("secrets") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences of 1024 tokens."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
ORACLE_SQL = None  # neither the language model nor the packing can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        kept = settled(functools.partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = kept
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

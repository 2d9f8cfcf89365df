"""The registered queries on small tables: their columns, types and digests, as their contracts have them."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from lexisieve.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    sounds = {"en": ["the ", "ing ", "and ", "er "], "de": ["und ", "sch", "ein ", "der "]}
    out = [(i, "".join(rng.choice(sounds[lang]) for _ in range(rng.randint(3, 60))), lang) for i, lang in ((i, rng.choice(["en", "de"])) for i in range(60))]
    return [*out, (900, None, "en"), (901, "", None), (902, "naïve 日本 it's 12\n\n 'll", "en"), (903, "long words follow here " * 1500, "en"), (904, "天" * 200, None)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    x = np.random.default_rng(5).normal(size=(250, 8)).round(3)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.com/fr/x", "<p>"), (2, None, None), (3, "http://b.example.org/es/1", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def test_all_eleven_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    assert len(names) == 11 and set(entry.oracle_sql()) <= set(entry.queries())


def test_op1_columns(spark, sf, rows):
    out = Q.op1_lm_scoring(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and got[i]["n_tokens"] == len(WORD.findall(t or "")) + 1
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0


def test_op2_equals_brute_force(spark, sf):
    out = Q.op2_ann(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out.collect()}
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(250), d)) if i != q][:10]
        assert [got[q, k + 1][0] for k in range(10)] == best and all(math.isclose(got[q, k + 1][1], d[i]) for k, i in enumerate(best))


def test_op3_columns(spark, sf):
    got = {r["page_id"]: tuple(r) for r in Q.op3_url_filter(spark, sf).collect()}
    assert got[1] == (1, "a.com", "/fr/x", "com/fr/", "allow") and got[2][1:4] == ("", "", None) and got[3] == (3, "b.example.org", "/es/1", "example.org/es/", "block")


def test_op4_digests_equal_the_library(spark, sf, rows):
    import public_tokenizers
    import tiktoken

    from lexisieve.llm import bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.default_ranks(), special_tokens={})
    got = {r["doc_id"]: r for r in Q.op4_bpe(spark, sf).collect()}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op7_covers_every_document(spark, sf, rows):
    from tokenizers import Tokenizer

    from lexisieve.llm import packing

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = Q.op7_packing(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids)
        assert len(own) == max(1, -(-len(ids) // 1024)) and all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1


def test_op9_scores_are_probabilities(spark, sf, rows):
    got = {r["doc_id"]: r for r in Q.op9_language_id(spark, sf).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))



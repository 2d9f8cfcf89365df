"""The pipeline's stages on a small corpus, each judged on its own input."""

import os

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    en = ["the morning was calm and the water lay still under a pale sky", "they walked along the harbour until the lights came on", "nobody remembered who had first opened the old gate"]
    passage = " ".join(f"shared{i} passage" for i in range(30))
    rows = []
    for i in range(40):
        body = " ".join(f"{w}{(i * 7 + k) % 50}" if k % 3 == 0 else w for k, w in enumerate((" ".join(en) + " ").split() * 3))
        rows.append((i, f"document {i * 31} {body}", "en", "s0", 0))
    rows.append((100, rows[0][1], "en", "s1", 0))  # an exact copy
    rows.append((101, rows[1][1] + " tail", "en", "s1", 0))  # a near copy
    rows += [(110 + i, " ".join(f"only{i}x{k} here" for k in range(30)) + f" {passage} closing {i}", "en", "s2", 0) for i in range(2)]
    rows += [(120, 'my token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" is here', "en", "s3", 0), (121, "1234 5678", "en", "s3", 0), (122, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    return path


def test_stages(spark, corpus, tmp_path):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "pack":
            assert docs.columns == list(P.COLUMNS)
    every = {*range(40), 100, 101, 110, 111, 120}
    assert set(seen["language"]) == every
    assert set(seen["near_dedup"]) == every - {100, 101}
    cut = seen["substring_dedup"]
    assert "shared3" in cut[110]["text"] and "shared3" not in cut[111]["text"] and cut[111]["n_chars"] == len(cut[111]["text"])
    assert all(cut[i]["text"] == seen["near_dedup"][i]["text"] for i in (0, 120))
    assert seen["secret_scan"][120]["text"].startswith("my [SECRET]") and "f3ef4d6b" not in seen["secret_scan"][120]["text"]
    assert all(seen["secret_scan"][i]["text"] == cut[i]["text"] for i in range(40) if i in cut)
    assert set(seen["pack"]) == set(seen["secret_scan"])


def test_run_gives_the_last_stage(spark, corpus):
    out = P.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() >= 40


def test_run_on_an_empty_table(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from lexisieve.functions import columns as K
from lexisieve.functions import detector as N
from lexisieve.functions import views as V
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import profile
from lexisieve.operators import evaluation


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_characters_that_stand_for_themselves_are_not_normalised_one_by_one(form, monkeypatch):
    calls = []
    plain = V.normalize
    monkeypatch.setattr(V, "normalize", lambda f, t: calls.append(t) or plain(f, t))
    text = "über die brücke. " * 500 + "​é ㅂㅂ"
    v = V.base_view(text, form)
    assert v.text == plain(form, text.replace("​", "")) and len(calls) < 200


def test_kernels_take_bounded_slices(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 10)
    texts = ["abcd", None, "", "efgh", "x" * 50, "ij", "가나다", "라"]
    taken = list(K.slices(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["k"])])))
    assert sum(taken, []) == [*texts, "k"]
    assert all(len(s) == 1 or sum(len((t or "").encode()) for t in s) <= 10 for s in taken)


@pytest.mark.parametrize("name", ["profile_aggressive", "profile_matrix", "ablation_run"])
def test_disguised_words_side_by_side(spark, tmp_path, name):
    texts = ["a stupid idiot b", "x stupid trash y clown stupid scum z", "a stupid pathetic fool", "worthless", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows[:4] + rows[5:], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_profiles_read_each_text_once(spark):
    docs = spark.createDataFrame([(1, "바*보 qkqh idi0t"), (2, None), (3, "")], "case_id long, text string")
    lexicon, matrix = Lexicon.build(["바보", "idiot"]), evaluation.matcher_matrix()
    found = evaluation.predictions(docs, lexicon, matrix)
    for df in (found, K.Sieve(lexicon).spans(docs, "text")):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    alone = [(p, m.term, m.start, m.end, m.method) for p, s in matrix.items() for m in N.Detector(lexicon, s)("바*보 qkqh idi0t")[1]]
    assert sorted((r["profile"], r["term"], r["start"], r["end"], r["method"]) for r in found.collect()) == sorted(alone)


def test_far_tokens_cost_no_deletions(monkeypatch):
    d = N.Detector(Lexicon.build(["worthless"]), profile("aggressive", fuzzy_max_distance=2))
    calls, plain = [], N.deletions
    monkeypatch.setattr(N, "deletions", lambda w, n: calls.append(w) or plain(w, n))
    found = d("another sentence about nothing in particular, with worthlxsz inside")[1]
    assert [(m.term, m.matched_text) for m in found] == [("worthless", "worthlxsz")] and len(calls) <= 2


def test_joined_runs_are_not_remembered():
    before = V._typed_word.cache_info().currsize
    keys = "qkqhdkssud" * 50
    b = V._Builder()
    V.compose([(V.KEYS[c], i, i + 1) for i, c in enumerate(keys)], b)
    assert V.typed(keys) == "".join(b.chars) and V._typed_word.cache_info().currsize == before

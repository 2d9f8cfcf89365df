import pytest

import __spark_entry__ as entry
from lexisieve.functions.columns import Sieve
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import profile
from lexisieve.operators import intake
from lexisieve.plans.corpus import LICENSED, QUARANTINE


@pytest.mark.parametrize("kind", ["quarantine", "licensed"])
def test_intakes_match_each_text_once(spark, kind):
    labels = ("0", "1") if kind == "quarantine" else ("en", "de")
    rows = [(1, "alpha", labels[0]), (2, "Alpha!", labels[0]), (3, "beta", labels[0]), (4, "beta", labels[1]), (5, "call 01012345678", labels[1]), (6, "gone", labels[1]), (7, "gamma", labels[1]), (7, "gamma", labels[1]), (8, None, labels[1]), (9, "delta", None)]
    df = spark.createDataFrame(rows, "row_number long, text string, source_label string")
    if kind == "quarantine":
        cases, report = intake.quarantine(df, df.where("row_number = 6"), QUARANTINE, exact=False)
        texts, eligible = [["Alpha!", "gamma"], ["alpha", "gamma"]], {"not-excluded": 9, "not-sensitive": 7, "eligible": 2, "selected": 2}
    else:
        cases, report = intake.licensed(df, LICENSED, exact=False)
        texts, eligible = [["Alpha!", "alpha", "beta", "gamma", "gone"]], {"unique": 8, "eligible": 6, "selected": 5}
    got: dict[str, int] = {}
    for r in report.collect():
        got[r["measure"]] = got.get(r["measure"], 0) + r["n"]
    assert got == {"source": 10} | eligible
    assert sorted(r["text"] for r in cases.collect()) in texts
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "RLIKE" not in plan and "regexp_replace" not in plan


@pytest.mark.parametrize("name", ["fuzzy_detect_two", "fuzzy_detect", "profile_balanced", "segmented_jamo_obfuscation"])
def test_normalised_texts_stay_in_the_kernel(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "only(" in plan and "kernel(" not in plan


def test_matches_are_those_of_detect(spark):
    own = Sieve(Lexicon.build(["idiot", "바보"]), settings=profile("aggressive", max_input_length=30))
    texts = ["an idiot", "i d i o t and qkqh", None, "", "x" * 31, "idi0t 바*보"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", own.detect("text")["matches"].alias("d")).collect(), df.select("i", own.matches("text").alias("d")).collect()
    assert rows[0] == rows[1] and [r["d"] is None for r in sorted(rows[1])] == [False, False, True, False, True, False]
    assert sorted(own.spans(df).collect()) == sorted((r["i"], *m) for r in rows[0] for m in r["d"] or ())

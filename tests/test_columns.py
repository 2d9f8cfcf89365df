import pytest
from pyspark.sql import functions as F

from lexisieve.functions import columns as K
from lexisieve.functions.columns import Sieve
from lexisieve.functions.lexicon import Lexicon
from lexisieve.functions.settings import SettingsError
from lexisieve.streaming.detect import detect_stream

SIEVE = Sieve(Lexicon.build(["idiot", "바보"], ["idiotic"]), "aggressive")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "an idiot, idiotic 바 보😀"), (2, None), (3, ""), (4, "x" * 5000), (5, "idiot idiot")], "id int, text string")


def test_detect_contains_and_mask(rows):
    d = SIEVE.with_detection(rows)
    d = d.withColumns({"has": K.contains(F.col("detection")), "masked": K.masked(F.col("text"), F.col("detection"), "#")}).withColumns(K.first(F.col("detection")))
    out = {r["id"]: r for r in d.collect()}
    assert out[1]["masked"] == "an #####, idiotic ###😀" and out[1]["has"] and out[1]["method"] == "exact"
    assert out[2]["detection"] is None and out[2]["has"] is None and out[2]["masked"] is None
    assert out[3]["masked"] == "" and out[3]["has"] is False and out[3]["method"] == "none" and out[3]["confidence"] == 0.0
    assert out[4]["detection"]["error"] == "input_too_long" and out[4]["masked"] is None
    assert [m["start"] for m in out[5]["detection"]["matches"]] == [0, 6]


def test_spans_rows_hold_the_text_they_name(rows):
    got = SIEVE.spans(rows).join(rows, "id")
    assert got.where("matched_text <> substring(text, start + 1, end - start)").count() == 0 and got.count() == 4


def test_original_span(spark):
    v = spark.sql("SELECT 'a  b' AS t").select(K.normalize("t").alias("v"))
    r = v.select(K.original_span(F.col("v"), F.lit(1), F.lit(3)).alias("s"), K.original_span(F.col("v"), F.lit(2), F.lit(9)).alias("no")).first()
    assert tuple(r["s"]) == (1, 4) and r["no"] is None


def test_native_keys_agree_with_the_general_one(spark):
    df = spark.createDataFrame([("Aa..bß  b!",), ("",), (None,), ("ÉÉ-x x",)], "t string")
    assert df.where(~K.leak_key(F.col("t")).eqNullSafe(K.leak_key_full("t"))).count() == 0


def test_mask_sign_and_profile_are_checked(rows):
    with pytest.raises(SettingsError):
        SIEVE.mask(rows, char="**")
    with pytest.raises(SettingsError):
        Sieve(SIEVE.lexicon, "strict", SIEVE.settings)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "text string, term string")
    assert SIEVE.with_detection(empty).count() == 0


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("an idiot",), ("fine",)], "text string").write.json(src)
    s = detect_stream(spark.readStream.schema("text string").json(src), SIEVE).select("text", K.contains(F.col("detection")).alias("has"))
    q = s.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["text"], r["has"]) for r in spark.table("found").collect()} == {("an idiot", True), ("fine", False)}

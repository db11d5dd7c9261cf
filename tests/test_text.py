"""Hand cases and properties of the column functions."""
import math

from pyspark.sql import functions as F

from corpuslab.functions import rouge as rg
from corpuslab.functions import text as tx


def one(spark, col, schema="x string", value=None):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


def test_word_count_empty_is_zero(spark):
    df = spark.createDataFrame([("",), ("a  b\tc",), ("  lead",)], "x string")
    assert [r[0] for r in df.select(tx.word_count("x")).collect()] == [0, 3, 1]


def test_tokenize_and_sentences(spark):
    df = spark.createDataFrame([("Hello, World! A b2 x. Again?",)], "x string")
    r = df.select(tx.tokenize("x").alias("t"), tx.sentences("x").alias("s")).first()
    assert r["t"] == ["hello", "world", "b2", "again"]
    assert r["s"] == ["Hello, World!", "A b2 x.", "Again?"]


def test_strip_markers(spark):
    df = spark.createDataFrame([("</s><s>abc</s>",), ("short",)], "x string")
    assert [r[0] for r in df.select(tx.strip_markers("x")).collect()] == ["abc", ""]


def test_js_distance_properties(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5], [0.5, 0.3, 0.2]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0])],
                               "p array<double>, q array<double>")
    r = df.select(tx.js_distance("p", "q").alias("a"), tx.js_distance("q", "p").alias("b")).collect()
    assert abs(r[0]["a"] - r[0]["b"]) < 1e-12
    assert abs(r[1]["a"] - math.sqrt(math.log(2))) < 1e-12
    assert abs(r[2]["a"]) < 1e-7


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.5],)], "v array<double>")
    r = df.select(tx.softmax("v").alias("p"), tx.argmax("v").alias("i")).first()
    assert abs(sum(r["p"]) - 1) < 1e-12 and r["i"] == 1


def test_rouge_n_identity_and_disjoint(spark):
    df = spark.createDataFrame([("the cat sat. on the mat", "the cat sat. on the mat"), ("a b c", "d e f")],
                               "h string, r string")
    r = df.select(rg.rouge_n("h", "r", 1).alias("r1"), rg.rouge_n("h", "r", 2).alias("r2")).collect()
    assert abs(r[0]["r1"] - 1) < 1e-6 and abs(r[0]["r2"] - 1) < 1e-6
    assert r[1]["r1"] == 0.0


def test_rouge_l_hand_case():
    # hyp and ref share the LCS 'a c d' (distinct words 3); ref has 4 distinct, hyp 4 distinct
    f = rg.rouge_l_text("a b c d", "a c x d")
    p = r = 3 / 4
    assert abs(f - 2 * (p * r) / (p + r + 1e-8)) < 1e-12
    assert rg.rouge_l_text("...", "a") is None


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "w array<string>")
    r = df.select(tx.ngrams("w", 2).alias("g")).collect()
    assert r[0]["g"] == ["a b", "b c"] and r[1]["g"] == []

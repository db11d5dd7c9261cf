"""The learned sentence-continuation score: gradient against plain loops, held-out quality, edges."""
import math

import numpy as np
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import continuation as ct


def plain_vector(s):
    b = (" " + (s or "") + " ").encode()
    out = [0.0] * ct.DIMS
    for i in range(len(b) - 1):
        out[(b[i] * 256 + b[i + 1]) * 0x9E3779B97F4A7C15 % 2**64 >> 56] += 1
    for i in range(len(b) - 2):
        out[(b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 0xBF58476D1CE4E5B9 % 2**64 >> 56] += 1
    return [math.sqrt(x / sum(out)) for x in out]


def test_gradient_is_the_sum_over_all_rows(spark):
    rows = [(1, "Ab é.", "cd"), (0, "", "x y"), (1, "zz", "zz"), (0, "Ab é.", "☃")]
    df = spark.createDataFrame([(y, ct.grams(a), ct.grams(b)) for y, a, b in rows], "y int, a binary, b binary").repartition(3)
    w = np.random.default_rng(1).normal(size=(ct.DIMS, ct.DIMS))
    g, gb, n = ct.gradient(df, w, 0.3)
    want, wb = np.zeros_like(w), 0.0
    for y, a, b in rows:
        u, v = np.array(plain_vector(a)), np.array(plain_vector(b))
        e = 1 / (1 + math.exp(-(u @ w @ v + 0.3))) - y
        want, wb = want + e * np.outer(u, v), wb + e
    assert n == 4 and np.allclose(g, want) and abs(gb - wb) < 1e-9


def test_scorer_beats_jaccard_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", tx.sentences("text").alias("s"))
    rows = ct.examples(docs, "doc_id", "s", pairs=30_000)
    w, bias = ct.fit(rows, steps=20)
    r = ct.evaluate(rows, w, bias).first()
    assert r["n_pairs"] > 5000 and r["auc"] > 0.8 and r["auc"] > r["auc_jaccard"] + 0.05, r
    # the mean over neighbours, edges
    s = [["The onst and.", "Of the thing.", "Und der nicht."], ["one."], [], None, ["", "x"]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i int, s array<string>") \
        .select("i", ct.coherence(spark, w, bias)(F.col("s")).alias("c")).orderBy("i").collect()

    def one(a, b):
        return 1 / (1 + math.exp(-(np.array(plain_vector(a)) @ w @ np.array(plain_vector(b)) + bias)))
    assert [r["c"] for r in got] == [round((one(*s[0][:2]) + one(*s[0][1:])) / 2, 4), 0.0, 0.0, 0.0, round(one("", "x"), 4)]


def test_no_examples(spark):
    docs = spark.createDataFrame([(1, ["only one"]), (2, None), (3, [])], "id int, s array<string>")
    rows = ct.examples(docs, "id", "s")
    w, bias = ct.fit(rows)
    assert rows.count() == 0 and not w.any() and bias == 0

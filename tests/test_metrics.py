"""Sentinel branches and properties of the document metrics."""
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.functions import rouge as rg
from corpuslab.functions import text as tx
from corpuslab.functions.fragments import greedy_fragments
from corpuslab.operators import filters as flt
from corpuslab.operators import joins as jn
from corpuslab.operators import metrics as mt

DOCS = [("empty", "", ""), ("one", "Just one sentence here.", "Just one sentence here and more."),
        ("dot", "Something. .", "Text."), ("same", "Same words. Same words.", "Same words again."),
        ("stop", "the of and.", "the of and the.")]


def frame(spark):
    df = spark.createDataFrame(DOCS, "identifier string, summary string, description string")
    return mt.prepare(df)


def test_sentinel_branches(spark):
    p = frame(spark)
    out = p.select("identifier", mt.abstractivity().alias("abstractivity"),
                   mt.coherence(F.col("s_sent")).alias("coh"),
                   mt.redundancy_ttr(tx.remove_stop("s_tok")).alias("ttr"),
                   rg.redundancy_rouge("s_sent").alias("red"))
    got = {r["identifier"]: r for r in flt.with_sentinels(out, ["abstractivity", "ttr", "red"]).collect()}
    assert got["empty"]["abstractivity"] == 999 and got["empty"]["red"] == 999 and got["empty"]["coh"] == 0.0
    assert got["one"]["red"] == 0.0 and got["one"]["abstractivity"] == 0.0
    assert got["dot"]["red"] == 999
    assert got["same"]["red"] == 1.0 and got["same"]["coh"] == 1.0
    assert got["stop"]["ttr"] == 999


def test_equal_pair_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a", "c"],), ([],)], "s array<string>")
    r = df.select(jn.equal_pair_stats(F.col("s")).alias("r")).select("r.*").collect()
    assert (r[0]["n_pairs"], r[0]["n_equal_pairs"], r[0]["n_ordered_unequal_pairs"]) == (10, 3, 14)
    assert (r[1]["n_pairs"], r[1]["n_equal_pairs"]) == (0, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=30))
def test_abstractivity_equals_greedy_fragments(s, d):
    frags = greedy_fragments(s, d)
    covered = sum(len(f) for f in frags)
    shared = sum(1 for t in s if t in d)
    assert covered == shared


def test_abstractivity_column_matches_fragments(spark):
    random.seed(3)
    rows = []
    for i in range(200):
        s = [random.choice("abcdefg") * 2 for _ in range(random.randint(1, 10))]
        d = [random.choice("abcdefgh") * 2 for _ in range(random.randint(1, 40))]
        rows.append((i, s, d))
    df = spark.createDataFrame(rows, "i int, s_tok array<string>, d_tok array<string>")
    got = {r["i"]: r["a"] for r in df.select("i", mt.abstractivity().alias("a")).collect()}
    for i, s, d in rows:
        frags = greedy_fragments(s, d)
        assert got[i] == round(1 - sum(len(f) for f in frags) / len(s), 4)


def test_unigram_similarity_bounds(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["b"])], "s_tok array<string>, d_tok array<string>")
    r = [x[0] for x in df.select(mt.unigram_similarity()).collect()]
    assert r[0] == 1.0 and r[1] == round(1 - math.sqrt(math.log(2)), 4)


def test_pair_rouge_vectorised_matches_pure_python():
    random.seed(7)
    for _ in range(100):
        n = random.randint(2, 7)
        sents = [" ".join(random.choice("abcdef") for _ in range(random.randint(1, 12))) + "." for _ in range(n)]
        import numpy as np
        a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        keep = a != b
        words = [s[:-1].split(" ") for s in sents]
        fast = rg.pair_rouge_l(words, a[keep], b[keep])
        slow = [rg.rouge_l_text(sents[x], sents[y]) for x, y in zip(a[keep], b[keep])]
        assert np.allclose(fast, slow, atol=1e-12)

"""The topic model as a table against a plain-Python version, its updates, and what it gives."""
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpuslab.operators import topics as tp


def psi(x):
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def start(term, k, seed):
    return [1 - 0.1 * 3 ** 0.5 + 0.2 * 3 ** 0.5 * int(hashlib.md5(f"{term}:{j}:{seed}".encode()).hexdigest()[:13], 16) / 16 ** 13 for j in range(k)]


def plain_gamma(doc, lam, k):
    """Word by word, topic by topic."""
    sums = [sum(w[j] for w in lam.values()) for j in range(k)]
    beta = {t: [math.exp(psi(lam[t][j]) - psi(sums[j])) for j in range(k)] for t in set(doc) if t in lam}
    words = sorted(t for t in set(doc) if t in beta)
    count = {t: doc.count(t) for t in words}
    gamma = [1 / k + sum(count.values()) / k] * k
    for _ in range(tp.STEPS):
        if not words:
            break
        theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
        new = [1 / k] * k
        for t in words:
            norm = sum(theta[j] * beta[t][j] for j in range(k)) + tp.TINY
            for j in range(k):
                new[j] += theta[j] * count[t] * beta[t][j] / norm
        moved = sum(abs(a - b) for a, b in zip(new, gamma)) / k
        gamma = new
        if moved < tp.SETTLED:
            break
    return gamma, beta, count


def plain_update(lam, docs, k, seen, step):
    got = {t: [0.0] * k for t in lam}
    for doc in docs:
        gamma, beta, count = plain_gamma(doc, lam, k)
        theta = [math.exp(psi(g) - psi(sum(gamma))) for g in gamma]
        for t, n in count.items():
            norm = sum(theta[j] * beta[t][j] for j in range(k)) + tp.TINY
            for j in range(k):
                got[t][j] += theta[j] * n * beta[t][j] / norm
    return {t: [w[j] * (1 - step) + step * (1 / k + got[t][j] * seen / len(docs)) for j in range(k)] for t, w in lam.items()}


def corpus(n, seed=5):
    r = random.Random(seed)
    sides = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    out = [[r.choice(sides[i % 2] if r.random() < 0.9 else ["both", "of", "them"]) for _ in range(r.randint(3, 30))] for i in range(n)]
    return out + [[], ["once"]]


def frame(spark, docs, first=0):
    return spark.createDataFrame([(f"d{first + i}", d) for i, d in enumerate(docs)] + [("null", None)], "identifier string, tokens array<string>")


def test_numbers():
    x = np.array([1e-3, 0.2, 1.0, 2.5, 7.0, 1e6])
    assert np.allclose(tp.digamma(x), [psi(v) for v in x])
    assert np.allclose(tp.log_gamma(x), [math.lgamma(v) for v in x])


def test_base_fit_and_updates_equal_the_plain_version(spark):
    docs = corpus(60)
    blocks = tp.doc_blocks(frame(spark, docs).repartitionByRange(1, "identifier"), block_tokens=150)
    rows = blocks.orderBy("block").collect()
    of = {f"d{i}": d for i, d in enumerate(docs)} | {"null": []}
    assert sorted(k for r in rows for k in r["keys"]) == sorted(of)      # every document in one block
    assert len(rows) >= 4
    model = tp.lda_fit(blocks, k=2, seed=3, batches=3, base_passes=2)
    parts = [[of[k] for n, r in enumerate(rows) if n % 3 == b for k in r["keys"]] for b in range(3)]
    lam = {t: start(t, 2, 3) for d in docs for t in d}
    lam = plain_update(lam, parts[0], 2, len(parts[0]), 1.0)
    lam = plain_update(lam, parts[0], 2, len(parts[0]), 1.0)
    seen = len(parts[0])
    for t, b in ((2, 1), (3, 2)):
        seen += len(parts[b])
        lam = plain_update(lam, parts[b], 2, seen, (1 + t) ** -0.5)
    got = {r["term"]: r["lam"] for r in model.table.collect()}
    assert got.keys() == lam.keys() and model.updates == 4 and model.seen == len(of)
    assert all(np.allclose(got[t], lam[t], rtol=1e-6) for t in lam)
    # distributions, with terms that the model does not know
    more = docs[:10] + [["nobody", "knows"], ["a1", "nobody"]]
    out = tp.topic_distribution(model, tp.doc_blocks(frame(spark, more)))
    for r in out.collect():
        doc = [] if r["identifier"] == "null" else more[int(r["identifier"][1:])]
        gamma, _, _ = plain_gamma(doc, lam, 2)
        assert np.allclose(r["topics"], np.array(gamma) / sum(gamma), atol=1e-6)
    # a fitted model is taken up again and learns new terms
    again = tp.TopicModel.load(spark, model.path)
    assert (again.seen, again.updates, again.k) == (model.seen, model.updates, 2)
    new = [["fresh", "a1", "a2"], ["fresh", "b1"]]
    after = tp.update(again, tp.doc_blocks(frame(spark, new, 1000)))
    lam["fresh"] = start("fresh", 2, 3)
    lam = plain_update(lam, [*new, []], 2, seen + 3, 5 ** -0.5)
    got = {r["term"]: r["lam"] for r in after.table.collect()}
    assert got.keys() == lam.keys() and all(np.allclose(got[t], lam[t], rtol=1e-6) for t in lam)


def test_topics_separate_and_no_term_is_dropped(spark):
    docs = corpus(200)
    blocks = tp.doc_blocks(frame(spark, docs).repartition(4), block_tokens=400)
    model = tp.lda_fit(blocks, k=2, seed=1, batches=4, base_passes=6)
    assert model.table.count() == len({t for d in docs for t in d})
    top = tp.lda_topics(model, 5).collect()
    assert len(top) == 10 and {r["rank"] for r in top} == set(range(5))
    sides = [{r["term"][0] for r in top if r["topic"] == j and r["term"] not in ("both", "of", "them")} for j in range(2)]
    assert sorted(map(sorted, sides)) == [["a"], ["b"]]
    n, perplexity = tp.log_perplexity(model, blocks)
    worse = tp.log_perplexity(tp.begin(spark, blocks, 2, 1), blocks)[1]
    assert n == model.table.count() and 0 < perplexity < worse


def test_empty_corpus(spark):
    blocks = tp.doc_blocks(frame(spark, []).where("identifier = 'x'"))
    model = tp.lda_fit(blocks, k=2)
    assert model.table.count() == 0 and tp.topic_distribution(model, blocks).count() == 0
    assert tp.log_perplexity(model, blocks) == (0, 0.0) and tp.lda_topics(model).count() == 0


def test_many_terms(spark):
    docs = spark.range(1100).select(F.col("id").cast("string").alias("identifier"), F.transform(
        F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda x: x.cast("string")).alias("tokens"))
    assert tp.lda_fit(tp.doc_blocks(docs), k=2, batches=1, base_passes=1).table.count() == 1_100_000


def test_blocks_are_not_dealt_out_to_find_a_batch(spark):
    blocks = tp.doc_blocks(frame(spark, corpus(20)), block_tokens=50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = tp.in_turns(blocks, 3)
        plan = parts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert parts.count() == blocks.count()


def test_memory_of_a_block_does_not_grow_with_its_cells():
    import tracemalloc
    rng = np.random.default_rng(1)
    n, per, v, k = 3000, 200, 1000, 5
    ptr, idx, cnt = np.arange(n + 1) * per, rng.integers(0, v, n * per), np.ones(n * per)
    beta = rng.random((v, k))
    tracemalloc.start()
    gamma = tp.e_step(ptr, idx, cnt, beta, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6                                     # 600,000 cells: 24 MB for each array of k numbers a cell
    one = tp.e_step(ptr[:2], idx[:per], cnt[:per], beta, 0.2)
    assert np.allclose(gamma[:1], one, rtol=1e-12)


def test_only_numbers_go_through_the_join_of_clustering_features(spark, monkeypatch):
    from corpuslab.plans import queries as qs
    monkeypatch.setattr(qs, "lda_model", lambda *a: None)
    monkeypatch.setattr(qs, "lda_blocks", lambda *a: None)
    monkeypatch.setattr(qs, "lda_docs", lambda *a: spark.createDataFrame(
        [("a", "One word. Two words.", ["one", "word", "one"])], "identifier string, description string, tokens array<string>"))
    monkeypatch.setattr(qs.tp, "topic_distribution", lambda *a: spark.createDataFrame([("a", [0.2, 0.8])], "identifier string, topics array<double>"))
    out = qs.clustering_features(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert not any("array" in plan.children().apply(i).schema().simpleString() for i in range(2))
    assert [tuple(r)[:2] + tuple(r)[4:] for r in out.collect()] == [("a", 1, 4, 2)]

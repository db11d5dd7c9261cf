"""Queries themselves against plain versions: the words a mix takes, the ring walked key by key, the toxicity features and score,
and the pipeline run from end to end."""

import re
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpuslab.llm import bpe, mixing, ring, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix_by_hand(packed, names, sizes):
    """{(sid, start): [(shard, slot, first word, words)]} by walking every slot of the plan."""
    need, runs = mixing.plan(sizes, mixing.targets(sizes))
    out = {}
    for sid, shard, first, n in runs:
        blocks = -(-sizes[sid] // mixing.BLOCK)
        docs = sorted((r["start"], r["size"]) for r in packed if r["sid"] == sid and r["size"])
        for slot in range(first, first + n):
            b = int(mixing.permuted(*(np.array([x]) for x in (slot % blocks, blocks, mixing._key(sid, slot // blocks, 0))))[0])
            for start, size in docs:
                a, z = max(start, b * mixing.BLOCK), min(start + size, (b + 1) * mixing.BLOCK)
                if a < z:
                    out.setdefault((sid, start), []).append((shard, slot, a - start, z - a))
    return out


def test_taken_words_and_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, sizes = mixing._sources(docs)
    packed = mixing.pack(docs, names).collect()
    want = mix_by_hand(packed, names, sizes)
    at = {r["doc_id"]: (r["sid"], r["start"], r["size"]) for r in packed}
    got = {r["doc_id"]: r["taken"] for r in mixing.op10_mix_sources(spark, SF).collect()}
    assert got == {i: sum(p[3] for p in want.get((s, a), [])) if n else 0 for i, (s, a, n) in at.items()}
    texts = {r["doc_id"]: r["text"] for r in packed}
    by_hand = {}
    for i, (s, a, n) in at.items():
        if n and (s, a) in want:
            w = WORD.findall(texts[i])
            by_hand[i] = " ".join(" ".join(w[f:f + k]) for _, _, f, k in sorted(want[s, a]))
    mixed = {r["doc_id"]: (r["text"], r["n_chars"]) for r in mixing.mixed_documents(docs).collect()}
    assert mixed == {i: (t, len(t)) for i, t in by_hand.items()}


def test_toxicity_features_and_score(spark):
    texts = ["plain Text", "", None, "ab", "é☃ mixed 𝄞", "x" * 300]
    row, col = toxicity.grams(pa.array(texts))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        # as many n-grams as bytes allow, each in one bucket, none across texts
        assert len(set(col[row == i].tolist())) == len(col[row == i]) <= sum(max(0, len(b) + 2 - k + 1) for k in toxicity.ORDERS)
    one = [sorted(toxicity.grams(pa.array([t], pa.string()))[1].tolist()) for t in texts]
    assert [sorted(col[row == i].tolist()) for i in range(len(texts))] == one
    w = np.random.default_rng(2).normal(size=toxicity.DIMS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["score"] for r in toxicity.score(docs, w, 0.25).orderBy("doc_id").collect()]
    z = [0.25 + sum(w[c] for c in cols) for cols in one]
    assert np.allclose(got, [1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in z])


def test_the_law_of_rows_holds_for_the_query(spark):
    rows = ring.op7_ring_shards(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    loads = np.bincount([r["shard"] for r in rows], minlength=8)
    assert loads.max() - loads.min() <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(loads[s]))
    for r in rows:
        b = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_pipeline_from_end_to_end(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = read
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == read.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    p = bpe.pieces(bpe.model_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {i: p.lib.encode(t or "") for i, t in texts.items()}
    assert got == {i: (len(x), x) for i, x in want.items()} and len(got) > 50

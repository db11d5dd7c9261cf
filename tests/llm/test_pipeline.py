"""The pipeline and the queries over the smallest given tables."""

import corpus_pipeline
from corpuslab.llm.common import saved
from corpuslab.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing", "sentencepiece"]
    assert {q.split("_")[0] for q in QUERIES} == {"pipeline"} | {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns
        assert 0 < docs.count() <= n


def test_near_copies_by_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    texts = [base, base + [f"x{i}" for i in range(25)], base + [f"y{i}" for i in range(26)]]   # 100 / 125 and 100 / 126
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 2]

"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, cover, impacts, jaccard, ledger, mixing, phrases, quality, ring, suffixes, toxicity, trie, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality_model": quality.op1_quality_model,
    "op2_toxicity_nb": toxicity.op2_toxicity_nb,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_bpe_roundtrip": bpe.op4_bpe_roundtrip,
    "op5_secret_ledger": ledger.op5_secret_ledger,
    "op6_parity_jaccard": jaccard.op6_parity_jaccard,
    "op7_ring_shards": ring.op7_ring_shards,
    "op8_warc_store": warc.op8_warc_store,
    "op9_cover_tree": cover.op9_cover_tree,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_phrase_mining": phrases.op12_phrase_mining,
    "op13_impact_topk": impacts.op13_impact_topk,
}

ORACLES = {
    "op5_secret_ledger": ledger.ORACLE,
    "op8_warc_store": warc.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_phrase_mining": phrases.ORACLE,
    "op13_impact_topk": impacts.ORACLE,
}

"""Plan properties that matter at scale: no pair-producing joins, pruned scans."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
LAZY_KEYS = ["decade_rollup", "viable_filter", "id_subset", "token_semi", "token_anti", "sentence_pairs",
             "adjacent_pairs", "kmeans_assign_step", "predictions_concat", "score_cumfreq", "weighted_curve",
             "rouge_n", "unigram_similarity", "coherence", "split_dimensions", "eval_sheet_cluster",
             "doc_term_counts", "encode_pad", "size_totals", "stratified_split", "sample_per_class"]


def plan_of(spark, key):
    df = E.queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY_KEYS)
def test_no_pair_producing_joins(spark, key):
    plan = plan_of(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "parquet_scan")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


def test_filter_reaches_scan(spark):
    plan = plan_of(spark, "id_subset")
    assert "EqualTo(quality,1)" in plan

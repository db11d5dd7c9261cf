"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Each query reads the driver tables (or data Spark derives from them) and runs
the operator over whole tables.  Keys with a DuckDB twin are listed in
``corpuslab.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import fragments as fr
from corpuslab.functions import rouge as rg
from corpuslab.functions import text as tx
from corpuslab.operators import aggregates as agg
from corpuslab.operators import cluster as cl
from corpuslab.operators import continuation as ct
from corpuslab.operators import filters as flt
from corpuslab.operators import joins as jn
from corpuslab.operators import metrics as mt
from corpuslab.operators import mixture as mx
from corpuslab.operators import sampling as smp
from corpuslab.operators import subword as sw
from corpuslab.operators import topics as tp
from corpuslab.operators import vocab as vc
from corpuslab.operators.ranking import exact_quantiles, ordered_sum
from corpuslab.session import fresh_dir, shared_dir
from corpuslab.sinks import writers as wr
from corpuslab.sources import archives as ar
from corpuslab.sources import fixtures as fx
from corpuslab.sources import tables as tb
from corpuslab.sources.tables import table, union_files
from corpuslab.streaming import incremental as inc
from corpuslab.streaming import replaceable as rpl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# --- 2.5 aggregations --------------------------------------------------------
@query("decade_rollup")
def q_decade_rollup(spark, sf):
    return agg.decade_rollup(fx.cases(spark, sf))


# --- shared derived tables ----------------------------------------------------

FEATURES = ["topic_similarity", "abstractivity", "redundancy", "semantic_coherence", "cmp_words", "cmp_sents"]


def viable(spark, sf):
    return flt.viable_filter(fx.cases(spark, sf))


def features(spark, sf):
    """descriptive_feature over viable cases, with the SQL-checkable metric twins:
    topic similarity on unigram distributions, type-token redundancy of the
    summary, Jaccard coherence.  999 marks undefined values, as in the reference."""
    p = mt.prepare(viable(spark, sf))
    p = mt.length_features(p)
    f = p.select("identifier", mt.unigram_similarity().alias("topic_similarity"),
                 mt.abstractivity().alias("abstractivity"),
                 mt.redundancy_ttr(tx.remove_stop("s_tok")).alias("redundancy"),
                 mt.coherence(F.col("s_sent")).alias("semantic_coherence"),
                 "sum_words", "sum_sents", "desc_words", "desc_sents", "cmp_words", "cmp_sents")
    return flt.with_sentinels(f, FEATURES)


def split_cases(spark, sf):
    return smp.stratified_split(flt.viable_filter(fx.cases(spark, sf), keep=("class",)))


# --- 2.3 projections, filters, predicates ----------------------------------
@query("viable_filter")
def q_viable_filter(spark, sf):
    return viable(spark, sf)


@query("complete_filter")
def q_complete_filter(spark, sf):
    return flt.complete_filter(fx.cases(spark, sf))


@query("id_subset")
def q_id_subset(spark, sf):
    ids = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    return flt.id_subset(fx.cases(spark, sf), ids, "doc_id").select("identifier", "summary", "missing_parts")


@query("id_lookup")
def q_id_lookup(spark, sf):
    c = fx.cases(spark, sf)
    hit = flt.id_lookup(c, "ID:XX:SRC1:1911:1")
    gen = fx.generated(spark, sf, c)
    return (hit.join(gen, "identifier", "left")
            .select("identifier", F.col("summary").alias("reference"), "model", "c_summary"))


@query("length_equals")
def q_length_equals(spark, sf):
    return flt.length_equals(features(spark, sf), 1000).select("identifier", "desc_words")


def desc_words_table(spark, sf):
    """(identifier, desc_words), materialised once: the exact quantile reads it several times."""
    shared_dir(spark, "")
    return features(spark, sf).select("identifier", "desc_words").checkpoint(eager=True)


@query("quantile_trim")
def q_quantile_trim(spark, sf):
    return flt.quantile_trim(desc_words_table(spark, sf), "desc_words", 0.99)


@query("drop_sentinel")
def q_drop_sentinel(spark, sf):
    return flt.drop_sentinel(features(spark, sf), FEATURES)


@query("sentinel_audit")
def q_sentinel_audit(spark, sf):
    return flt.sentinel_audit(features(spark, sf), FEATURES)


@query("computed_only")
def q_computed_only(spark, sf):
    p = mt.prepare(viable(spark, sf))
    f = p.select("identifier", "summary", "description", mt.abstractivity().alias("abstractivity"))
    return flt.computed_only(f, "abstractivity")


@query("decade_of_id")
def q_decade_of_id(spark, sf):
    return fx.cases(spark, sf).select("identifier", tx.decade_of_id("identifier").alias("decade"))


@query("add_score_columns")
def q_add_score_columns(spark, sf):
    return flt.add_score_columns(split_cases(spark, sf).where(F.col("split") == "test"),
                                 drop=["summary", "description"])


@query("rename_prefix")
def q_rename_prefix(spark, sf):
    return flt.rename_prefix(fx.curves(spark, sf), "train_", ["epoch", "n", "loss"])


# --- 2.5 aggregations (continued) --------------------------------------------
@query("year_rollup")
def q_year_rollup(spark, sf):
    return agg.year_rollup(fx.cases(spark, sf))


@query("grand_totals")
def q_grand_totals(spark, sf):
    return agg.grand_totals(agg.decade_rollup(fx.cases(spark, sf)))


@query("feature_means")
def q_feature_means(spark, sf):
    # the sentinel filter goes into the aggregate (conditional means): a
    # separate filter would be pushed below the metric projection and make
    # Spark evaluate every metric twice
    f = features(spark, sf)
    keep = flt.no_sentinel(FEATURES)
    return f.agg(*[F.round(F.avg(F.when(keep, F.col(c))), 6).alias(f"mean_{c}")
                   for c in FEATURES + ["sum_words", "sum_sents", "desc_words", "desc_sents"]])


@query("class_mean_std")
def q_class_mean_std(spark, sf):
    return agg.class_mean_std(fx.eval_scores(spark, sf), fx.SCORE_COLUMNS)


@query("overall_mean_std")
def q_overall_mean_std(spark, sf):
    return agg.overall_mean_std(fx.eval_scores(spark, sf), fx.SCORE_COLUMNS)


@query("score_freq")
def q_score_freq(spark, sf):
    return agg.score_freq(fx.eval_scores(spark, sf), fx.SCORE_COLUMNS)


@query("score_cumfreq")
def q_score_cumfreq(spark, sf):
    return agg.score_cumfreq(fx.eval_scores(spark, sf), fx.SCORE_COLUMNS)


@query("distinct_count")
def q_distinct_count(spark, sf):
    return features(spark, sf).agg(F.count_distinct("desc_words").alias("n_distinct"))


@query("quantile")
def q_quantile(spark, sf):
    lo, hi = exact_quantiles(desc_words_table(spark, sf), "desc_words", [0.0, 0.99])
    return spark.createDataFrame([(round(lo, 6), round(hi, 6))], "q0 double, q99 double")


@query("histogram_density")
def q_histogram_density(spark, sf):
    f = desc_words_table(spark, sf).select("desc_words")
    lo, hi = exact_quantiles(f, "desc_words", [0.0, 0.99])
    bins = f.agg(F.count_distinct("desc_words")).first()[0]
    return agg.histogram_density(f, "desc_words", lo, hi, bins)


@query("size_totals")
def q_size_totals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size"))
    out = ordered_sum(d, [F.col("doc_id")], F.col("size"), "running")
    total = d.agg(F.sum("size")).first()[0] or 0  # a scalar
    return out.select("doc_id", "size", F.col("running").cast("bigint").alias("running"),
                      F.lit(total).cast("bigint").alias("total"))


@query("curve_bounds")
def q_curve_bounds(spark, sf):
    return agg.curve_bounds(fx.curves(spark, sf))


@query("best_checkpoint")
def q_best_checkpoint(spark, sf):
    return agg.best_checkpoint(fx.curves(spark, sf))


@query("weighted_curve")
def q_weighted_curve(spark, sf):
    return agg.weighted_curve(fx.curves(spark, sf))


# --- 2.6 windows, sampling, ordering --------------------------------------
@query("shuffle")
def q_shuffle(spark, sf):
    return smp.shuffle(fx.cases(spark, sf).select("identifier"))


@query("sample_n")
def q_sample_n(spark, sf):
    return smp.sample_n(fx.cases(spark, sf).select("identifier", "class"), 20)


@query("sample_per_class")
def q_sample_per_class(spark, sf):
    return smp.sample_per_class(fx.cases(spark, sf).select("identifier", "class"), 0.004)


@query("sample_weighted")
def q_sample_weighted(spark, sf):
    return smp.sample_weighted(fx.cases(spark, sf).select("identifier", "n_chars"), "n_chars", 20)


@query("stratified_split")
def q_stratified_split(spark, sf):
    return split_cases(spark, sf).select("identifier", "class", "split")


@query("first_k_sentences")
def q_first_k_sentences(spark, sf):
    s = tx.sentences(F.col("description"))
    return viable(spark, sf).select("identifier", F.array_join(F.slice(s, 1, 10), "\n").alias("lead"),
                                    F.least(F.size(s), F.lit(10)).cast("int").alias("n"))


@query("argmax_topic")
def q_argmax_topic(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", tx.argmax("embedding").alias("topic"))


@query("keep_last_k")
def q_keep_last_k(spark, sf):
    return smp.keep_last_k(fx.curves(spark, sf), 3)


@query("cumsum")
def q_cumsum(spark, sf):
    out = smp.cumsum(fx.curves(spark, sf), "n", "epoch", ["run"], "cum_n")
    return out.withColumn("cum_n", F.col("cum_n").cast("bigint"))


@query("row_index")
def q_row_index(spark, sf):
    c = fx.curves(spark, sf)
    # the training curve's axis counts from 0, the validation curve's from 1
    c = smp.row_index(c, "epoch", ["run"], start=0, out="train_epoch")
    c = smp.row_index(c, "epoch", ["run"], start=1, out="val_epoch")
    return c.select("run", "epoch", "train_epoch", "val_epoch")


@query("sort")
def q_sort(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.orderBy("source", "doc_id")


# --- 2.7 scalar functions and text preparation -----------------------------


@query("pipes_to_space")
def q_pipes_to_space(spark, sf):
    return fx.cases(spark, sf).select("identifier", tx.pipes_to_space("missing_parts").alias("parts_spaced"))


@query("word_count")
def q_word_count(spark, sf):
    return fx.cases(spark, sf).select("identifier", tx.word_count("summary").alias("summary_words"),
                                      tx.word_count("description").alias("desc_words"))


def _digest(arr, sep=" "):
    return F.md5(F.array_join(arr, sep))


@query("tokenize")
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.let({"t": tx.tokenize("text")}, lambda v: F.struct(
        F.size(v["t"]).cast("bigint").alias("n_tokens"), _digest(v["t"]).alias("tokens_md5"))).alias("r")) \
        .select("doc_id", "r.*")


@query("tokenize_nostop")
def q_tokenize_nostop(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.let({"t": tx.tokenize_nostop("text", "lang")}, lambda v: F.struct(
        F.size(v["t"]).cast("bigint").alias("n_tokens"), _digest(v["t"]).alias("tokens_md5"))).alias("r")) \
        .select("doc_id", "r.*")


@query("sentences")
def q_sentences(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.let({"s": tx.sentences("text")}, lambda v: F.struct(
        F.size(v["s"]).cast("bigint").alias("n_sentences"), _digest(v["s"], "\n").alias("sentences_md5")))
        .alias("r")).select("doc_id", "r.*")


@query("strip_markers")
def q_strip_markers(spark, sf):
    return fx.pairs(spark, sf).select("conv_id", "turn", tx.strip_markers("c_summary").alias("hyp"))


@query("id_fields")
def q_id_fields(spark, sf):
    f = tx.id_fields("identifier")
    return fx.cases(spark, sf).select("identifier", *[F.element_at(f, i).alias(f"f{i}") for i in range(1, 6)])


@query("round4")
def q_round4(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / 3, 4).alias("v4"))


@query("round2")
def q_round2(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / 7, 2).alias("v2"))


@query("array_join_tags")
def q_array_join_tags(spark, sf):
    return fx.cases(spark, sf).select("identifier", F.array_join(F.slice(tx.id_fields("identifier"), 2, 2), "|")
                                      .alias("tags"))


@query("array_pos")
def q_array_pos(spark, sf):
    return fx.cases(spark, sf).select("identifier", F.element_at(tx.id_fields("identifier"), 4).alias("year"))


@query("array_distinct")
def q_array_distinct(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.array_distinct(tx.tokenize("text"))).cast("bigint").alias("n_types"))


@query("softmax")
def q_softmax(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", tx.let({"p": tx.softmax("embedding")}, lambda v: F.struct(
        F.round(F.array_max(v["p"]), 6).alias("p_max"), F.round(F.element_at(v["p"], 1), 6).alias("p_first")))
        .alias("r")).select("vec_id", "r.*")


def _halves(c):
    a = F.transform(F.slice(F.col(c), 1, 32), lambda x: F.abs(x).cast("double"))
    b = F.transform(F.slice(F.col(c), 33, 32), lambda x: F.abs(x).cast("double"))
    return a, b


@query("js_distance")
def q_js_distance(spark, sf):
    a, b = _halves("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(tx.js_distance(a, b), 6).alias("js"))


@query("ngrams")
def q_ngrams(spark, sf):
    w = rg.rouge_words("ref")
    return fx.pairs(spark, sf).select(
        "conv_id", "turn", tx.let({"w": w}, lambda v: F.struct(
            F.size(F.array_distinct(tx.ngrams(v["w"], 1))).cast("bigint").alias("n_uni"),
            F.size(F.array_distinct(tx.ngrams(v["w"], 2))).cast("bigint").alias("n_bi"))).alias("r")
    ).select("conv_id", "turn", "r.*")


# --- 2.8 document metrics ----------------------------------------------------
@query("length_features")
def q_length_features(spark, sf):
    f = mt.length_features(mt.prepare(viable(spark, sf)))
    out = f.select("identifier", "sum_words", "sum_sents", "desc_words", "desc_sents", "cmp_words", "cmp_sents")
    return flt.with_sentinels(out, ["cmp_words", "cmp_sents"])


@query("length_features_text")
def q_length_features_text(spark, sf):
    f = mt.length_features_text(mt.prepare(viable(spark, sf), summary=None))
    return f.select("identifier", "desc_words", "desc_sents")


@query("abstractivity")
def q_abstractivity(spark, sf):
    p = mt.prepare(viable(spark, sf))
    return flt.with_sentinels(p.select("identifier", mt.abstractivity().alias("abstractivity")), ["abstractivity"])


@query("redundancy_ttr")
def q_redundancy_ttr(spark, sf):
    v = flt.viable_filter(fx.cases(spark, sf), keep=("class",))
    t = tx.tokenize_nostop(tx.pipes_to_space("description"), "class")
    return flt.with_sentinels(v.select("identifier", mt.redundancy_ttr(t).alias("redundancy")), ["redundancy"])


@query("coherence")
def q_coherence(spark, sf):
    p = mt.prepare(viable(spark, sf))
    return p.select("identifier", mt.coherence(F.col("s_sent")).alias("semantic_coherence"))


def continuation_examples(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.sentences("text").alias("sents"))
    return ct.examples(d, "doc_id", "sents")


def continuation_scorer(spark, sf):
    """The sentence-continuation scorer of the documents, fitted once for all queries on the same files."""
    return ct.stored_fit(spark, [f"{sf}/documents.parquet"], lambda: continuation_examples(spark, sf), steps=ct.STEPS)


@query("coherence_learned")
def q_coherence_learned(spark, sf):
    """Mean learned continuation score over the summary's neighbouring sentences (``coherence`` has the scorer that SQL can express)."""
    p = mt.prepare(viable(spark, sf))
    score = ct.coherence(spark, *continuation_scorer(spark, sf))
    return p.select("identifier", score(F.col("s_sent")).alias("semantic_coherence"))


@query("coherence_scorer_quality")
def q_coherence_scorer_quality(spark, sf):
    """Held-out area under the curve of the learned scorer and of the share of common words."""
    return ct.evaluate(continuation_examples(spark, sf), *continuation_scorer(spark, sf))


@query("coherence_top10")
def q_coherence_top10(spark, sf):
    p = mt.prepare(viable(spark, sf), summary=None)
    return p.select("identifier", mt.coherence(F.col("d_sent"), first_k=10).alias("semantic_coherence"))


@query("unigram_similarity")
def q_unigram_similarity(spark, sf):
    p = mt.prepare(viable(spark, sf))
    return flt.with_sentinels(p.select("identifier", mt.unigram_similarity().alias("topic_similarity")),
                              ["topic_similarity"])


@query("rouge_n")
def q_rouge_n(spark, sf):
    p = fx.pairs(spark, sf).withColumn("hyp", tx.strip_markers("c_summary"))
    return p.select("conv_id", "turn", F.round(rg.rouge_n("hyp", "ref", 1), 6).alias("rouge1"),
                    F.round(rg.rouge_n("hyp", "ref", 2), 6).alias("rouge2"))


# --- 2.4 joins and set operations --------------------------------------------


def test_split(spark, sf):
    return split_cases(spark, sf).where(F.col("split") == "test")


@query("split_join")
def q_split_join(spark, sf):
    v = flt.viable_filter(fx.cases(spark, sf), keep=("class",))
    split_map = smp.stratified_split(v.select("identifier", "class")).select("identifier", "split")
    return jn.split_join(v, split_map)


@query("reference_lookup")
def q_reference_lookup(spark, sf):
    gen = fx.generated(spark, sf).where(F.col("model") == "full").select("identifier", "c_summary")
    refs = test_split(spark, sf).select("identifier", "summary", "class")
    return jn.reference_lookup(gen, refs)


@query("eval_sheet_full")
def q_eval_sheet_full(spark, sf):
    return jn.eval_sheet_full(test_split(spark, sf), fx.generated(spark, sf))


@query("eval_sheet_cluster")
def q_eval_sheet_cluster(spark, sf):
    return jn.eval_sheet_cluster(test_split(spark, sf), fx.generated(spark, sf))


def label_centres(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, cl.centres_by_label(e, "embedding", "label", 64)


def fixed_assignments(spark, sf):
    e, centres = label_centres(spark, sf)
    return cl.assign_to_centres(e, "embedding", centres)


@query("kmeans_assign_step")
def q_kmeans_assign_step(spark, sf):
    a = fixed_assignments(spark, sf)
    return a.select("vec_id", F.col("class").alias("center"), F.round("dist", 6).alias("dist"))


@query("predictions_concat")
def q_predictions_concat(spark, sf):
    return fixed_assignments(spark, sf).select("vec_id", "label", "class")


@query("class_counts")
def q_class_counts(spark, sf):
    return agg.class_counts(fixed_assignments(spark, sf))


@query("curve_align")
def q_curve_align(spark, sf):
    return jn.curve_align(fx.curves(spark, sf), runs=fx.CURVE_RUNS)


@query("score_align_outer")
def q_score_align_outer(spark, sf):
    return jn.score_align_outer(fx.eval_scores(spark, sf), fx.SCORE_COLUMNS)


@query("token_semi")
def q_token_semi(spark, sf):
    p = mt.prepare(viable(spark, sf))
    return p.select("identifier", tx.let({"k": jn.token_semi(F.col("s_tok"), F.col("d_tok"))}, lambda v: F.struct(
        F.size(v["k"]).cast("bigint").alias("n_shared"), _digest(v["k"]).alias("shared_md5"))).alias("r")) \
        .select("identifier", "r.*")


def doc_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.tokenize("text").alias("tokens"))


def fixed_vocab(spark, sf):
    """The unpruned vocabulary of another table: unknown tokens arise by themselves."""
    b = table(spark, sf, "benchmark").select("item_id", tx.tokenize("text").alias("tokens"))
    return vc.vocabulary(b, "item_id", "tokens", min_df=1)


@query("token_anti")
def q_token_anti(spark, sf):
    toks = jn.explode_tokens(doc_tokens(spark, sf), "doc_id", "tokens")
    dropped = jn.keep_in_vocabulary(toks, fixed_vocab(spark, sf), "left_anti")
    return dropped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_dropped"))


@query("sentence_pairs")
def q_sentence_pairs(spark, sf):
    p = mt.prepare(viable(spark, sf), summary=None)
    return p.select("identifier", jn.equal_pair_stats(F.col("d_sent")).alias("r")).select(
        "identifier", "r.n_sentences", "r.n_pairs", "r.n_equal_pairs")


@query("sentence_pairs_unequal")
def q_sentence_pairs_unequal(spark, sf):
    p = mt.prepare(viable(spark, sf), summary=None)
    return p.select("identifier", jn.equal_pair_stats(F.col("d_sent")).alias("r")).select(
        "identifier", "r.n_ordered_unequal_pairs")


@query("adjacent_pairs")
def q_adjacent_pairs(spark, sf):
    return jn.adjacent_pairs(mt.prepare(viable(spark, sf)), "identifier", "s_sent")


@query("union_files")
def q_union_files(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    u = union_files(spark, [d, b])
    return u.select("origin", "id", F.md5("text").alias("text_md5"))


# --- 2.5 (continued): evaluation roll-ups ----------------------------------------
def rouge_scores(spark, sf, model: str):
    """R1/R2 F of generated summaries against the reference summary, test split."""
    t = test_split(spark, sf).select("identifier", "summary", "class")
    g = fx.generated(spark, sf)
    if model == "full":
        g = g.where(F.col("model") == "full").select("identifier", "c_summary")
        j = t.join(g, "identifier")
    else:
        j = t.join(g, [t.identifier == g.identifier, t["class"] == g.model]).drop(g.identifier)
    j = j.withColumn("hyp", tx.strip_markers("c_summary"))
    return j.select("identifier", "class", rg.rouge_n("hyp", "summary", 1).alias("rouge1"),
                    rg.rouge_n("hyp", "summary", 2).alias("rouge2"))


@query("rouge_means")
def q_rouge_means(spark, sf):
    return agg.rouge_means(rouge_scores(spark, sf, "full"), ["rouge1", "rouge2"])


@query("rouge_means_by_class")
def q_rouge_means_by_class(spark, sf):
    return agg.rouge_means(rouge_scores(spark, sf, "cluster"), ["rouge1", "rouge2"], by=["class"])


@query("weighted_combine")
def q_weighted_combine(spark, sf):
    means = agg.rouge_means(rouge_scores(spark, sf, "cluster"), ["rouge1", "rouge2"], by=["class"])
    sizes = split_cases(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    return agg.weighted_combine(means, sizes, "class", ["rouge1_mean", "rouge2_mean"])


@query("split_dimensions")
def q_split_dimensions(spark, sf):
    return agg.split_dimensions(split_cases(spark, sf))


# --- 2.9 learned tables (SQL-checkable parts) ------------------------------------
@query("vocabulary")
def q_vocabulary(spark, sf):
    return vc.vocabulary(doc_tokens(spark, sf), "doc_id", "tokens", min_df=1)


@query("doc_term_counts")
def q_doc_term_counts(spark, sf):
    return vc.doc_term_counts(doc_tokens(spark, sf), "doc_id", "tokens", fixed_vocab(spark, sf))


def encoded(spark, sf, max_len=1024):
    ids = vc.encode_ids(doc_tokens(spark, sf), "doc_id", "tokens", fixed_vocab(spark, sf), max_len)
    return ids.select("doc_id", vc.pad(F.col("ids"), max_len).alias("e")).select("doc_id", "e.*")


@query("encode_pad")
def q_encode_pad(spark, sf):
    """Training inputs of the viable cases: description ids truncated/padded to
    1024 with an attention mask, summary ids (the labels) to 256.  Both texts go
    through one explode/lookup/regroup, tagged by part."""
    lengths = {"ids": 1024, "labels": 256}
    v = viable(spark, sf).select(
        "identifier", F.explode(F.array(
            F.struct(F.lit("ids").alias("part"), tx.tokenize(tx.pipes_to_space("description")).alias("tokens")),
            F.struct(F.lit("labels").alias("part"), tx.tokenize(tx.pipes_to_space("summary")).alias("tokens"))))
        .alias("p")).select("identifier", "p.part", "p.tokens")
    # truncate each part to its own length before the shared encoding
    v = v.withColumn("tokens", F.when(F.col("part") == "ids", F.slice("tokens", 1, lengths["ids"]))
                     .otherwise(F.slice("tokens", 1, lengths["labels"])))
    ids = vc.encode_ids(v, ["identifier", "part"], "tokens", fixed_vocab(spark, sf), max(lengths.values()))
    n = F.when(F.col("part") == "ids", F.lit(lengths["ids"])).otherwise(F.lit(lengths["labels"]))
    e = ids.select("identifier", "part", vc.pad(F.col("ids"), n).alias("e"))
    stats = e.select("identifier", "part", F.size("e.input_ids").cast("bigint").alias("n"),
                     F.aggregate("e.attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
                     F.md5(F.array_join(F.col("e.input_ids").cast("array<string>"), " ")).alias("md5"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return stats.groupBy("identifier").agg(
        pick("ids", "n").alias("n_ids"), pick("ids", "n_real").alias("n_ids_real"), pick("ids", "md5").alias("ids_md5"),
        pick("labels", "n").alias("n_labels"), pick("labels", "n_real").alias("n_labels_real"),
        pick("labels", "md5").alias("labels_md5"))


@query("mask_examples")
def q_mask_examples(spark, sf):
    """Masked-language-model examples: how many positions were masked, replaced and kept, and digests of inputs and labels."""
    n_vocab = fixed_vocab(spark, sf).count()
    e = encoded(spark, sf)
    m = e.select("doc_id", vc.mask_ids(F.col("input_ids"), F.col("doc_id"), n_vocab).alias("m")).select("doc_id", "m.*")
    both = F.zip_with("masked", "labels", lambda x, y: F.when(y == vc.IGNORE, F.lit(0)).when(x == vc.MASK_ID, F.lit(1)).when(x == y, F.lit(3)).otherwise(F.lit(2)))
    n = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("bigint")
    return m.withColumn("kinds", both).select(
        "doc_id", n(1).alias("n_masked"), n(2).alias("n_replaced"), n(3).alias("n_kept"),
        F.md5(F.array_join(F.col("masked").cast("array<string>"), " ")).alias("masked_md5"),
        F.md5(F.array_join(F.col("labels").cast("array<string>"), " ")).alias("labels_md5"))


@query("assignment_audit")
def q_assignment_audit(spark, sf):
    stored_path = fresh_dir(spark, "cluster-map")
    fixed_assignments(spark, sf).select("vec_id", "class").write.parquet(stored_path)
    stored = spark.read.parquet(stored_path)
    e, centres = label_centres(spark, sf)
    again = cl.assign_to_centres(e, "embedding", centres)
    return cl.audit(stored, again, "vec_id")


# --- 2.1 sources, 2.2 sinks --------------------------------------------------


def built_archives(spark, sf):
    """Month archives derived from the cases table, written to a fresh shared folder."""
    root = fresh_dir(spark, "archives")
    ar.write_archives(ar.case_xml(fx.cases(spark, sf)), root)
    return root


def parsed_cases(spark, sf):
    return ar.parse_cases(ar.archive_explode(spark, built_archives(spark, sf)))


@query("archive_scan")
def q_archive_scan(spark, sf):
    return ar.archive_scan(spark, built_archives(spark, sf)).orderBy("year", "name")


@query("archive_explode")
def q_archive_explode(spark, sf):
    return ar.archive_explode(spark, built_archives(spark, sf)).select(
        "year", "month", "member", F.md5("xml").alias("xml_md5"))


@query("xml_single_tags")
def q_xml_single_tags(spark, sf):
    return ar.with_none(parsed_cases(spark, sf).select("identifier", *[k for k in ar.SINGLE_TAGS if k != "identifier"]))


@query("xml_multi_tags")
def q_xml_multi_tags(spark, sf):
    return ar.with_none(parsed_cases(spark, sf).select("identifier", *ar.MULTI_TAGS))


@query("text_fallback")
def q_text_fallback(spark, sf):
    p = parsed_cases(spark, sf)
    return p.select("identifier", "missing_parts", F.md5("description").alias("description_md5"),
                    F.coalesce(tx.word_count("description"), F.lit(0)).cast("bigint").alias("desc_words"))


@query("xml_dates")
def q_xml_dates(spark, sf):
    ev = table(spark, sf, "events")
    raw = ev.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("judgment_raw"),
                    F.col("props").alias("issue_raw"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_raw"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return raw.select("event_id",
                      fmt(F.try_to_timestamp("judgment_raw", F.lit(ar.DATE_FMT))).alias("judgment_date"),
                      fmt(F.try_to_timestamp("issue_raw", F.lit(ar.DATE_FMT))).alias("issue_date"),
                      fmt(F.try_to_timestamp("modified_raw", F.lit(ar.DATETIME_FMT))).alias("modified"))


# HTML cleanup patterns (dropped blocks, tags, whitespace) and entities.
HTML_DROP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
HTML_TAG = r"<[^>]*>"
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(c):
    x = F.regexp_replace(F.regexp_replace(c, HTML_DROP, " "), HTML_TAG, " ")
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), EDGE, "")


EDGE = tx.EDGE_SPACE


@query("markup_to_text")
def q_markup_to_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.let({"t": html_text(F.col("html"))}, lambda v: F.struct(
        F.length(v["t"]).cast("bigint").alias("n_chars"), F.md5(v["t"]).alias("text_md5"))).alias("r")) \
        .select("page_id", "r.*")


@query("missing_flag")
def q_missing_flag(spark, sf):
    c = fx.cases(spark, sf)
    flag = F.concat_ws("|", F.when(F.col("summary") == "none", F.lit("summary")),
                       F.when(F.col("description") == "none", F.lit("description")))
    return c.select("identifier", F.coalesce(F.nullif(flag, F.lit("")), F.lit("none")).alias("missing_flag"))


@query("parquet_scan")
def q_parquet_scan(spark, sf):
    return tb.parquet_scan(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


@query("repartition_by_size")
def q_repartition_by_size(spark, sf, target_mb: float = 100.0):
    """Re-cut to about target_mb per partition from the on-disk size of the input."""
    path = f"{sf}/documents.parquet"
    size = (spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]) or 0
    n = max(1, -(-int(size) // int(target_mb * 1e6)))
    d = spark.read.parquet(path).repartition(n)
    return d.select("doc_id", F.spark_partition_id().alias("partition"), F.lit(n).alias("n_partitions"))


CASES_CSV_SCHEMA = "row_index long, identifier string, class string, n_chars long"


@query("csv_write")
def q_csv_write(spark, sf):
    path = fresh_dir(spark, "csv")
    wr.csv_write(fx.cases(spark, sf).select(F.col("doc_id").alias("row_index"), "identifier", "class", "n_chars"), path)
    return spark.read.option("header", True).schema(CASES_CSV_SCHEMA).csv(path)


@query("csv_scan")
def q_csv_scan(spark, sf):
    path = fresh_dir(spark, "csv")
    wr.csv_write(fx.cases(spark, sf).select(F.col("doc_id").alias("row_index"), "identifier", "class", "n_chars"), path)
    return tb.csv_scan(spark, path, CASES_CSV_SCHEMA, drop=["row_index"], multi_line=False)


@query("curve_scan")
def q_curve_scan(spark, sf):
    root = fresh_dir(spark, "curves")
    c = fx.curves(spark, sf)
    tags = F.explode(F.array(F.lit("train_loss"), F.lit("eval_loss")))
    (c.select("run", tags.alias("tag"), F.col("n").cast("double").alias("wall_time"),
              F.col("epoch").cast("bigint").alias("step"), F.col("loss").alias("value"))
     .write.partitionBy("run", "tag").option("header", True).csv(root))
    return tb.curve_scan(spark, root)


@query("text_column_source")
def q_text_column_source(spark, sf):
    return tb.text_column_source(spark, f"{sf}/documents.parquet", "text")


@query("generated_scan")
def q_generated_scan(spark, sf):
    root = fresh_dir(spark, "generated")
    g = fx.generated(spark, sf)
    g.write.partitionBy("model").parquet(root)
    models = [r[0] for r in spark.read.parquet(root).select("model").distinct().collect()]
    mapping = {m: f"{root}/model={m}" for m in models}
    return tb.generated_scan(spark, mapping)


@query("write_per_archive")
def q_write_per_archive(spark, sf):
    path = fresh_dir(spark, "raw-cases")
    wr.write_per_archive(parsed_cases(spark, sf), path)
    # partition discovery reads "08" back as a number; restore the archive's text form
    back = spark.read.parquet(path).select(F.col("year").cast("string").alias("year"),
                                           F.lpad(F.col("month").cast("string"), 2, "0").alias("month"))
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("size_balanced_chunks")
def q_size_balanced_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return wr.size_balanced_chunks(d, "n_chars", "doc_id", 4).select("doc_id", "chunk")


@query("shuffled_chunk_write")
def q_shuffled_chunk_write(spark, sf):
    path = fresh_dir(spark, "interim")
    c = wr.shuffled_chunks(fx.cases(spark, sf), "identifier", 10)
    wr.write_chunks(flt.viable_filter(c, keep=("chunk",)), path)
    return spark.read.parquet(path).select("identifier", "chunk")


@query("split_write")
def q_split_write(spark, sf):
    path = fresh_dir(spark, "splits")
    wr.split_write(split_cases(spark, sf), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_split_write")
def q_cluster_split_write(spark, sf):
    path = fresh_dir(spark, "cluster-splits")
    wr.cluster_split_write(split_cases(spark, sf), path)
    return spark.read.parquet(path).groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))


@query("format_compare")
def q_format_compare(spark, sf):
    return wr.format_compare(fx.cases(spark, sf), fresh_dir(spark, "formats"))


# --- 2.8 metrics with Python inner loops (Arrow batches) -----------------------


@query("fragments")
def q_fragments(spark, sf):
    p = mt.prepare(viable(spark, sf))
    f = tb.spread(p.select("identifier", "s_tok", "d_tok")).select("identifier", fr.fragments("s_tok", "d_tok").alias("frags"))
    return f.select("identifier", F.size("frags").cast("bigint").alias("n_fragments"),
                    F.aggregate("frags", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)).alias("n_tokens"),
                    F.md5(F.array_join(F.transform("frags", lambda x: F.array_join(x, " ")), "|")).alias("frags_md5"))


@query("redundancy_rouge")
def q_redundancy_rouge(spark, sf):
    p = mt.prepare(viable(spark, sf))
    out = tb.spread(p.select("identifier", "s_sent")).select("identifier", rg.redundancy_rouge("s_sent").alias("redundancy"))
    return flt.with_sentinels(out, ["redundancy"])


@query("redundancy_ordered")
def q_redundancy_ordered(spark, sf):
    p = mt.prepare(viable(spark, sf), summary=None)
    out = tb.spread(p.select("identifier", "d_sent")).select("identifier", rg.redundancy_ordered("d_sent").alias("redundancy"))
    return flt.with_sentinels(out, ["redundancy"])


@query("rouge_l")
def q_rouge_l(spark, sf):
    p = fx.pairs(spark, sf).withColumn("hyp", tx.strip_markers("c_summary"))
    return tb.spread(p.select("conv_id", "turn", "hyp", "ref")).select("conv_id", "turn", F.round(rg.rouge_l("hyp", "ref"), 6).alias("rouge_l"))


# --- 2.9 topic model, k-means, mixtures ----------------------------------------

CLUSTER_FEATURES = ["topic_class", "redundancy", "semantic_coherence", "desc_words", "desc_sents"]


def lda_docs(spark, sf):
    v = flt.viable_filter(fx.cases(spark, sf), keep=("class",))
    return tp.text_tokens(v, "description", "class")


def lda_blocks(spark, sf):
    return tp.doc_blocks(lda_docs(spark, sf))


def lda_model(spark, sf, blocks=None):
    """The topic model of the descriptions, fitted once for all queries on the same files (``blocks``: theirs, if they are stored already)."""
    return tp.stored_fit(spark, [f"{sf}/documents.parquet"], lambda: lda_blocks(spark, sf) if blocks is None else blocks, k=5, seed=42)


def clustering_features(spark, sf):
    """clustering_feature: topic class of the text, type-token redundancy, coherence
    of the first 10 sentences, text words and sentences (999 where undefined)."""
    docs = lda_docs(spark, sf)
    blocks = lda_blocks(spark, sf)  # once, for the fit and for what it says of them
    t = tp.topic_distribution(lda_model(spark, sf, blocks), blocks).select("identifier", tp.topic_class("topics").alias("topic_class"))
    p = mt.length_features_text(mt.prepare(docs, summary=None))
    # numbers only go through the join, no tokens or sentences
    p = p.select("identifier", mt.redundancy_ttr(F.col("tokens")).alias("redundancy"),
                 mt.coherence(F.col("d_sent"), first_k=10).alias("semantic_coherence"), "desc_words", "desc_sents")
    return flt.with_sentinels(p.join(t, "identifier").select("identifier", *CLUSTER_FEATURES), ["redundancy"])


@query("lda_fit")
def q_lda_fit(spark, sf):
    model = lda_model(spark, sf)
    n, perplexity = tp.log_perplexity(model, lda_blocks(spark, sf))
    return spark.createDataFrame([(model.k, n, perplexity)], "k int, vocab_size int, log_perplexity double")


@query("lda_topics")
def q_lda_topics(spark, sf):
    return tp.lda_topics(lda_model(spark, sf), 10)


@query("topic_distribution")
def q_topic_distribution(spark, sf):
    return tp.topic_distribution(lda_model(spark, sf), lda_blocks(spark, sf))


@query("topic_class")
def q_topic_class(spark, sf):
    t = tp.topic_distribution(lda_model(spark, sf), lda_blocks(spark, sf))
    return t.select("identifier", tp.topic_class("topics").alias("topic_class"))


@query("topic_similarity")
def q_topic_similarity(spark, sf):
    model = lda_model(spark, sf)
    summ = tp.text_tokens(lda_docs(spark, sf).drop("tokens"), "summary", "class")
    ts = tp.topic_distribution(model, tp.doc_blocks(summ)).select("identifier", F.col("topics").alias("s_topics"))
    td = tp.topic_distribution(model, lda_blocks(spark, sf)).select("identifier", F.col("topics").alias("d_topics"))
    return ts.join(td, "identifier").select("identifier", tp.topic_similarity("s_topics", "d_topics")
                                            .alias("topic_similarity"))


def cluster_input(spark, sf):
    """Assembled features, checkpointed to the shared folder: the iterative fits
    that follow re-read it many times, and a lost executor then re-reads the
    checkpoint instead of recomputing the topic model."""
    shared_dir(spark, "")  # makes sure a checkpoint folder is set
    return cl.assemble(clustering_features(spark, sf), CLUSTER_FEATURES).checkpoint(eager=True)


@query("kmeans_fit_assign")
def q_kmeans_fit_assign(spark, sf):
    return cl.kmeans_fit_assign(cluster_input(spark, sf), k=6, seed=0).select("identifier", "class")


@query("kmeans_elbow")
def q_kmeans_elbow(spark, sf):
    pts = cl.elbow(cluster_input(spark, sf), range(1, 12), seed=0)
    best = cl.knee(pts)
    return spark.createDataFrame([(k, v, k == best) for k, v in pts], "k int, distortion double, is_elbow boolean")


@query("gmm_fit_assign")
def q_gmm_fit_assign(spark, sf):
    return mx.gmm_fit_assign(cluster_input(spark, sf), k=6, seed=0).select("identifier", "class")


@query("gmm_bic_sweep")
def q_gmm_bic_sweep(spark, sf):
    x = clustering_features(spark, sf).select(F.array(*[F.col(c).cast("double") for c in CLUSTER_FEATURES]).alias("x"))
    configs = [(k, c) for c in ("tied", "diag", "full") for k in range(1, 10)]
    fits = mx.em_sweep(x, configs, seed=0)
    best = min(fits, key=lambda f: f["bic"])
    return spark.createDataFrame(
        [(f["k"], f["covariance_type"], float(f["bic"]), float(f["mean_loglik"]), f["n_iter"], f is best) for f in fits],
        "n_components int, covariance_type string, bic double, mean_loglik double, n_iter int, is_best boolean")


@query("model_store")
def q_model_store(spark, sf):
    from pyspark.ml.clustering import KMeansModel
    data = cluster_input(spark, sf)
    model = cl.kmeans_fit(data, k=6, seed=0)
    path = fresh_dir(spark, "kmeans-model")
    model.write().overwrite().save(path)
    loaded = KMeansModel.load(path)
    a = model.transform(data).select("identifier", F.col("class").alias("saved_class"))
    b = loaded.transform(data).select("identifier", F.col("class").alias("loaded_class"))
    return a.join(b, "identifier")


# --- 2.9 subword vocabulary, batch apply ----------------------------------------

def subword_vocabulary(spark, sf):
    """The 25,000-entry vocabulary of the documents, learned once for all queries on the same files."""
    source = f"{sf}/documents.parquet"
    return sw.stored_vocabulary(spark, [source], lambda: tb.text_column_source(spark, source, "text"))


@query("bpe_vocabulary")
def q_bpe_vocabulary(spark, sf):
    return subword_vocabulary(spark, sf).select("id", "kind", "token", "left", "right", "count")


@query("encode_pad_subword")
def q_encode_pad_subword(spark, sf):
    """Training inputs of the viable cases with learned subwords: descriptions cut and padded to 1024 ids, summaries to 256."""
    v = viable(spark, sf).select("identifier", "description", "summary")
    e = sw.encode_pad(v, {"ids": ("description", 1024), "labels": ("summary", 256)}, *sw.load_vocabulary(subword_vocabulary(spark, sf)))
    of = lambda c: [F.size(F.col(c)["input_ids"]).cast("bigint").alias(f"n_{c}"),
                    F.aggregate(F.col(c)["attention_mask"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias(f"n_{c}_real"),
                    F.md5(F.array_join(F.col(c)["input_ids"].cast("array<string>"), " ")).alias(f"{c}_md5")]
    return e.select("identifier", *of("ids"), *of("labels"))


def lead_summary(texts: pd.Series, max_words: int = 150) -> pd.Series:
    """Default text->text function: leading sentences up to ``max_words`` words."""
    import re as _re
    out = []
    for t in texts:
        words, picked = 0, []
        for s in _re.findall(r"[^.!?]+[.!?]*", t or ""):
            s = s.strip()
            n = len(s.split())
            if not s:
                continue
            if picked and words + n > max_words:
                break
            picked.append(s)
            words += n
        out.append("</s><s>" + " ".join(picked) + "</s>")
    return pd.Series(out)


def batch_apply(df, fn=lead_summary, id_col="identifier", text_col="description"):
    """Apply a text->text function to every row in Arrow batches; (identifier, c_summary)."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "c_summary": fn(pdf[text_col])})
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} string, c_summary string")




@query("batch_apply")
def q_batch_apply(spark, sf):
    return batch_apply(test_split(spark, sf))


# --- 2.10 streaming ---------------------------------------------------------------
@query("incremental_ingest")
def q_incremental_ingest(spark, sf):
    root = built_archives(spark, sf)
    out, ck = fresh_dir(spark, "stream-raw"), fresh_dir(spark, "stream-raw-ckpt")
    inc.incremental_ingest(spark, root, out, ck)
    return spark.read.parquet(out).select("identifier", F.col("year").cast("string").alias("year"),
                                          F.lpad(F.col("month").cast("string"), 2, "0").alias("month"),
                                          "missing_parts")


def replaced_ingest(spark, sf):
    """Archives delivered twice: first with every third month in an older state (no summaries), then as they are; both
    deliveries are taken in by one stream, which is started again in between."""
    root, out, ck = fresh_dir(spark, "deliveries"), fresh_dir(spark, "replaced"), fresh_dir(spark, "replaced-ckpt")
    xml = ar.case_xml(fx.cases(spark, sf))
    old = F.regexp_replace("xml", f"(?s)<{ar.SUMMARY_TAG}>.*</{ar.SUMMARY_TAG}>", "")
    ar.write_archives(xml.withColumn("xml", F.when(F.col("month").cast("int") % 3 == 0, old).otherwise(F.col("xml"))), f"{root}/first")
    rpl.ingest(spark, root, out, ck)
    ar.write_archives(xml, f"{root}/second")
    rpl.ingest(spark, root, out, ck)
    return out


@query("incremental_replacement")
def q_incremental_replacement(spark, sf):
    return rpl.current_rows(spark, replaced_ingest(spark, sf)).select(
        "identifier", F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), "missing_parts")


CASES_SCHEMA = "doc_id long, identifier string, summary string, description string, missing_parts string, " \
               "class string, n_chars long"


@query("incremental_decade_rollup")
def q_incremental_decade_rollup(spark, sf):
    chunks = fresh_dir(spark, "case-chunks")
    wr.write_chunks(wr.shuffled_chunks(fx.cases(spark, sf), "identifier", 10), chunks)
    out, ck = fresh_dir(spark, "stream-decades"), fresh_dir(spark, "stream-decades-ckpt")
    inc.incremental_decade_rollup(spark, chunks, CASES_SCHEMA, out, ck)
    return spark.read.parquet(out)

"""Joins and set operations.

Joins are written as plain equi-joins and left to Spark's planner: AQE turns
a side that turns out small into a broadcast at run time and splits skewed
partitions.  An explicit ``broadcast`` is used only for tables whose size is
bounded by construction (one row per class or run) or checked first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx

# Largest lookup table that is broadcast, in bytes of its keys and rows as measured.
LOOKUP_BYTES = 64 << 20
# Beyond it, a token is hot if it is on at least this share of all positions, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def lookup(tokens: DataFrame, table: DataFrame, how: str = "inner", key: str = "token", most_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Join exploded tokens with a lookup table of any size on ``key`` (inner, left, left_semi or left_anti).

    A table measured to take at most ``most_bytes`` is broadcast.  Beyond that only
    its rows of the hot tokens are (found by an exact count, summed per task
    first), so a token on a third of all positions stays in the tasks it is in;
    the other positions are shuffled to the table, where none of them is heavy.
    """
    size = table.agg(F.sum(F.octet_length(F.col(key)) + 16 * len(table.columns))).first()[0] or 0
    if size <= most_bytes:
        return tokens.join(F.broadcast(table), key, how)
    counts = tokens.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    least = (counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot = [r[key] for r in counts.where(F.col("n") >= max(1.0, least)).select(key).collect()]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = tokens.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how)
    return near.unionByName(tokens.where(~is_hot).join(table.where(~is_hot), key, how))


def split_join(cases: DataFrame, split_map: DataFrame, key: str = "identifier") -> DataFrame:
    """Documents x split map on the identifier, once, with the split as a column."""
    return cases.join(split_map, key, "inner")


def reference_lookup(generated: DataFrame, references: DataFrame, key: str = "identifier",
                     check_unique: bool = True) -> DataFrame:
    """For each generated summary its single reference summary and class.

    The reference fails unless exactly one reference row exists; here the join
    is one shuffle and uniqueness is a separate aggregate (fails loudly).
    """
    if check_unique:
        dup = references.groupBy(key).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"reference table has duplicate {key} values")
    return generated.join(references, key, "inner")


def eval_sheet_full(sample: DataFrame, generated: DataFrame, key: str = "identifier",
                    model: str = "full") -> DataFrame:
    g = generated.where(F.col("model") == model).select(
        key, tx.strip_markers("c_summary").alias("summary_full_model"))
    return sample.join(g, key, "left")


def eval_sheet_cluster(sample: DataFrame, generated: DataFrame, key: str = "identifier",
                       class_col: str = "class") -> DataFrame:
    """Attach the cluster-model summary where the model's name is the row's class."""
    g = generated.select(key, F.col("model").alias("_model"),
                         tx.strip_markers("c_summary").alias("summary_cluster_model"))
    cond = [sample[key] == g[key], sample[class_col].cast("string") == g["_model"]]
    return sample.join(g, cond, "left").drop(g[key]).drop("_model")


def curve_align(curve: DataFrame, run: str = "run", idx: str = "epoch", value: str = "loss",
                runs: list[str] | None = None) -> DataFrame:
    """Line curves up on their row index: one row per index, one column per run."""
    g = curve.groupBy(idx)
    piv = g.pivot(run, runs) if runs is not None else g.pivot(run)
    return piv.agg(F.first(value))


def score_align_outer(scores: DataFrame, cols: list[str], values=(1, 2, 3, 4, 5)) -> DataFrame:
    """Frequency of each score value per metric, outer-aligned on the value; absent -> 0."""
    spark = scores.sparkSession
    long = scores.unpivot([], cols, "metric", "score")
    cnt = long.groupBy("score").pivot("metric", cols).agg(F.count(F.lit(1)))
    grid = spark.createDataFrame([(v,) for v in values], "score int")
    out = grid.join(F.broadcast(cnt), "score", "left")
    return out.select("score", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


def token_semi(s_tok, d_tok):
    """Summary tokens (with repeats, in order) that also occur in the text; per row."""
    return tx.let({"s": s_tok, "d": d_tok}, lambda v: tx.let(
        {"s": v["s"], "shared": F.array_intersect(F.array_distinct(v["s"]), v["d"])},
        lambda w: F.filter(w["s"], lambda t: F.array_contains(w["shared"], t))))


def explode_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(tokens_col).alias("pos", "token"))


def keep_in_vocabulary(tokens: DataFrame, vocab: DataFrame, how: str = "left_semi") -> DataFrame:
    """Semi (keep) or anti (drop) join of exploded tokens against a vocabulary."""
    return lookup(tokens, vocab.select("token"), how)


def equal_pair_stats(sents):
    """Pair counts of a sentence array without forming the pairs.

    n_pairs = n(n-1)/2 unordered pairs; n_equal_pairs = pairs with identical
    text, from one pass over the sorted array; ordered pairs with different
    text = n(n-1) - 2 n_equal_pairs.  Linear memory, no self-join.
    """
    def body(v):
        s = v["s"]
        n = F.size(s).cast("bigint")
        init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("bigint").alias("run"),
                        F.lit(0).cast("bigint").alias("eq"))

        def step(acc, x):
            same = acc["prev"] == x
            return F.when(same, F.struct(acc["prev"].alias("prev"), (acc["run"] + 1).alias("run"),
                                         (acc["eq"] + acc["run"]).alias("eq"))) \
                .otherwise(F.struct(x.alias("prev"), F.lit(1).cast("bigint").alias("run"), acc["eq"].alias("eq")))
        eq = F.aggregate(F.array_sort(s), init, step, lambda acc: acc["eq"])
        return F.struct(n.alias("n_sentences"), (n * (n - 1) / 2).cast("bigint").alias("n_pairs"),
                        eq.alias("n_equal_pairs"),
                        (n * (n - 1) - 2 * eq).cast("bigint").alias("n_ordered_unequal_pairs"))
    return tx.let({"s": sents}, body)


def adjacent_pairs(df: DataFrame, id_col: str, sents_col: str) -> DataFrame:
    """(sentence i, sentence i+1) rows, built inside each row (no window, no shuffle)."""
    s = F.col(sents_col)
    zipped = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("a"),
                          F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("b"))
    z = F.when(F.size(s) >= 2, zipped)
    return (df.select(id_col, F.posexplode(z).alias("pos", "p"))
            .select(id_col, F.col("pos").cast("int").alias("pos"), F.col("p.a").alias("sentence"),
                    F.col("p.b").alias("next_sentence")))


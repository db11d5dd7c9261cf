"""Aggregations (rollups, means, frequencies, weighted combinations).

All of them are single ``groupBy``/``agg`` passes: Spark's partial aggregate
combines map-side, so the shuffle carries one row per (task, group), never the
rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.text import decade_of_id, pipes_to_space, word_count, year_of_id

DECADES = list(range(1910, 2021, 10))


def decade_counts(cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per decade (and the columns ``by``) that has rows: the counts of ``decade_rollup``."""
    sw = word_count(pipes_to_space("summary"))
    has_sum = F.col("summary") != "none"
    counts = ["cases", "complete_cases", "oneword_summaries", "short_summaries", "missing_summaries"]
    per = (cases.select(*by, decade_of_id("identifier").alias("decade"), "missing_parts", "summary",
                        sw.alias("_sw"))
           .groupBy(*by, "decade")
           .agg(F.count(F.lit(1)).alias("cases"),
                F.count_if(F.col("missing_parts") == "none").alias("complete_cases"),
                F.count_if(has_sum & (F.col("_sw") == 1)).alias("oneword_summaries"),
                F.count_if(has_sum & (F.col("_sw") > 1) & (F.col("_sw") < 10)).alias("short_summaries"),
                F.count_if(F.col("missing_parts") == "summary").alias("missing_summaries")))
    return per.select(*by, "decade", *[F.col(c).cast("bigint").alias(c) for c in counts], (
        F.col("complete_cases") - F.col("short_summaries") - F.col("oneword_summaries")).cast("bigint").alias("viable_cases"))


def decade_rollup(cases: DataFrame, decades: list[int] = DECADES) -> DataFrame:
    """Per decade: cases, complete, one-word and short summaries, missing summaries, viable.

    One-word/short count every summary that is not 'none' (so '-' is one word),
    regardless of completeness; missing counts missing_parts = 'summary' only;
    viable = complete - short - one-word.  Decades without rows give zeros.
    """
    # The decade list is a fixed 12-row frame; the aggregate has <= 12 rows.
    frame = cases.sparkSession.createDataFrame([(d,) for d in decades], "decade int")
    out = frame.join(F.broadcast(decade_counts(cases)), "decade", "left")
    return out.select("decade", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in out.columns if c != "decade"])


def year_rollup(cases: DataFrame) -> DataFrame:
    """Per year: case_count, complete_cases (missing_parts='none'), missing_desc
    (description absent), missing_sums (summary absent), short_summary (1..9 words)."""
    sw = word_count(pipes_to_space("summary"))
    return (cases.select(year_of_id("identifier").alias("current_year"), "missing_parts", "summary",
                         "description", sw.alias("_sw"))
            .groupBy("current_year")
            .agg(F.count(F.lit(1)).alias("case_count"),
                 F.count_if(F.col("missing_parts") == "none").alias("complete_cases"),
                 F.count_if(F.col("description") == "none").alias("missing_desc"),
                 F.count_if(F.col("summary") == "none").alias("missing_sums"),
                 F.count_if((F.col("summary") != "none") & (F.col("_sw") >= 1) & (F.col("_sw") < 10))
                 .alias("short_summary")))


def grand_totals(rollup: DataFrame) -> DataFrame:
    cols = [c for c in rollup.columns if c != "decade"]
    return rollup.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


def feature_means(features: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return features.agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in cols])


def class_mean_std(df: DataFrame, cols: list[str], by: str = "class", digits: int = 6) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), digits).alias(f"{c}_mean"), F.round(F.stddev_samp(c), digits).alias(f"{c}_std")]
    return df.groupBy(by).agg(*aggs)


def long_scores(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    return df.unpivot(keep or [], cols, "metric", "score")


def overall_mean_std(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return (long_scores(df, cols).groupBy("metric")
            .agg(F.round(F.avg("score"), digits).alias("mean"), F.round(F.stddev_samp("score"), digits).alias("std")))


def score_freq(df: DataFrame, cols: list[str], scores=(1, 2, 3, 4, 5)) -> DataFrame:
    """Count of each score per metric; scores that never occur give 0 (outer
    alignment on the score value, not on position)."""
    lf = long_scores(df, cols)
    piv = lf.groupBy("metric").pivot("score", list(scores)).agg(F.count(F.lit(1)))
    names = [str(s) for s in scores]
    return piv.select("metric", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(f"n_{n}") for n in names])


def score_cumfreq(df: DataFrame, cols: list[str], scores=(1, 2, 3, 4, 5)) -> DataFrame:
    """Running count across scores per metric; bar start = cum - width; and the
    largest total over metrics (the axis maximum)."""
    lf = long_scores(df, cols)
    grid = lf.select("metric").distinct().withColumn(
        "score", F.explode(F.array(*[F.lit(s).cast("int") for s in scores])))
    cnt = lf.groupBy("metric", "score").agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(cnt, ["metric", "score"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    w = W.partitionBy("metric").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    out = full.withColumn("cum", F.sum("n").over(w).cast("bigint"))
    out = out.withColumn("start", (F.col("cum") - F.col("n")).cast("bigint"))
    tot = W.partitionBy("metric")
    out = out.withColumn("total", F.sum("n").over(tot).cast("bigint"))
    return out.withColumn("max_total", F.max("total").over(W.partitionBy()).cast("bigint"))


def class_counts(pred: DataFrame, col: str = "class") -> DataFrame:
    return pred.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def split_dimensions(split_df: DataFrame, splits=("train", "validation", "test")) -> DataFrame:
    """Rows per dataset (full, or one class) x split, plus row and column sums."""
    cube = split_df.cube("class", "split").agg(F.count(F.lit(1)).alias("n"))
    ds = F.coalesce(F.col("class").cast("string"), F.lit("full"))
    piv = (cube.select(ds.alias("dataset"), F.coalesce("split", F.lit("total")).alias("split"), "n")
           .groupBy("dataset").pivot("split", list(splits) + ["total"]).agg(F.first("n")))
    return piv.select("dataset", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s)
                                   for s in list(splits) + ["total"]])


def rouge_means(scores: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    aggs = [F.round(F.avg(F.col(c) * 100), 2).alias(f"{c}_mean") for c in cols]
    return scores.groupBy(*(by or [])).agg(*aggs)


def weighted_combine(scores: DataFrame, sizes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """sum(score * size) / sum(size) over clusters, rounded to 2 digits."""
    j = scores.join(sizes, key, "inner")
    return j.agg(*[F.round(F.sum(F.col(c) * F.col("size")) / F.sum("size"), 2).alias(c) for c in cols])


def curve_bounds(curve: DataFrame, run="run", step="epoch", value="loss") -> DataFrame:
    return curve.groupBy(run).agg(F.max(step).alias("max_step"), F.max(value).alias("max_value"))


def best_checkpoint(curve: DataFrame, run="run", step="epoch", value="loss") -> DataFrame:
    return curve.groupBy(run).agg(F.min_by(step, F.struct(value, step)).alias("best_step"),
                                  F.min(value).alias("best_value"))


def weighted_curve(curve: DataFrame, run="run", idx="epoch", value="loss", weight="n") -> DataFrame:
    """Per index, sum of value x (run weight / total weight): one run's weight is
    the sum of its ``weight`` column."""
    sizes = curve.groupBy(run).agg(F.sum(weight).alias("_size"))
    # one row per run: the window over it is tiny, and so is the broadcast
    w = sizes.select(run, (F.col("_size") / F.sum("_size").over(W.partitionBy())).alias("_w"))
    j = curve.join(F.broadcast(w), run, "inner")
    return j.groupBy(idx).agg(F.round(F.sum(F.col(value) * F.col("_w")), 6).alias("weighted_loss"),
                              F.count(F.lit(1)).alias("n_runs"))


def histogram_density(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width bins over [lo, hi] (last bin closed); density = n / (N * width)."""
    width = (hi - lo) / bins if bins else 0.0
    x = df.where(F.col(col).between(lo, hi))
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.lit(lo)) / F.lit(width))).cast("int") \
        if width > 0 else F.lit(0)
    per = x.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return per.select("bin", F.col("n").cast("bigint").alias("n"),
                      F.round(F.col("n") / (total * F.lit(width if width > 0 else 1.0)), 8).alias("density"))


def fixed_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)

"""Seeded shuffles, samples and the exact stratified split.

Every random choice is ``md5('<id>:<seed>')``, so runs repeat and DuckDB can
recompute the same choice.  Global ranks use the two-pass method of
``corpuslab.operators.ranking`` and never funnel rows through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.operators.ranking import exact_rank, seeded_key


def shuffle(df: DataFrame, id_col: str = "identifier", seed: int = 42, out: str = "pos") -> DataFrame:
    """Seeded permutation: ``out`` is the row's 1-based position."""
    keyed = df.withColumn("_key", seeded_key(id_col, seed))
    return exact_rank(keyed, "_key", out=out).drop("_key")


def sample_n(df: DataFrame, n: int = 20, id_col: str = "identifier", seed: int = 42) -> DataFrame:
    """Exactly n rows (all rows if fewer): a per-partition top-n and one merge."""
    return df.withColumn("_key", seeded_key(id_col, seed)).orderBy("_key").limit(n).drop("_key")


def uniform(id_col: str, seed: int = 42) -> Column:
    """A uniform number in (0, 1) from the first 13 hex digits of the seeded md5."""
    h = F.substring(seeded_key(id_col, seed), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** 13))


def sample_weighted(df: DataFrame, weight_col: str, n: int = 20, id_col: str = "identifier",
                    seed: int = 42) -> DataFrame:
    """n rows drawn without replacement with probability proportional to weight
    (Efraimidis-Spirakis: smallest -ln(u)/w); zero weights are never drawn."""
    key = -F.log(uniform(id_col, seed)) / F.col(weight_col)
    return (df.where(F.col(weight_col) > 0).withColumn("_key", key)
            .orderBy("_key", id_col).limit(n).drop("_key"))


def class_sizes(df: DataFrame, class_col: str = "class") -> DataFrame:
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))


def sample_per_class(df: DataFrame, frac: float = 0.004, class_col: str = "class",
                     id_col: str = "identifier", seed: int = 42) -> DataFrame:
    """round-half-even(frac x class size) rows per class, seeded."""
    keyed = df.withColumn("_key", seeded_key(id_col, seed))
    ranked, sizes = exact_rank(keyed, "_key", parts=[class_col], out="_rank", with_sizes=True)
    sizes = sizes.select(class_col, F.bround(F.col("n") * frac, 0).cast("bigint").alias("_quota"))
    # One row per class: a bounded broadcast.
    return (ranked.join(F.broadcast(sizes), class_col).where(F.col("_rank") <= F.col("_quota"))
            .drop("_key", "_rank", "_quota"))


def apportion(counts: DataFrame, n_col: str, draws: Column, class_col: str = "class", out: str = "quota") -> DataFrame:
    """Largest-remainder apportionment of ``draws`` over classes.

    quota = floor(n_c / N x draws), then one more for the classes with the
    largest remainders (ties: class name ascending).  ``counts`` has one row
    per class, so its windows are tiny.
    """
    allw = W.partitionBy()
    total = F.sum(n_col).over(allw)
    cont = F.col(n_col).cast("double") / total * draws
    c = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont"))
    c = c.withColumn("_need", (F.first(draws).over(allw) - F.sum("_floor").over(allw)))
    c = c.withColumn("_rem", F.col("_cont") - F.col("_floor"))
    order = W.partitionBy().orderBy(F.col("_rem").desc(), F.col(class_col))
    c = c.withColumn("_rk", F.row_number().over(order))
    q = (F.col("_floor") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0)).cast("bigint")
    return c.withColumn(out, q).drop("_cont", "_floor", "_need", "_rem", "_rk")


def split_quotas(counts: DataFrame, test_size: float = 0.3, second_test_size: float = 0.33,
                 class_col: str = "class", n_col: str = "n") -> DataFrame:
    """Per-class train/validation/test sizes of the two-step stratified split.

    Step 1 holds out ceil(0.3 N) rows; step 2 holds out ceil(0.33 m) of those m
    as test, the rest is validation.  Per class the kept part of each step is
    apportioned by largest remainder.
    """
    allw = W.partitionBy()
    n_all = F.sum(n_col).over(allw)
    c = counts.withColumn("_draw1", n_all - F.ceil(F.lit(test_size) * n_all))
    c = apportion(c, n_col, F.col("_draw1"), class_col, "train")
    c = c.withColumn("_temp", F.col(n_col) - F.col("train"))
    m = F.sum("_temp").over(allw)
    c = c.withColumn("_draw2", m - F.ceil(F.lit(second_test_size) * m))
    c = apportion(c, "_temp", F.col("_draw2"), class_col, "validation")
    c = c.withColumn("test", (F.col("_temp") - F.col("validation")).cast("bigint"))
    return c.select(class_col, F.col(n_col).cast("bigint").alias(n_col), "train", "validation", "test")


def stratified_split(df: DataFrame, class_col: str = "class", id_col: str = "identifier", seed: int = 42,
                     test_size: float = 0.3, second_test_size: float = 0.33) -> DataFrame:
    """Add ``split`` in {train, validation, test} with exact per-class quotas.

    Rows are ranked inside their class by the seeded md5 key (two-pass rank, so
    a class holding a third of the data is still ranked by many tasks).
    """
    keyed = df.withColumn("_key", seeded_key(id_col, seed))
    ranked, sizes = exact_rank(keyed, "_key", parts=[class_col], out="_rank", with_sizes=True)
    quotas = split_quotas(sizes, test_size, second_test_size, class_col)
    j = ranked.join(F.broadcast(quotas.select(class_col, "train", "validation")), class_col)
    split = (F.when(F.col("_rank") <= F.col("train"), "train")
             .when(F.col("_rank") <= F.col("train") + F.col("validation"), "validation")
             .otherwise("test"))
    return j.withColumn("split", split).drop("_key", "_rank", "train", "validation")


def keep_last_k(df: DataFrame, k: int = 3, run: str = "run", step: str = "epoch") -> DataFrame:
    w = W.partitionBy(run).orderBy(F.col(step).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def cumsum(df: DataFrame, value: str, order: str, parts: list[str] | None = None, out: str = "cum") -> DataFrame:
    w = W.partitionBy(*(parts or [])).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def row_index(df: DataFrame, order: str, parts: list[str] | None = None, start: int = 0,
              out: str = "idx") -> DataFrame:
    w = W.partitionBy(*(parts or [])).orderBy(order)
    return df.withColumn(out, (F.row_number().over(w) - 1 + start).cast("int"))

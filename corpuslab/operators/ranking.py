"""Exact global ranks and running sums without a single-task window.

``row_number().over(Window.orderBy(k))`` moves every row into one task, and
``partitionBy(class)`` gives only as many tasks as classes, so one hot class
stalls the job.  Here the order key is cut into buckets whose order agrees with
the key's order (the first hex digits of an md5 key; keys that are not spread
evenly go by ranges that Spark samples, ``ordered_sum``).  Pass 1 counts (or sums) per (partition, bucket) - a table of at most
#partitions x #buckets rows, combined map-side - and turns it into offsets with
a window over that small table.  Pass 2 ranks inside (partition, bucket), which
spreads a hot partition over thousands of tasks, and adds the offset.  The
result equals the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def seeded_key(id_col, seed: int | str = 42) -> Column:
    """Repeatable pseudo-random order key: md5 of '<id>:<seed>' (DuckDB can repeat it)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def hex_bucket(key_col: str, digits: int = 3) -> Column:
    return F.substring(F.col(key_col), 1, digits)


GROUP = "_group"


def _grouped(df: DataFrame, parts: list[str], bucket: Column) -> DataFrame:
    """``df`` with its (partition, bucket) as one struct column.  A struct with NULLs inside equals another with NULLs in the
    same places, so the window and the join below deal the rows by the same key: one exchange for both."""
    return df.withColumn(GROUP, F.struct(*[F.col(p).alias(f"p{i}") for i, p in enumerate(parts)], bucket.alias("bucket")))


def _offsets(df: DataFrame, n_parts: int, value: Column | None) -> DataFrame:
    """Per (partition, bucket): total and offset (sum of the earlier buckets).

    The table is small (#partitions x #buckets rows) and is checkpointed to the
    shared folder, so the large input is read once for it and the size check
    and the join below do not recompute the input.
    """
    from corpuslab.session import shared_dir
    shared_dir(df.sparkSession, "")
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    per = df.groupBy(GROUP).agg(agg.alias("_bucket_total"))
    w = W.partitionBy(*[F.col(GROUP)[f"p{i}"] for i in range(n_parts)]).orderBy(F.col(GROUP)["bucket"]).rowsBetween(W.unboundedPreceding, -1)
    out = per.select(GROUP, "_bucket_total", F.coalesce(F.sum("_bucket_total").over(w), F.lit(0)).alias("_offset"))
    return out.checkpoint(eager=True)


def exact_rank(df: DataFrame, key_col: str, parts: list[str] | None = None,
               bucket: Column | None = None, out: str = "rank", with_sizes: bool = False):
    """Add ``out`` = 1-based rank of ``key_col`` inside ``parts`` (ties broken arbitrarily).

    With ``with_sizes`` also return the rows per partition, taken from the same
    per-bucket pass (no extra read of the input).
    """
    parts = list(parts or [])
    df = _grouped(df, parts, bucket if bucket is not None else hex_bucket(key_col))
    offs = _offsets(df, len(parts), None)
    ranked = df.withColumn("_inner", F.row_number().over(W.partitionBy(GROUP).orderBy(key_col)))
    ranked = ranked.join(offs.select(GROUP, "_offset"), GROUP)
    ranked = ranked.withColumn(out, (F.col("_offset") + F.col("_inner")).cast("bigint")).drop(GROUP, "_inner", "_offset")
    if not with_sizes:
        return ranked
    sizes = offs.groupBy(*[F.col(GROUP)[f"p{i}"].alias(p) for i, p in enumerate(parts)]).agg(F.sum("_bucket_total").cast("bigint").alias("n"))
    return ranked, sizes


def exact_running_sum(df: DataFrame, key_col: str, value_col: str, parts: list[str] | None = None,
                      bucket: Column | None = None, out: str = "running") -> DataFrame:
    """Add ``out`` = sum of ``value_col`` over rows with key <= this row's key (rows order)."""
    parts = list(parts or [])
    df = _grouped(df, parts, bucket if bucket is not None else hex_bucket(key_col))
    offs = _offsets(df, len(parts), F.col(value_col))
    w = W.partitionBy(GROUP).orderBy(key_col).rowsBetween(W.unboundedPreceding, 0)
    ranked = df.withColumn("_inner", F.sum(value_col).over(w)).join(offs.select(GROUP, "_offset"), GROUP)
    return ranked.withColumn(out, F.col("_offset") + F.col("_inner")).drop(GROUP, "_inner", "_offset")


def by_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and stored, with the range as ``_part``.

    Spark samples the key to cut ranges of about equal rows, whatever the values
    are: an outlier or a key that most rows share the start of leaves no range
    with much more than its share (rows equal in all of ``order`` stay together).
    """
    from corpuslab.session import fresh_dir
    path = fresh_dir(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ordered_sum(df: DataFrame, order: list, value: Column, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over this row and all before it in ``order``: inside the range, plus the ranges before.

    The ranges' totals are one row each, and are broadcast.
    """
    ranged = by_ranges(df, order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offs = ranged.groupBy("_part").agg(F.sum(value).alias("_total")).select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_inner", inner).join(F.broadcast(offs), "_part").withColumn(out, F.col("_inner") + F.col("_offset")).drop("_part", "_inner", "_offset")


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation (the pandas/numpy default).

    Values are first reduced to (value, count) pairs with a map-side combine,
    ranked by the two-pass running sum, and only the two order statistics around
    each requested position are read back: no task ever holds all values.
    """
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = vc.agg(F.sum("_n")).first()[0]
    if not total:
        return [None for _ in probs]
    cum = ordered_sum(vc, [F.col(col)], F.col("_n"), "_end")
    wanted = set()
    pos = []
    for p in probs:
        h = (total - 1) * p
        lo = int(h // 1)
        hi = min(lo + 1, total - 1) if h > lo else lo
        pos.append((h, lo, hi))
        wanted.update([lo, hi])
    conds = None
    for k in sorted(wanted):
        c = (F.col("_end") - F.col("_n") <= k) & (F.lit(k) < F.col("_end"))
        conds = c if conds is None else conds | c
    rows = cum.where(conds).select(col, "_n", "_end").collect()

    def at(k):
        for r in rows:
            if r["_end"] - r["_n"] <= k < r["_end"]:
                return float(r[col])
        raise AssertionError(k)

    outv = []
    for h, lo, hi in pos:
        a, b = at(lo), at(hi)
        t = h - lo
        outv.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return outv

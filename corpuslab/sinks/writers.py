"""Sinks and layout: partitioned parquet, balanced chunks, CSV, format comparison.

Writers are distributed (one file set per task); layout choices are
``partitionBy`` columns, so later reads prune partitions instead of opening
one file per class or month by hand.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.ranking import exact_rank, exact_running_sum, seeded_key


def write_per_archive(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """One directory per (year, month) archive."""
    df.write.mode("overwrite").option("compression", codec).partitionBy("year", "month").parquet(path)


def size_balanced_chunks(files: DataFrame, size_col: str, id_col: str, n: int = 4, seed: int = 42,
                         out: str = "chunk") -> DataFrame:
    """Shuffle items (seeded), keep a running sum of their sizes, and cut it at
    multiples of total/n: chunk = least(n-1, floor(n (cum - size) / total)).

    Same aim as the reference (n files of about equal bytes), not the same cuts:
    its running sum restarts at every cut.  The running sum is the exact
    two-pass one (no single-task window).
    """
    keyed = files.withColumn("_key", seeded_key(id_col, seed))
    cum = exact_running_sum(keyed, "_key", size_col, out="_cum")
    total = files.agg(F.sum(size_col)).first()[0] or 0
    chunk = F.least(F.lit(n - 1), F.floor(F.lit(n) * (F.col("_cum") - F.col(size_col)) / F.lit(max(total, 1))))
    return cum.withColumn(out, chunk.cast("int")).drop("_key", "_cum")


def shuffled_chunks(df: DataFrame, id_col: str, n: int = 10, seed: int = 42, out: str = "chunk") -> DataFrame:
    """Seeded shuffle cut into n equal slices; the last slice takes the rest."""
    ranked = exact_rank(df.withColumn("_key", seeded_key(id_col, seed)), "_key", out="_rn")
    total = df.count()
    per = max(total // n, 1)
    chunk = F.least(F.lit(n - 1), F.floor((F.col("_rn") - 1) / F.lit(per)))
    return ranked.withColumn(out, chunk.cast("int")).drop("_key", "_rn")


def write_chunks(df: DataFrame, path: str, chunk_col: str = "chunk", codec: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", codec).partitionBy(chunk_col).parquet(path)


def split_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def cluster_split_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split", "class").parquet(path)


def csv_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


FORMATS = {
    "csv": lambda w, p: w.option("header", True).csv(p),
    "parquet_snappy": lambda w, p: w.option("compression", "snappy").parquet(p),
    "parquet_zstd": lambda w, p: w.option("compression", "zstd").parquet(p),
    "parquet_gzip": lambda w, p: w.option("compression", "gzip").parquet(p),
    "orc": lambda w, p: w.option("compression", "zlib").orc(p),
}


def format_compare(df: DataFrame, root: str, formats: list[str] | None = None) -> DataFrame:
    """Write the same table in several formats; one row per format with the
    write seconds and the size in MB (sum of file lengths from a listing)."""
    spark = df.sparkSession
    rows = []
    for name in formats or list(FORMATS):
        p = f"{root.rstrip('/')}/{name}"
        t0 = time.time()
        FORMATS[name](df.write.mode("overwrite"), p)
        secs = time.time() - t0
        size = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
                .where(~F.regexp_extract("path", r"([^/]+)$", 1).startswith("_")).agg(F.sum("length")).first()[0])
        rows.append((name, float(secs), float(size or 0) / 1e6))
    return spark.createDataFrame(rows, "format string, seconds double, mb double")

"""Table sources: parquet, CSV, text columns, unions of same-schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the tasks, for work that costs far more than moving the rows (sentence pairs, LCS paths): a
    file of one row group is one task otherwise.  Select the columns that the work needs first."""
    return df.hint("rebalance")


def parquet_scan(spark: SparkSession, paths, columns: list[str] | None = None) -> DataFrame:
    """Read one or many parquet files/globs; the column list reaches the scan
    (ReadSchema) instead of being cut after a full read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str,
             drop: list[str] | None = None, usecols: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with header and an explicit schema (no inference pass); drop the
    stray row-index column or keep only ``usecols``.  Values with line ends need
    ``multi_line``, which makes a file one task; without it files are split."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if drop:
        df = df.drop(*drop)
    if usecols:
        df = df.select(*usecols)
    return df


def text_column_source(spark: SparkSession, path: str, column: str = "text", fmt: str = "parquet") -> DataFrame:
    """Only the text field of a corpus; the other columns are never read."""
    return spark.read.format(fmt).load(path).select(column)


def union_files(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of same-schema inputs, matched by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def generated_scan(spark: SparkSession, mapping: dict[str, str], id_col: str = "identifier",
                   text_col: str = "c_summary") -> DataFrame:
    """Per-model output files unioned into one (identifier, model, c_summary) table."""
    frames = [spark.read.parquet(p).select(id_col, F.lit(m).alias("model"), text_col)
              for m, p in sorted(mapping.items())]
    return union_files(spark, frames)


CURVE_SCHEMA = "wall_time double, step bigint, value double"


def curve_scan(spark: SparkSession, root: str) -> DataFrame:
    """Loss-curve CSVs under ``root`` read with one scan.

    Run and tag come from the file path: either the reference's file names
    ``run-<run>-tag-<tag>.csv`` or a Spark layout ``run=<run>/tag=<tag>/``.
    """
    df = (spark.read.schema(CURVE_SCHEMA).option("header", True).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.csv").csv(root))
    f = F.input_file_name()

    def pick(key_dir, key_file):
        return F.coalesce(F.nullif(F.regexp_extract(f, key_dir, 1), F.lit("")), F.regexp_extract(f, key_file, 1))
    run = pick(r"run=([^/]+)/tag=", r"run-([^/]+)-tag-[^/]+\.csv$")
    tag = pick(r"/tag=([^/]+)/", r"run-[^/]+-tag-([^/]+)\.csv$")
    return df.select(run.alias("run"), tag.alias("tag"), "wall_time", "step", "value")

"""What the operators of this subpackage share: the given tables, the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.textnp import tidy
from corpuslab.session import fresh_dir

#: A word, wherever an operator counts words: code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share (a local session without
    that setting gets a temporary one, a cluster without it an error)."""
    return fresh_dir(spark, sub)


def saved(df: DataFrame, sub: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again:
    lineage ends there, so a lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, sub)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that Spark hands to Python at once in the pipeline's stages.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``: a batch is held by the JVM and by the
    Python worker at once, and 10,000 texts can be very large.  A lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key)
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sheltered(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``docs`` with the columns ``used`` and all others inside one struct, so that no name an operator gives its own columns
    clashes with theirs; the function that gives a result the columns of ``docs`` again)."""
    rest = [c for c in docs.columns if c not in used]
    packed = docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest_of_row")) if rest else docs.select(*used)

    def whole(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(c) if c in used else F.col("rest_of_row")[c].alias(c) for c in docs.columns])
    return packed, whole


def scalar(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable[..., Column]:
    """``f`` from an Arrow array to one as a column function: the other columns of the rows stay in the JVM."""
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(f, batches)
    return F.arrow_udf(run, kind)

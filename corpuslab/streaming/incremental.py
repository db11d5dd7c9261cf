"""Incremental forms of the ingest and the decade roll-up (Structured Streaming).

Both run with ``trigger(availableNow=True)``: every archive or chunk file that
arrived since the last run is processed once, the checkpoint in the shared
folder records what was done, and the next run picks up only new files.  A
restarted query (lost driver or executor) resumes from the checkpoint.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import decade_of_id, pipes_to_space, word_count
from corpuslab.operators.aggregates import DECADES
from corpuslab.sources import archives as ar

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _unzip(batches):
    for pdf in batches:
        rows = []
        for path, blob in zip(pdf["path"], pdf["content"]):
            name = path.rsplit("/", 1)[-1]
            year, month = name[:4], name[4:6]
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                for member in z.namelist():
                    rows.append((year, month, member, z.read(member).decode("utf-8")))
        yield pd.DataFrame(rows, columns=["year", "month", "member", "xml"])


def incremental_ingest(spark: SparkSession, archive_root: str, out_path: str, checkpoint: str,
                       max_files: int = 1000) -> None:
    """New month archives -> parsed rows appended to ``out_path`` (exactly once).

    ``max_files`` bounds one micro-batch, so a large backlog is worked off in
    several committed batches instead of one huge one."""
    src = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
           .option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", max_files).load(archive_root))
    y = F.substring(F.regexp_extract("path", r"([^/]+)\.zip$", 1), 1, 4).cast("int")
    src = src.where(y.between(ar.FIRST_YEAR, ar.LAST_YEAR) & ~y.isin(*ar.MISSING_YEARS))
    rows = src.select("path", "content").mapInPandas(_unzip, "year string, month string, member string, xml string")
    parsed = ar.parse_cases(rows)
    q = (parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .partitionBy("year", "month").trigger(availableNow=True).start(out_path))
    q.awaitTermination()


def incremental_decade_rollup(spark: SparkSession, chunk_root: str, schema: str, out_path: str,
                              checkpoint: str, max_files: int = 1000) -> None:
    """Decade counts kept up to date as chunk files arrive.

    The streaming aggregate keeps one state row per decade; every micro-batch
    writes the complete, zero-filled roll-up (12 rows) over ``out_path``.
    """
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(chunk_root)
    sw = word_count(pipes_to_space("summary"))
    has_sum = F.col("summary") != "none"
    counts = (src.select(decade_of_id("identifier").alias("decade"), "missing_parts", "summary", sw.alias("_sw"))
              .groupBy("decade")
              .agg(F.count(F.lit(1)).alias("cases"),
                   F.count_if(F.col("missing_parts") == "none").alias("complete_cases"),
                   F.count_if(has_sum & (F.col("_sw") == 1)).alias("oneword_summaries"),
                   F.count_if(has_sum & (F.col("_sw") > 1) & (F.col("_sw") < 10)).alias("short_summaries"),
                   F.count_if(F.col("missing_parts") == "summary").alias("missing_summaries")))

    def publish(batch: DataFrame, _epoch: int) -> None:
        frame = batch.sparkSession.createDataFrame([(d,) for d in DECADES], "decade int")
        cols = ["cases", "complete_cases", "oneword_summaries", "short_summaries", "missing_summaries"]
        out = frame.join(F.broadcast(batch), "decade", "left").select(
            "decade", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
        out = out.withColumn("viable_cases", (F.col("complete_cases") - F.col("short_summaries")
                                              - F.col("oneword_summaries")).cast("bigint"))
        out.coalesce(1).write.mode("overwrite").parquet(out_path)

    q = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(publish).trigger(availableNow=True).start())
    q.awaitTermination()

"""Ingest of month archives that may arrive again.

Archives are delivered as new files; the file name without its folder says which
archive it is.  A keyed state per archive remembers the digest and the time of
the delivery that counts.  A delivery with the same digest, or an older one, changes
nothing; one with another digest takes the place of the one before, whose
rows are retracted, and the decade roll-up follows.

Tables under the output folder:

* ``rows``: the parsed rows of every delivery that ever counted;
* ``decades``: what each such delivery adds to the roll-up, a few rows each;
* ``current``: which delivery of which archive counts from a batch on.

``current_rows`` and ``rollup`` read those of the deliveries that count now.  All
three are written per batch and overwritten if a batch is run again, so a
restart gives the same tables.  Tasks read archives member by member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslab.operators.aggregates import decade_counts
from corpuslab.sources import archives as ar
from corpuslab.sources import ziparchives as zp
from corpuslab.streaming.incremental import BINARY_SCHEMA

DELIVERY = "archive string, path string, modified timestamp, digest string"
COUNTS = ["cases", "complete_cases", "oneword_summaries", "short_summaries", "missing_summaries", "viable_cases"]


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of every delivered file, read in pieces."""
    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            system, at = zp.file_system(path)
            sha = hashlib.sha256()
            with system.open_input_stream(at) as f:
                while piece := f.read(zp.CHUNK):
                    sha.update(piece)
            digests.append(sha.hexdigest())
        yield pdf.assign(digest=digests)[["archive", "path", "modified", "digest"]]


class Latest(StatefulProcessor):
    """Lets a delivery of an archive through if it is newer than the one that counts and has another digest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "digest string, modified timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["modified", "path"]).iloc[-1]
        if self.held.exists():
            digest, modified = self.held.get()
            if new["modified"].to_pydatetime().replace(tzinfo=None) < pd.Timestamp(modified).to_pydatetime().replace(tzinfo=None):
                return
            self.held.update((new["digest"], new["modified"].to_pydatetime()))
            if digest == new["digest"]:
                return
        else:
            self.held.update((new["digest"], new["modified"].to_pydatetime()))
        yield pd.DataFrame({"archive": [key[0]], "path": [new["path"]], "modified": [new["modified"]], "digest": [new["digest"]]})

    def close(self) -> None:
        pass


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for archive, path, digest in zip(pdf["archive"], pdf["path"], pdf["digest"]):
            system, at = zp.file_system(path)
            size = system.get_file_info(at).size
            with system.open_input_file(at) as f:
                rows = []
                for name, start, packed, method, _ in zp.members(f, size):
                    rows.append((archive, digest, archive[:4], archive[4:6], zp.content(f, start, packed, method).decode("utf-8")))
                    if len(rows) == 100:
                        yield pd.DataFrame(rows, columns=["archive", "delivery", "year", "month", "xml"])
                        rows = []
                yield pd.DataFrame(rows, columns=["archive", "delivery", "year", "month", "xml"])


def ingest(spark: SparkSession, archive_root: str, out: str, checkpoint: str, max_files: int = 1000) -> None:
    """Take in every archive delivered under ``archive_root`` since the last call."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", "*.zip")
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(archive_root))
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    year = F.substring(name, 1, 4).cast("int")
    src = (src.where(year.between(ar.FIRST_YEAR, ar.LAST_YEAR) & ~year.isin(*ar.MISSING_YEARS))
           .select(name.alias("archive"), "path", F.col("modificationTime").alias("modified")).mapInPandas(_digested, DELIVERY))
    counted = src.groupBy("archive").transformWithStateInPandas(Latest(), DELIVERY, "append", "None")

    def take(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        if not batch.isEmpty():
            xml = batch.select("archive", "path", "digest").mapInPandas(_members, "archive string, delivery string, year string, month string, xml string")
            parsed = ar.parse_cases(xml, keep=("archive", "delivery"))
            _put(parsed, f"{out}/rows", epoch)
            rows = spark.read.schema(parsed.schema).parquet(f"{out}/rows/epoch={epoch}")
            _put(decade_counts(ar.with_none(rows), by=("archive", "delivery")), f"{out}/decades", epoch)
        _put(batch.select("archive", F.col("digest").alias("delivery"), "modified").coalesce(1), f"{out}/current", epoch)
        batch.unpersist()
    (counted.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())


def _put(df: DataFrame, path: str, epoch: int) -> None:
    """Write a batch's rows, in the place of what an earlier try of the batch wrote."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def current(spark: SparkSession, out: str) -> DataFrame:
    """(archive, delivery, epoch) that counts now."""
    w = W.partitionBy("archive").orderBy(F.col("modified").desc(), F.col("epoch").desc())
    return (spark.read.schema("archive string, delivery string, modified timestamp, epoch long").parquet(f"{out}/current")
            .withColumn("n", F.row_number().over(w)).where("n = 1").select("archive", "delivery", "epoch"))


def _counting(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}").join(current(spark, out), ["archive", "delivery", "epoch"])


def current_rows(spark: SparkSession, out: str) -> DataFrame:
    """The parsed rows of the deliveries that count."""
    return _counting(spark, out, "rows").drop("archive", "delivery", "epoch")


def rollup(spark: SparkSession, out: str) -> DataFrame:
    """The decade roll-up of the deliveries that count, from a few rows each."""
    return _counting(spark, out, "decades").groupBy("decade").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])

"""Session helpers: one place for the confs every job relies on.

Library functions never create a session; they take the caller's.  These
helpers are for tests, ``bench.py`` and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Confs that matter at any scale: AQE re-plans joins and coalesces/splits
# shuffle partitions from runtime sizes; skew-join splits hot keys; Arrow is the
# transport for the few Python functions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints of small intermediate tables are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "corpuslab", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local"):
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` (or a checkpoint folder already set on the
    context) is read from the session.  Only a local session without one gets a
    fresh temporary folder (tests, laptops); a cluster session without one is
    an error, since a machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="corpuslab-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # noqa: BLE001 - some deployments forbid setting it at run time
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/") + "/" + sub


def fresh_dir(spark: SparkSession, sub: str) -> str:
    """A new, unique folder under the shared location (one per run)."""
    import uuid
    return shared_dir(spark, f"{sub}-{uuid.uuid4().hex[:12]}")


def fitted_path(spark: SparkSession, name: str, sources: list[str], **settings) -> str:
    """The shared folder for what this application fits to the Parquet files ``sources`` with ``settings``.

    Files are told by path, size and time of change, so changed input never meets an old fit.
    """
    import hashlib
    import json

    from pyspark.sql import functions as F
    seen = [tuple(r) for p in sources for r in spark.read.parquet(p).select(
        "_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).distinct().collect()]
    key = json.dumps([spark.sparkContext.applicationId, sorted(seen), sorted(settings.items())])
    return shared_dir(spark, f"{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}")


def read_or_none(spark: SparkSession, path: str):
    """The Parquet table at ``path``, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - told by its class of error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None

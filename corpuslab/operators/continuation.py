"""A learned score of "sentence b continues sentence a", for coherence.

A sentence is the share (square-rooted) of its byte 2- and 3-grams in ``DIMS``
hashed buckets.  The score of a pair is the logistic of the weighted sum over all
products of a bucket of a with a bucket of b (hashed cross features, a matrix
of DIMS x DIMS weights).  It is fitted by contrast: neighbouring sentences
of a document against pairs whose second sentence comes from another pair by a
keyed permutation.

The fit uses about ``PAIRS`` neighbouring pairs drawn by a hash over all of them
(a parameter; all pairs are counted, so the share is known); documents whose
hash falls into the held-out part take no part in it.  Each step is one Spark
job: tasks add up the gradient of their rows, Spark sums the tasks' blocks, and
the driver, which holds the weights only, moves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.session import fitted_path, fresh_dir, read_or_none

DIMS = 256
PAIRS, STEPS, RATE, DECAY = 40_000, 30, 1.0, 1e-7
HELD_OUT = 4           # one document in so many is held out
BUCKETS = 64
#: Sentences whose vectors a task holds at once, rows of the gradient that Spark sums as one block.
SLICE, ROWS = 4096, 16


def grams(sentence: str | None) -> bytes:
    """Bucket of each byte 2- and 3-gram of a sentence (a blank on both sides), one byte each."""
    b = np.frombuffer(f" {sentence or ''} ".encode(), np.uint8).astype(np.uint64)
    two = (b[:-1] << np.uint64(8) | b[1:]) * np.uint64(0x9E3779B97F4A7C15)
    three = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.r_[two, three] >> np.uint64(56)).astype(np.uint8).tobytes()


def vectors(rows: list[bytes]) -> np.ndarray:
    """Square-rooted bucket shares, a row for each sentence."""
    size = np.array([len(r) for r in rows], np.int64)
    cell = np.repeat(np.arange(len(rows)), size) * DIMS + np.frombuffer(b"".join(rows), np.uint8)
    v = np.bincount(cell, minlength=len(rows) * DIMS).reshape(len(rows), DIMS)
    return np.sqrt(v / np.maximum(size, 1)[:, None])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def scores(weights: np.ndarray, bias: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sigmoid(np.einsum("ij,ij->i", a @ weights, b) + bias)


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(HELD_OUT))


def examples(docs: DataFrame, key: str, sents: str, pairs: int = PAIRS, seed: int = 42) -> DataFrame:
    """(held_out, y, a, b, sa, sb), stored: about ``pairs`` neighbouring pairs of all documents and as many permuted ones, with
    their sentences and these as buckets.  A permuted pair of one document is left out."""
    spark = docs.sparkSession
    n = docs.select(F.sum(F.greatest(F.size(sents) - 1, F.lit(0)))).first()[0] or 0
    near = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(
        i.alias("i"), F.element_at("s", i).alias("sa"), F.element_at("s", i + 1).alias("sb")))
    d = docs.select(F.col(key).cast("string").alias("key"), F.col(sents).alias("s")).where(F.size("s") > 1)
    p = d.select("key", F.explode(near).alias("p")).select("key", "p.*")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "key", "i"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, pairs / max(1, n)))
    p = p.where(drawn).withColumn("held_out", _part(F.col("key")) == 0).withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "i"))
    path = fresh_dir(spark, "continuation-pairs")
    p.write.parquet(path)
    p = spark.read.parquet(path).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    ring = W.partitionBy("held_out", "bucket").orderBy("order", "key", "i")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    other = F.struct("key", "sb")
    p = p.withColumn("o", F.coalesce(F.lead(other).over(ring), F.first(other).over(whole)))
    rows = p.select("held_out", F.lit(1).alias("y"), "sa", "sb").unionByName(
        p.where("o.key <> key").select("held_out", F.lit(0).alias("y"), "sa", F.col("o.sb").alias("sb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (pa.array([grams(x) for x in batch.column(c).to_pylist()], pa.binary()) for c in ("sa", "sb"))
            yield pa.record_batch([batch.column("held_out"), batch.column("y"), a, b, batch.column("sa"), batch.column("sb")],
                                  names=["held_out", "y", "a", "b", "sa", "sb"])
    path = fresh_dir(spark, "continuation-examples")
    rows.mapInArrow(run, "held_out boolean, y int, a binary, b binary, sa string, sb string").write.parquet(path)
    return spark.read.parquet(path)


def gradient(rows: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, int]:
    """(gradient of the weights, of the bias, rows) of the logistic loss over ``rows`` (y, a, b), summed by Spark."""
    table = rows.sparkSession.sparkContext.broadcast((weights, bias))     # DIMS x DIMS numbers, whatever the input

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = table.value
        g, gb, n = np.zeros((DIMS, DIMS)), 0.0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                some = batch.slice(k, SLICE)
                a, b = (vectors(some.column(x).to_pylist()) for x in ("a", "b"))
                e = scores(w, c, a, b) - some.column("y").to_numpy()
                g += a.T @ (b * e[:, None])
                gb, n = gb + float(e.sum()), n + some.num_rows
        if n:
            blocks = [np.ascontiguousarray(g[i:i + ROWS]).tobytes() for i in range(0, DIMS, ROWS)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()),
                                   pa.array([gb] * len(blocks)), pa.array([n] * len(blocks), pa.int64())], names=["at", "g", "gb", "n"])

    def add(some: pa.Table) -> pa.Table:
        g = sum(np.frombuffer(x, np.float64) for x in some.column("g").to_pylist())
        return pa.table({"at": pa.array([some.column("at")[0].as_py()], pa.int32()), "g": pa.array([g.tobytes()], pa.binary()),
                         "gb": pa.array([sum(some.column("gb").to_pylist())]), "n": pa.array([sum(some.column("n").to_pylist())], pa.int64())})
    schema = "at int, g binary, gb double, n long"
    got = sorted(rows.select("y", "a", "b").mapInArrow(part, schema).groupBy("at").applyInArrow(add, schema).collect(), key=lambda r: r["at"])
    if not got:
        return np.zeros((DIMS, DIMS)), 0.0, 0
    return np.concatenate([np.frombuffer(r["g"], np.float64) for r in got]).reshape(DIMS, DIMS), got[0]["gb"], got[0]["n"]


def fit(rows: DataFrame, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``steps`` full gradients with moment estimates; zeros without examples."""
    rows = rows.where("not held_out")
    w, bias = np.zeros((DIMS, DIMS)), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g, gb, n = gradient(rows, w, bias)
        if not n:
            break
        g = g / n + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        bias -= rate * gb / n
    return w, bias


def stored_fit(spark: SparkSession, sources: list[str], rows, **settings) -> tuple[np.ndarray, float]:
    """The scorer that this application fitted to the files ``sources``, or a new fit to the examples ``rows()``."""
    path = fitted_path(spark, "continuation", sources, **settings)
    have = read_or_none(spark, path)
    if have is None:
        w, bias = fit(rows(), **settings)
        spark.createDataFrame([(i, r.tolist(), float(bias)) for i, r in enumerate(w)], "at int, weights array<double>, bias double") \
            .coalesce(1).write.mode("overwrite").parquet(path)
        have = spark.read.parquet(path)
    got = have.orderBy("at").collect()                     # DIMS rows
    return np.array([r["weights"] for r in got]), got[0]["bias"]


def coherence(spark: SparkSession, weights: np.ndarray, bias: float):
    """Column function: the mean score of a text's neighbouring sentences (an array of them), rounded to 4; 0 with fewer than two."""
    table = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def mean(texts: pd.Series) -> pd.Series:
        w, c = table.value
        lists = [[] if t is None else list(t) for t in texts]
        total = np.zeros(len(lists))
        sents, of = [s for t in lists for s in t], np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        for k in range(0, max(0, len(sents) - 1), SLICE):
            v = vectors([grams(s) for s in sents[k:k + SLICE + 1]])
            here = of[k:k + SLICE + 1]
            same = here[:-1] == here[1:]
            total += np.bincount(here[:-1][same], scores(w, c, v[:-1], v[1:])[same], len(lists))
        n = np.array([len(t) - 1 for t in lists])
        return pd.Series(np.where(n > 0, np.round(total / np.maximum(n, 1), 4), 0.0))
    return mean


def evaluate(rows: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(n_pairs, auc, auc_jaccard) on the held-out examples: of the score and of the share of common words."""
    table = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = table.value
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                some = batch.slice(k, SLICE)
                z = scores(w, c, *(vectors(some.column(x).to_pylist()) for x in ("a", "b")))
                words = [[set(s.lower().split()) for s in some.column(x).to_pylist()] for x in ("sa", "sb")]
                j = [len(p & q) / max(1, len(p | q)) for p, q in zip(*words)]
                yield pa.record_batch([some.column("y"), pa.array(z), pa.array(j)], names=["y", "score", "jaccard"])
    s = rows.where("held_out").mapInArrow(run, "y int, score double, jaccard double")

    def auc(column: str) -> DataFrame:
        # ranks of the held-out examples, bounded as they are; ties share their mean rank
        per = s.groupBy(column).agg(F.sum("y").alias("p"), F.count("*").alias("n"))
        per = per.withColumn("below", F.sum("n").over(W.orderBy(column)) - F.col("n"))
        return per.agg(F.sum(F.col("p") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(
            F.col("n").alias("n_pairs"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias(f"auc_{column}"))
    return auc("score").withColumnRenamed("auc_score", "auc").join(auc("jaccard"), "n_pairs")

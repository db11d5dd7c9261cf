"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Features are the character n-grams (3 to 5 bytes of the text with A-Z in lower
case) that a text holds at least once, hashed to ``DIMS`` buckets.  Each is
scaled by its naive Bayes log-count ratio, and a logistic regression is fitted
on the scaled features; labels come from at most ``PER_CLASS`` rows of each
class, never from held-out ones.  A scoring pass needs one table of DIMS
weights per task and looks every n-gram up once.

Held out are the documents whose crc32(doc_id as text) mod 3 is 1.  Nothing
but the text enters a score.

Edge cases: null and empty texts hold no n-gram and score what the bias says;
a null doc_id is not held out; without labels of both classes every score is
0; repeated rows are scored each; ``score`` and ``clean`` carry other columns along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import linear
from corpuslab.llm.common import bounded_batches, read, scalar, sheltered
from corpuslab.llm.textnp import MUL, flat, give_back, slices, tidy

BITS = 18
DIMS = 1 << BITS
ORDERS = (3, 4, 5)
PER_CLASS = 1000
MIN_TEXTS, RATIO, L2 = 3, 2.0, 1e-2
THRESHOLD = 0.7
ROWS = 64  # texts per bit table: ROWS * DIMS bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram that a text holds, each pair once."""
    buf, off = flat(texts)
    low = _LOWER[buf].astype(np.uint64)
    seen = np.zeros(len(texts) * DIMS, bool)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))  # bytes from here to the end of the text
    h = np.zeros(len(buf), np.uint64)
    for k in range(max(ORDERS)):
        m = len(buf) - k
        if m <= 0:
            break
        h[:m] = (h[:m] + low[k:] + np.uint64(1)) * np.uint64(MUL)
        if k + 1 in ORDERS:
            ok = left[:m] > k
            b = (h[:m] ^ (h[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
            seen[row[:m][ok] + b[ok].astype(np.int64)] = True
    at = np.flatnonzero(seen)
    return at >> BITS, at & (DIMS - 1)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, "text"):
        for k in range(0, part.num_rows, ROWS):
            yield part.slice(k, ROWS)


@tidy
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch):
            row, col = grams(part.column("text"))
            cols = np.split(col.astype(np.int32), np.searchsorted(row, np.arange(1, part.num_rows)))
            yield pa.record_batch([part.column("y"), pa.array(cols, pa.list_(pa.int32()))], names=["y", "cols"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """(weight of every bucket, bias) from labelled rows that are not held out."""
    rows = linear.sampled(docs, labels, "toxic", per_class, lambda i: ~held_out(i)).mapInArrow(_rows, "y int, cols array<int>").toArrow()
    y = rows.column("y").to_numpy().astype(int)
    fitted = fit([np.array(c.values, np.int64) for c in rows.column("cols")], y) if len(set(y)) == 2 else (np.zeros(DIMS), -40.0)
    del rows
    give_back()                                            # the driver lives on
    return fitted


def nb_fit(cols: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the scaled regression; buckets that fewer than MIN_TEXTS texts
    hold, or whose log-count ratio is under RATIO, get weight 0."""
    def held(c):
        return np.bincount(np.concatenate([x for x, t in zip(cols, y) if t == c] or [np.zeros(0, int)]), minlength=DIMS).astype(float)
    p, q = held(1), held(0)
    ratio = np.log(((p + 1) / ((y == 1).sum() + 2)) / ((q + 1) / ((y == 0).sum() + 2)))  # of the shares of texts that hold the n-gram
    ratio[(p + q < MIN_TEXTS) | (abs(ratio) < RATIO)] = 0
    some = [c[ratio[c] != 0] for c in cols]
    w, b = linear.fit(linear.Sparse([(c, ratio[c]) for c in some]), y, DIMS, l2=L2, steps=80, rate=0.02)
    return ratio * w, b


def fit(cols: list[np.ndarray], y: np.ndarray, folds: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias, calibrated on scores of rows that the scoring fit had not seen."""
    z, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for f in range(folds):
        w, b = nb_fit([c for c, k in zip(cols, fold) if k != f], y[fold != f])
        z[fold == f] = [w[c].sum() + b for c, k in zip(cols, fold) if k == f]
    scale, shift = linear.calibrate(z, y)
    w, b = nb_fit(cols, y)
    return w * scale, b * scale + shift


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``docs`` with the column score (0 to 1); a column of that name is replaced."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # DIMS doubles, whatever the input

    def run(texts: pa.Array) -> pa.Array:
        z = []
        for part in parts(pa.record_batch([texts], ["text"])):
            row, col = grams(part.column("text"))
            z.append(np.bincount(row, table.value[col], part.num_rows) + bias)
        return pa.array(linear.sigmoid(np.concatenate(z)) if z else np.zeros(0))
    return docs.drop("score").withColumn("score", scalar(run, "double")(F.col("text")))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier calls toxic."""
    bounded_batches(docs.sparkSession)
    fitted = train(docs.select("doc_id", "text"), labels)
    docs, whole = sheltered(docs, "doc_id", "text")
    return whole(score(docs, *fitted).where(F.col("score") < THRESHOLD))


def op2_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), *train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

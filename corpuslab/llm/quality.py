"""Quality rules: fixed base rules, then a learned verdict.

The verdict comes from a logistic regression over hashed word n-grams (one and
two words) and character n-grams (three bytes), trained on at most PER_CLASS
labelled rows of each class (``labels.quality``) and calibrated on rows that
the fit had not seen.  Features are square roots of the shares of a text's
n-grams in each bucket, so long and short texts are on one scale.  Texts are
scored in Arrow batches; a text is kept if no base rule fails and the
calibrated probability of quality 1 reaches ``KEEP``.

Base measures: n_words, word_chars (code points in words), n_symbols
(characters ``#*$%&|<>``), n_dup_lines (lines with a word that equal an
earlier line), n_repeat_words (words in windows of eight words that the text
holds twice or more, the first included).  ``base_failed``: fewer than 20
words, or more than 30 % of the words repeated.

Edge cases: null and empty texts have no words and fail the base rules; null
ids and repeated rows are scored row by row; without labels of both classes
the probability is 1, so only the base rules decide; extra columns are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import linear
from corpuslab.llm.common import read
from corpuslab.llm.textnp import MUL, flat, shingles, slices, word_hashes, words

BITS = 12
DIMS = 1 << BITS                # per family: word n-grams, character n-grams
PER_CLASS = 1000
KEEP = 0.4
MIN_WORDS, MAX_REPEAT = 20, 30  # words; per cent
WINDOW = 8
ROWS = 256
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANKS = " \t\n\x0b\x0c\r"


def measures(texts: pa.Array, buf, off, start, end, doc, h) -> dict[str, np.ndarray]:
    """The base measures of a slice of texts."""
    n = len(texts)
    n_words = np.bincount(doc, minlength=n)
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]     # code points: bytes that do not continue one
    chars = np.bincount(doc, points[end] - points[start], n)
    at = np.r_[0, np.cumsum(_SYMBOL[buf])]
    return {"n_words": n_words, "word_chars": chars.astype(np.int64), "n_symbols": at[off[1:]] - at[off[:-1]],
            "n_dup_lines": np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64),
            "n_repeat_words": np.bincount(doc, _repeated(h, doc), n).astype(np.int64)}


def _dup_lines(text: str | None) -> int:
    lines = (text or "").split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of WINDOW words that their text holds twice."""
    out = np.zeros(len(h), bool)
    if len(h) < WINDOW:
        return out
    w = shingles(h, WINDOW)
    inside = np.flatnonzero(doc[:len(w)] == doc[WINDOW - 1:])
    key = w[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(MUL))
    o = np.argsort(key, kind="stable")
    same = key[o][1:] == key[o][:-1]
    twice = inside[o][np.r_[same, False] | np.r_[False, same]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def features(n: int, buf, off, doc, h) -> np.ndarray:
    """(texts, 2 * DIMS) matrix of square-rooted n-gram shares."""
    x = np.zeros((2, n, DIMS))
    two = shingles(h, 2)
    in2 = doc[:len(two)] == doc[1:] if len(two) else np.zeros(0, bool)
    cell = np.r_[doc * DIMS + (h >> np.uint64(64 - BITS)).astype(np.int64),
                 doc[:len(two)][in2] * DIMS + (two[in2] >> np.uint64(64 - BITS)).astype(np.int64)]
    x[0] = np.bincount(cell, minlength=n * DIMS).reshape(n, DIMS)
    m = len(buf) - 2
    if m > 0:
        b = buf.astype(np.uint64)
        g = ((b[:m] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) * np.uint64(MUL) >> np.uint64(64 - BITS)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
        inside = row[:m] == row[2:]
        x[1] = np.bincount(row[:m][inside] * DIMS + g[inside].astype(np.int64), minlength=n * DIMS).reshape(n, DIMS)
    total = np.maximum(x.sum(axis=2, keepdims=True), 1)
    return np.sqrt(x / total).transpose(1, 0, 2).reshape(n, 2 * DIMS)


def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    for some in slices(batch, "text"):
        for k in range(0, some.num_rows, ROWS):
            part = some.slice(k, ROWS)
            buf, off = flat(part.column("text"))
            start, end, doc = words(buf, off)
            yield part, buf, off, start, end, doc, word_hashes(buf, start, end)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the rows that pass the base rules: only those get the model's verdict."""
    for batch in batches:
        for part, buf, off, start, end, doc, h in parts(batch):
            ok = ~base_failed(measures(part.column("text"), buf, off, start, end, doc, h))
            x = features(part.num_rows, buf, off, doc, h)[ok]
            cols = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.record_batch([part.column("y").filter(pa.array(ok)), pa.array(cols, pa.list_(pa.int32())),
                                   pa.array([r[c].astype(np.float32) for r, c in zip(x, cols)], pa.list_(pa.float32()))],
                                  names=["y", "cols", "vals"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the calibrated log-odds of quality 1."""
    rows = (linear.sampled(docs, labels, "quality", per_class)
            .mapInArrow(_rows, "y int, cols array<int>, vals array<float>").toArrow())
    y = rows.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        return np.zeros(2 * DIMS), 40.0
    return fit([(np.array(c.values, np.int64), np.array(v.values, float)) for c, v in zip(rows.column("cols"), rows.column("vals"))], y)


def fit(rows: list, y: np.ndarray, folds: int = 4) -> tuple[np.ndarray, float]:
    def one(keep):
        return linear.fit(linear.Sparse([r for r, k in zip(rows, keep) if k]), y[keep], 2 * DIMS, l2=1e-5, steps=60, rate=0.3)
    z, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for f in range(folds):
        w, b = one(fold != f)
        z[fold == f] = linear.Sparse([r for r, k in zip(rows, fold) if k == f]).dot(w) + b
    scale, shift = linear.calibrate(z, y)
    w, b = one(np.ones(len(y), bool))
    return w * scale, b * scale + shift


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, weights: np.ndarray, bias: float, keep: float = KEEP) -> DataFrame:
    """doc_id, the base measures, base_failed, the probability of quality 1, and kept."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # 2 * DIMS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for batch in batches:
            for part, buf, off, start, end, doc, h in parts(batch):
                m = measures(part.column("text"), buf, off, start, end, doc, h)
                failed = base_failed(m)
                p = linear.sigmoid(features(part.num_rows, buf, off, doc, h) @ w + bias)
                yield pa.record_batch(
                    [part.column("doc_id"), *[pa.array(m[c], pa.int64()) for c in COLUMNS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep))],
                    names=["doc_id", *COLUMNS, "base_failed", "probability", "kept"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, probability double, kept boolean")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, *train(docs, read(spark, sf_dir, "labels")))

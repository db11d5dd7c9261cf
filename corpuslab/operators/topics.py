"""Topic model: online variational Bayes whose topic-term weights are a table.

The model is a table (term, lam) with one row per term and ``k`` weights in
``lam``; it is stored after every update, so a fit that stops is taken up where
it was and a fitted model learns from further documents.  Nothing that grows
with the vocabulary or the corpus passes through the driver: it holds the ``k``
column sums of the table and counts.

Documents are packed into blocks (their distinct terms, and a compressed
document-term matrix against them).  A block needs only its own terms' weights:
its terms are joined with the table, the block and its weights meet in one
task, the variational parameters of its documents are found there by a fixed
point in numpy, and its contribution per term goes back through a summed
shuffle.  A term that every document holds costs one row per block, not per
document.

A fit takes the blocks in batches: the first is the base, gone over
``base_passes`` times with a full step; then every other batch updates the
model once with the step (1 + t)^-0.5, and in such a pass each document is used
exactly once.  Starting weights come from a keyed md5 of (term, topic, seed).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.session import fitted_path, fresh_dir, read_or_none

#: Tokens of a block; variational steps of a document at most, and the mean change at which it is done.
BLOCK_TOKENS = 1 << 20
STEPS, SETTLED = 50, 1e-3
TINY = 1e-100
#: Cells of a document-term matrix, or rows of weights, that are worked on at once (a longer document's cells together).
CELLS = 1 << 16


# --- numbers ------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function (x > 0)."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function (x > 0)."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    f = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def _runs(ptr: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of documents with at most ``CELLS`` cells, or of one document."""
    first, n = 0, len(ptr) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(ptr, ptr[first] + CELLS, "right")) - 1)
        yield first, past
        first = past


def e_step(ptr: np.ndarray, idx: np.ndarray, cnt: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """Variational topic parameters of every document of a block (documents x k).

    ``ptr``, ``idx``, ``cnt`` are the document-term matrix by rows, ``beta`` the
    exponentiated expected log weights of the block's terms.  A document's
    steps do not depend on the others, so they are taken some at a time and
    memory does not grow with the block.
    """
    gamma = np.empty((len(ptr) - 1, beta.shape[1]))
    for a, b in _runs(ptr):
        cells = slice(ptr[a], ptr[b])
        gamma[a:b] = _steps(ptr[a:b + 1] - ptr[a], idx[cells], cnt[cells], beta, alpha)
    return gamma


def _steps(ptr: np.ndarray, idx: np.ndarray, cnt: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """``e_step`` of all documents at once; one that has settled is left out."""
    k, n = beta.shape[1], len(ptr) - 1
    total = np.add.reduceat(np.r_[cnt, 0.0], ptr[:-1]) * (np.diff(ptr) > 0) if n else np.zeros(0)
    gamma = np.full((n, k), alpha) + (total / k)[:, None]
    live = np.flatnonzero(np.diff(ptr) > 0)
    for _ in range(STEPS):
        if not len(live):
            break
        size = ptr[live + 1] - ptr[live]
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(ptr[live] - start, size)
        theta = np.exp(digamma(gamma[live]) - digamma(gamma[live].sum(1))[:, None])
        b = beta[idx[at]]
        share = cnt[at] / (np.einsum("ij,ij->i", np.repeat(theta, size, axis=0), b) + TINY)
        new = alpha + theta * np.add.reduceat(b * share[:, None], start, axis=0)
        moved = np.abs(new - gamma[live]).mean(1)
        gamma[live] = new
        live = live[moved >= SETTLED]
    return gamma


def fits(theta: np.ndarray, ptr: np.ndarray, idx: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """sum_k theta beta of every cell."""
    out = np.empty(len(idx))
    for a, b in _runs(ptr):
        cells = slice(ptr[a], ptr[b])
        out[cells] = np.einsum("ij,ij->i", np.repeat(theta[a:b], np.diff(ptr[a:b + 1]), axis=0), beta[idx[cells]])
    return out


def exp_elog(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """exp(E[log beta]) of terms with weights ``rows`` under topics with column sums ``sums``."""
    out, low = np.empty(rows.shape), digamma(sums)[None, :]
    for a in range(0, len(rows), CELLS):
        out[a:a + CELLS] = np.exp(digamma(rows[a:a + CELLS]) - low)
    return out


# --- blocks -------------------------------------------------------------------

BLOCKS = "keys array<string>, terms array<string>, ptr array<int>, idx array<int>, cnt array<int>"


def _block(keys: list, tokens: list[pa.ListArray]) -> pa.RecordBatch:
    """One block row from documents' keys and token arrays."""
    lists = pa.chunked_array(tokens).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    width = max(1, len(coded.dictionary))
    cell, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + words, return_counts=True)
    ptr = np.searchsorted(cell, np.arange(len(sizes) + 1) * width)
    columns = [pa.array([x], t) for x, t in ((keys, pa.list_(pa.string())), (ptr, pa.list_(pa.int32())),
                                             (cell % width, pa.list_(pa.int32())), (n, pa.list_(pa.int32())))]
    terms = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
    return pa.RecordBatch.from_arrays([columns[0], terms, *columns[1:]], ["keys", "terms", "ptr", "idx", "cnt"])


def _pack(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tokens, held = [], [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, size in enumerate(sizes):
                if held and held + size > block_tokens:
                    tokens.append(batch.column("tokens").slice(start, i - start))
                    keys += batch.column("key").slice(start, i - start).to_pylist()
                    yield _block(keys, tokens)
                    keys, tokens, held, start = [], [], 0, i
                held += int(size)
            tokens.append(batch.column("tokens").slice(start))
            keys += batch.column("key").slice(start).to_pylist()
        if keys:
            yield _block(keys, tokens)
    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_blocks(docs: DataFrame, key: str = "identifier", tokens_col: str = "tokens", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, keys, terms, ptr, idx, cnt) of all documents, stored; a block is closed at about ``block_tokens``
    tokens (one longer document is a block by itself).  Null token arrays count as empty."""
    d = docs.select(F.col(key).cast("string").alias("key"), F.col(tokens_col).alias("tokens"))
    return _stored(d.mapInArrow(_pack(block_tokens), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "topic-blocks")


# --- model --------------------------------------------------------------------


@dataclass
class TopicModel:
    """The table (term, lam) at ``path`` and what the next update needs to know."""

    spark: SparkSession
    path: str
    k: int
    seed: int
    seen: int = 0
    updates: int = 0

    @property
    def prior(self) -> float:
        """Symmetric prior of topics in documents and of terms in topics."""
        return 1.0 / self.k

    @property
    def table(self) -> DataFrame:
        # no term is null; said here, so that all joins of an update with the table share one exchange
        return self.spark.read.parquet(f"{self.path}/lam-{self.updates % 2}").where(F.col("term").isNotNull())

    def sums(self) -> np.ndarray:
        row = self.table.agg(*[F.sum(F.col("lam")[j]).alias(f"s{j}") for j in range(self.k)]).first()
        return np.array([x or 0.0 for x in row])

    def store(self) -> None:
        """The state beside the table, so that ``load`` finds both; a table and its state are never half new."""
        state = json.dumps({"k": self.k, "seed": self.seed, "seen": self.seen, "updates": self.updates})
        self.spark.createDataFrame([(self.updates, state)], "updates int, state string").coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TopicModel:
        row = spark.read.parquet(f"{path}/state").orderBy(F.col("updates").desc()).first()
        return TopicModel(spark, path, **json.loads(row["state"]))


def start_weights(term: Column, k: int, seed: int) -> Column:
    """Starting weights: mean 1, variance 0.01, from md5('<term>:<topic>:<seed>')."""
    def one(j: int) -> Column:
        h = F.md5(F.concat(term, F.lit(f":{j}:{seed}")))
        return F.lit(1 - 0.1 * 3 ** 0.5) + F.lit(0.2 * 3 ** 0.5) * (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13)))
    return F.array(*[one(j) for j in range(k)])


def _terms(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode("terms").alias("pos", "term"))


def _weights(model: TopicModel, blocks: DataFrame) -> DataFrame:
    """(of, pos, lam): the weights of the terms of every block ``of``, wherever the model has the term."""
    return _terms(blocks).join(model.table, "term").select(F.col("block").alias("of"), "pos", "lam")


def _with_weights(block: pa.Table, weights: pa.Table, k: int, sums: np.ndarray) -> Iterator[tuple]:
    """(block's columns by name, document-term matrix of the known terms, their exp(E[log beta])) of each block row."""
    pos = weights.column("pos").to_numpy()
    order = np.argsort(pos, kind="stable")
    rows = pc.list_flatten(weights.column("lam").combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, k)[order]
    for i in range(block.num_rows):
        ptr, idx, cnt = (block.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ptr", "idx", "cnt"))
        place = np.full(len(block.column("terms")[i]), -1)
        place[pos[order]] = np.arange(len(pos))
        known = place[idx] >= 0
        ptr = np.r_[0, np.cumsum(known)][ptr]
        yield i, ptr, place[idx[known]], cnt[known].astype(np.float64), rows, pos[order], (exp_elog(rows, sums) if len(rows) else np.zeros((0, k)))


def _contributions(k: int, alpha: float, sums: np.ndarray):
    names = ["term", *[f"s{j}" for j in range(k)]]
    types = [pa.string(), *[pa.float64()] * k]

    def run(block: pa.Table, weights: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in types], names)]
        if block.num_rows and weights.num_rows:
            for i, ptr, idx, cnt, rows, pos, beta in _with_weights(block, weights, k, sums):
                gamma = e_step(ptr, idx, cnt, beta, alpha)
                size = np.diff(ptr)
                theta = np.exp(digamma(gamma) - digamma(gamma.sum(1))[:, None])
                share = cnt / (fits(theta, ptr, idx, beta) + TINY)
                got = np.stack([np.bincount(idx, np.repeat(theta[:, j], size) * share, len(rows)) for j in range(k)], 1) * beta
                terms = block.column("terms")[i].values.take(pa.array(pos))
                out.append(pa.table([terms.cast(pa.string()), *[pa.array(got[:, j]) for j in range(k)]], names))
        return pa.concat_tables(out)
    return run, ", ".join(["term string", *[f"s{j} double" for j in range(k)]])


def update(model: TopicModel, blocks: DataFrame, n_docs: int | None = None, step: float | None = None, grow: bool = True) -> TopicModel:
    """One update from ``blocks``: every document is used once.  Terms the model lacks get their starting weights first
    (``grow``; without it they are left out).

    ``n_docs``: documents in the blocks that are new to the model (counted if not given; 0 when they are gone over
    again).  ``step``: (1 + updates)^-0.5 unless given.  The new table is stored beside the old one.
    """
    size = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    if not size:
        return model
    fresh = _terms(blocks).select("term").distinct().join(model.table.select("term"), "term", "left_anti") if grow else None
    if fresh is not None and not fresh.isEmpty():
        old = _stored(model.table.unionByName(fresh.select("term", start_weights(F.col("term"), model.k, model.seed).alias("lam"))), "topic-grown")
        old.write.mode("overwrite").parquet(f"{model.path}/lam-{model.updates % 2}")
    seen = model.seen + (size if n_docs is None else n_docs)
    rho = (1.0 + model.updates) ** -0.5 if step is None else step
    run, schema = _contributions(model.k, model.prior, model.sums())
    got = (blocks.drop("keys").groupBy("block").cogroup(_weights(model, blocks).groupBy("of")).applyInArrow(run, schema)
           .groupBy("term").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(model.k)]))
    new = model.table.join(got, "term", "left").select("term", F.array(*[
        F.col("lam")[j] * (1 - rho) + rho * (model.prior + F.coalesce(f"s{j}", F.lit(0.0)) * (seen / size)) for j in range(model.k)]).alias("lam"))
    after = TopicModel(model.spark, model.path, model.k, model.seed, seen, model.updates + 1)
    new.write.mode("overwrite").parquet(f"{model.path}/lam-{after.updates % 2}")
    after.store()
    return after


def begin(spark: SparkSession, blocks: DataFrame, k: int, seed: int, path: str | None = None) -> TopicModel:
    """A model with starting weights for all terms of ``blocks``."""
    model = TopicModel(spark, path or fresh_dir(spark, "topic-model"), k, seed)
    _terms(blocks).select("term").distinct().select("term", start_weights(F.col("term"), k, seed).alias("lam")) \
        .write.mode("overwrite").parquet(f"{model.path}/lam-0")
    model.store()
    return model


def in_turns(blocks: DataFrame, batches: int) -> DataFrame:
    """``blocks`` with ``turn``, the batch they belong to.  The turns are two numbers a block and are broadcast: otherwise
    every update would deal out all blocks anew to pick its own."""
    turns = blocks.select("block").withColumn("turn", (F.row_number().over(W.orderBy("block")) - 1) % batches)
    return blocks.join(F.broadcast(turns), "block")


def lda_fit(blocks: DataFrame, k: int = 5, seed: int = 42, batches: int = 6, base_passes: int = 3, path: str | None = None) -> TopicModel:
    """Base fit on the first batch of blocks, then one update for each other batch.  All terms of all blocks are in the model."""
    model = begin(blocks.sparkSession, blocks, k, seed, path)
    parts = in_turns(blocks, batches)
    for p in range(base_passes):
        model = update(model, parts.where("turn = 0").drop("turn"), n_docs=None if p == 0 else 0, step=1.0, grow=False)
    for b in range(1, batches):
        model = update(model, parts.where(F.col("turn") == b).drop("turn"), grow=False)
    return model


def stored_fit(spark: SparkSession, sources: list[str], blocks, **settings) -> TopicModel:
    """The model that this application fitted to the files ``sources`` with the same settings, or a new fit of ``blocks()``."""
    path = fitted_path(spark, "topic-model", sources, **settings)
    if read_or_none(spark, f"{path}/done") is not None:
        return TopicModel.load(spark, path)
    model = lda_fit(blocks(), path=path, **settings)
    spark.createDataFrame([(model.updates,)], "updates int").coalesce(1).write.mode("overwrite").parquet(f"{path}/done")
    return model


# --- what the model gives -----------------------------------------------------


def text_tokens(df: DataFrame, text_col: str = "description", lang_col: str | None = None,
                out: str = "tokens") -> DataFrame:
    """Stop-word-free tokens of the text (the topic model sees texts only)."""
    return df.withColumn(out, tx.tokenize_nostop(tx.pipes_to_space(text_col), lang_col))


def topic_distribution(model: TopicModel, blocks: DataFrame, key: str = "identifier") -> DataFrame:
    """(key, topics): full topic vector per document (no probability cut-off); uniform for one without known terms."""
    k, alpha, sums = model.k, model.prior, model.sums()

    def run(block: pa.Table, weights: pa.Table) -> pa.Table:
        keys, topics = [], [np.zeros((0, k))]
        if weights.num_rows:
            for i, ptr, idx, cnt, _, _, beta in _with_weights(block, weights, k, sums):
                gamma = e_step(ptr, idx, cnt, beta, alpha)
                keys += block.column("keys")[i].as_py()
                topics.append(gamma / gamma.sum(1)[:, None])
        else:
            for some in block.column("keys"):
                keys += some.as_py()
                topics.append(np.full((len(some), k), 1.0 / k))
        flat = np.concatenate(topics).ravel()
        return pa.table([pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * k, pa.int32()), pa.array(flat))],
                        [key, "topics"])
    return blocks.groupBy("block").cogroup(_weights(model, blocks).groupBy("of")).applyInArrow(run, f"{key} string, topics array<double>")


def lda_topics(model: TopicModel, n_terms: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the top terms of every topic (one top-n per topic)."""
    sums = model.sums()
    out = None
    for j in range(model.k):
        w = F.col("lam")[j] / F.lit(float(sums[j] or 1.0))
        top = model.table.select(F.lit(j).alias("topic"), "term", w.alias("weight")).orderBy(F.col("weight").desc(), "term").limit(n_terms)
        top = top.withColumn("rank", (F.row_number().over(W.orderBy(F.col("weight").desc(), "term")) - 1).cast("int"))  # n_terms rows
        out = top if out is None else out.unionByName(top)
    return out.select("topic", "rank", "term", "weight")


def log_perplexity(model: TopicModel, blocks: DataFrame) -> tuple[int, float]:
    """(terms of the model, minus the variational bound per token of the documents)."""
    k, alpha, eta, sums = model.k, model.prior, model.prior, model.sums()

    def docs(block: pa.Table, weights: pa.Table) -> pa.Table:
        bound = tokens = 0.0
        if block.num_rows and weights.num_rows:
            for _, ptr, idx, cnt, _, _, beta in _with_weights(block, weights, k, sums):
                gamma = e_step(ptr, idx, cnt, beta, alpha)
                elog = digamma(gamma) - digamma(gamma.sum(1))[:, None]
                bound += float((cnt * np.log(fits(np.exp(elog), ptr, idx, beta) + TINY)).sum())
                bound += float(((alpha - gamma) * elog).sum() + (log_gamma(gamma) - log_gamma(np.array([alpha]))).sum()
                               + (log_gamma(np.array([alpha * k])) - log_gamma(gamma.sum(1))).sum())
                tokens += float(cnt.sum())
        return pa.table([pa.array([bound]), pa.array([tokens])], ["bound", "tokens"])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bound = 0, 0.0
        for batch in batches:
            lam = batch.column("lam").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n += len(lam)
            bound += float(((eta - lam) * (digamma(lam) - digamma(sums)[None, :])).sum() + (log_gamma(lam) - log_gamma(np.array([eta]))).sum())
        yield pa.record_batch([pa.array([n]), pa.array([bound])], ["n", "bound"])
    d = (blocks.groupBy("block").cogroup(_weights(model, blocks).groupBy("of")).applyInArrow(docs, "bound double, tokens double")
         .agg(F.sum("bound").alias("bound"), F.sum("tokens").alias("tokens")).first())
    t = model.table.select("lam").mapInArrow(terms, "n long, bound double").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound")).first()
    n = int(t["n"] or 0)
    bound = (d["bound"] or 0.0) + (t["bound"] or 0.0) + (float((log_gamma(np.array([eta * n])) - log_gamma(sums)).sum()) if n else 0.0)
    return n, -bound / d["tokens"] if d["tokens"] else 0.0


def topic_class(topics_col: str = "topics"):
    return tx.argmax(F.col(topics_col))


def topic_similarity(p_col: str, q_col: str):
    """round(1 - Jensen-Shannon distance of the two topic vectors, 4)."""
    return F.round(F.lit(1.0) - tx.js_distance(F.col(p_col), F.col(q_col)), 4)

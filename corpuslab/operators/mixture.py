"""Gaussian mixtures with full, tied, diagonal and spherical covariance, fitted by EM on Spark.

MLlib's ``GaussianMixture`` has full covariance only, so the sweep over
covariance types runs its own EM.  The rows are packed into blocks of doubles
and cached once.  Every EM iteration is one distributed pass over them: each
task computes with numpy the responsibilities and the sufficient statistics
(N_k, sum g x, sum g x x^T, sum ln L) of every model still being fitted, and
hands over one vector of sums; Spark adds the vectors up (in a tree where there
are many); the driver only sees k(1 + d + d^2) numbers per model and does the
M-step.  All models of a sweep advance together, so a sweep costs one job per
iteration, not one per model.  The k-means that the models start from likewise:
MLlib finds the first centres for every k, then all k take their steps together
in passes of the same kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REG = 1e-6
COV_TYPES = ("full", "tied", "diag", "spherical")
#: Rows that are worked on at once; bytes of rows in a task of an EM pass (tasks are not fewer than the cores);
#: tasks whose sums go to the driver without a tree.
ROWS, TASK_BYTES, TREE_FROM = 4096, 1 << 21, 64


def n_parameters(k: int, d: int, cov: str) -> int:
    c = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[cov]
    return int(c + k * d + k - 1)


def _precisions(params):
    """Cholesky factors of the precision matrices (k, d, d) and log-determinants."""
    w, mu, cov, kind = params["weights"], params["means"], params["covs"], params["kind"]
    k, d = mu.shape
    if kind == "full":
        covs = cov
    elif kind == "tied":
        covs = np.repeat(cov[None], k, axis=0)
    elif kind == "diag":
        covs = np.stack([np.diag(c) for c in cov])
    else:
        covs = np.stack([np.eye(d) * c for c in cov])
    chol = np.linalg.cholesky(covs)
    logdet = 2.0 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1)
    return chol, logdet, np.log(w)


def log_resp(X: np.ndarray, params) -> tuple[np.ndarray, np.ndarray]:
    """Per row: log sum_k pi_k N(x | mu_k, S_k) and the log responsibilities."""
    chol, logdet, logw = _precisions(params)
    d = X.shape[1]
    z = np.linalg.inv(chol) @ (X.T[None] - params["means"][:, :, None])  # (k, d, n)
    lp = -0.5 * (d * math.log(2 * math.pi) + logdet[:, None] + np.einsum("kdn,kdn->kn", z, z)) + logw[:, None]
    mx = lp.max(axis=0)
    lse = mx + np.log(np.exp(lp - mx).sum(axis=0))
    return lse, (lp - lse).T


def _moments(X: np.ndarray) -> np.ndarray:
    """1, x and x x^T of every row."""
    return np.concatenate([np.ones((len(X), 1)), X, (X[:, :, None] * X[:, None, :]).reshape(len(X), -1)], axis=1)


def _stats(moments: np.ndarray, resp: np.ndarray, d: int) -> np.ndarray:
    s = resp.T @ moments
    return np.concatenate([s[:, 0], s[:, 1:1 + d].ravel(), s[:, 1 + d:].ravel()])


def _m_step(stats: np.ndarray, n: float, k: int, d: int, kind: str):
    nk = stats[:k] + 10 * np.finfo(float).eps
    sx = stats[k:k + k * d].reshape(k, d)
    sxx = stats[k + k * d:k + k * d + k * d * d].reshape(k, d, d)
    mu = sx / nk[:, None]
    if kind == "full":
        cov = sxx / nk[:, None, None] - np.einsum("ki,kj->kij", mu, mu) + REG * np.eye(d)[None]
    elif kind == "tied":
        cov = (sxx.sum(axis=0) - np.einsum("k,ki,kj->ij", nk, mu, mu)) / nk.sum() + REG * np.eye(d)
    else:
        var = np.einsum("kii->ki", sxx) / nk[:, None] - mu * mu + REG
        cov = var if kind == "diag" else var.mean(axis=1)
    return {"weights": nk / n, "means": mu, "covs": cov, "kind": kind}


def _blocks(df: DataFrame, d: int) -> RDD:
    """The column ``x`` as blocks of rows x d doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = pc.list_value_length(batch.column("x"))
                if sizes.null_count or pc.any(pc.not_equal(sizes, d)).as_py():
                    raise ValueError(f"rows that are not of {d} numbers")
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.record_batch([pa.array([x.tobytes()])], ["x"])

    def join(rows: Iterator) -> Iterator[np.ndarray]:
        held, size = [], 0
        for r in rows:
            held.append(np.frombuffer(r["x"]).reshape(-1, d))
            size += len(held[-1])
            if size >= ROWS:
                yield np.concatenate(held)
                held, size = [], 0
        if held:
            yield np.concatenate(held)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() * d * 8 / TASK_BYTES))
    return df.select("x").mapInArrow(pack, "x binary").rdd.coalesce(tasks).mapPartitions(join)


def _pass(blocks: RDD, d: int, models: dict, hard: bool = False) -> dict:
    """One distributed pass: rows, log-likelihood and summed statistics per model, soft for its parameters, or hard
    (``models`` has the centres of every k) for the nearest centre, the first on ties."""
    ks = {m: m if hard else len(p["weights"]) for m, p in models.items()}
    ends = np.cumsum([0, *[2 + k * (1 + d + d * d) for k in ks.values()]])

    def fn(of_task: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        out = np.zeros(ends[-1])
        for rows in of_task:
            for i in range(0, len(rows), ROWS):
                X = rows[i:i + ROWS]
                moments = _moments(X)
                for at, (m, params) in zip(ends, models.items()):
                    if hard:
                        resp, ll = np.zeros((len(X), m)), 0.0
                        resp[np.arange(len(X)), ((X[:, None] - params[None]) ** 2).sum(axis=2).argmin(axis=1)] = 1.0
                    else:
                        lse, lr = log_resp(X, params)
                        resp, ll = np.exp(lr), float(lse.sum())
                    st = _stats(moments, resp, d)
                    out[at] += len(X)
                    out[at + 1] += ll
                    out[at + 2:at + 2 + len(st)] += st
        yield out

    summed = blocks.mapPartitions(fn).treeReduce(np.add, depth=1 if blocks.getNumPartitions() <= TREE_FROM else 2)
    return {m: summed[a:b] for m, a, b in zip(models, ends, ends[1:])}


def _first_centres(df: DataFrame, ks: list[int], seed: int) -> dict[int, np.ndarray]:
    """MLlib's starting centres (k-means||) for every k > 1, of the vector column ``v``."""
    def fit(k: int) -> np.ndarray:
        return np.array(KMeans(k=k, seed=seed, featuresCol="v", predictionCol="_k", maxIter=0).fit(df).clusterCenters())
    return {k: fit(k) for k in ks}


def _kmeans(blocks: RDD, d: int, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The centres after MLlib's k-means steps from ``centres``: a centre without rows stays, a k is done once no centre
    moves by more than the tolerance.  One pass a step for all k."""
    settings, centres = KMeans(), dict(centres)
    live = list(centres)
    for _ in range(settings.getMaxIter()):
        if not live:
            break
        st = _pass(blocks, d, {k: centres[k] for k in live}, hard=True)
        for k in list(live):
            old = centres[k]
            nk, sx = st[k][2:2 + len(old), None], st[k][2 + k:2 + k + k * d].reshape(k, d)[:len(old)]
            centres[k] = np.where(nk > 0, sx / np.maximum(nk, 1), old)
            if (((centres[k] - old) ** 2).sum(axis=1) <= settings.getTol() ** 2).all():
                live.remove(k)
    return centres


def em_sweep(df: DataFrame, configs: list[tuple[int, str]], x_col: str = "x", seed: int = 0,
             max_iter: int = 100, tol: float = 1e-3) -> list[dict]:
    """Fit one mixture per (k, covariance type) config; returns their parameters,
    mean log-likelihood, BIC and iteration count.  Initialised from k-means."""
    blocks = None
    data = df.select(F.col(x_col).cast("array<double>").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        d = len(data.first()["x"])
        ks = sorted({k for k, _ in configs})
        first = _first_centres(data.withColumn("v", array_to_vector("x")), [k for k in ks if k > 1], seed)
        blocks = _blocks(data, d).persist(StorageLevel.MEMORY_AND_DISK)
        kinds = dict(enumerate(configs))
        # Initial M-step from hard k-means labels: one pass, the models of a k share its statistics.
        centres = _kmeans(blocks, d, first) | {k: np.zeros((1, d)) for k in ks if k == 1}
        st = _pass(blocks, d, centres, hard=True)
        params = {m: _m_step(st[k][2:], st[k][0], k, d, kind) for m, (k, kind) in kinds.items()}
        state = {m: {"params": params[m], "ll": -np.inf, "iter": 0, "done": False, "hist": []} for m in kinds}
        for _ in range(max_iter):
            active = {m: s["params"] for m, s in state.items() if not s["done"]}
            if not active:
                break
            st = _pass(blocks, d, active)
            for m in active:
                n, ll = st[m][0], st[m][1] / st[m][0]
                k, kind = kinds[m]
                s = state[m]
                s["iter"] += 1
                s["hist"].append(ll)
                if abs(ll - s["ll"]) < tol:
                    s["done"] = True
                s["ll"] = ll
                s["params"] = _m_step(st[m][2:], n, k, d, kind)
        # Final likelihood under the final parameters (one more pass for all).
        st = _pass(blocks, d, {m: s["params"] for m, s in state.items()})
        out = []
        for m, s in state.items():
            k, kind = kinds[m]
            n, ll = st[m][0], st[m][1]
            out.append({"k": k, "covariance_type": kind, "params": s["params"], "mean_loglik": ll / n,
                        "bic": -2.0 * ll + n_parameters(k, d, kind) * math.log(n), "n_iter": s["iter"],
                        "loglik_history": s["hist"] + [ll / n]})
        return out
    finally:
        if blocks is not None:
            blocks.unpersist()
        data.unpersist()


def predict(df: DataFrame, params: dict, x_col: str = "x", out: str = "class") -> DataFrame:
    """Hard labels: the component with the largest responsibility."""
    from pyspark.sql.types import IntegerType, StructField, StructType
    schema = StructType([*list(df.schema.fields), StructField(out, IntegerType())])

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[x_col].to_numpy()).astype(np.float64)
            _, lr = log_resp(X, params)
            yield pdf.assign(**{out: lr.argmax(axis=1).astype("int32")})
    return df.mapInPandas(fn, schema)


def gmm_fit_assign(df: DataFrame, k: int = 6, seed: int = 0, features: str = "features") -> DataFrame:
    """MLlib Gaussian mixture (full covariance), hard labels in ``class``."""
    gm = GaussianMixture(k=k, seed=seed, featuresCol=features, predictionCol="class",
                         probabilityCol="probability")
    return gm.fit(df).transform(df)

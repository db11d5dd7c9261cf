"""The mixture sweep's jobs, its k-means steps and its statistics (own rows)."""
import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from corpuslab.operators import mixture as mx
from corpuslab.operators import topics as tp
from corpuslab.plans import queries as q


def rows(n=240, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [6, 6, 0], [0, 6, 6], [6, 0, 3]], dtype=float)
    return [[float(v) for v in rng.normal(centres[i % 4], 1.0)] for i in range(n)]


def table(spark, x):
    df = spark.createDataFrame([(v,) for v in x], "x array<double>").repartition(3).persist()
    df.count()
    return df


def jobs(spark, group, run):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_an_iteration_of_all_models_is_one_job(spark):
    df = table(spark, rows())
    configs = [(k, c) for c in ("tied", "diag", "full") for k in (1, 2, 3)]
    few, many = (jobs(spark, f"sweep-{n}", lambda: mx.em_sweep(df, configs, max_iter=n, tol=-1.0)) for n in (1, 7))
    assert many - few == 6


def test_kmeans_steps_are_mllibs(spark):
    vec = table(spark, rows(seed=1)).withColumn("v", array_to_vector("x")).persist()
    vec.count()
    ks = [2, 3, 4, 6]
    got = mx._kmeans(mx._blocks(vec, 3), 3, mx._first_centres(vec, ks, 5))
    for k in ks:
        want = np.array(KMeans(k=k, seed=5, featuresCol="v").fit(vec).clusterCenters())
        assert np.allclose(got[k], want, rtol=0, atol=1e-9)


def test_fewer_distinct_rows_than_components(spark):
    fits = mx.em_sweep(table(spark, [[float(i % 2), 1.0] for i in range(30)]), [(1, "diag"), (4, "diag")])
    assert all(np.isfinite(f["bic"]) for f in fits)
    assert np.allclose(sorted(fits[1]["params"]["weights"]), [0, 0, 0.5, 0.5], atol=1e-9)


@pytest.mark.parametrize("tree_from", [1, 64])
def test_soft_and_hard_sums_equal_plain_ones(spark, monkeypatch, tree_from):
    monkeypatch.setattr(mx, "TREE_FROM", tree_from)
    monkeypatch.setattr(mx, "ROWS", 7)
    x = rows(60, 2)
    X = np.array(x)
    blocks = mx._blocks(table(spark, x), 3)
    centres = X[:3]
    nearest = ((X[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    hard = mx._pass(blocks, 3, {3: centres}, hard=True)[3]
    resp = np.eye(3)[nearest]
    assert np.allclose(hard, np.r_[60, 0, resp.sum(0), (resp.T @ X).ravel(), np.einsum("nk,ni,nj->kij", resp, X, X).ravel()])
    params = {}
    for kind in mx.COV_TYPES:
        params[kind] = mx._m_step(hard[2:], 60, 3, 3, kind)
    got = mx._pass(blocks, 3, params)
    for kind, p in params.items():
        cov = {"full": p["covs"], "tied": [p["covs"]] * 3}.get(kind)
        cov = cov if cov is not None else [np.diag(np.broadcast_to(c, 3)) for c in p["covs"]]
        dens = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", X - m, np.linalg.inv(c), X - m)) / np.sqrt(np.linalg.det(2 * np.pi * c))
                         for w, m, c in zip(p["weights"], p["means"], cov)], axis=1)
        r = dens / dens.sum(axis=1, keepdims=True)
        want = np.r_[60, np.log(dens.sum(axis=1)).sum(), r.sum(0), (r.T @ X).ravel(), np.einsum("nk,ni,nj->kij", r, X, X).ravel()]
        assert np.allclose(got[kind], want, rtol=1e-7), kind


def test_rows_of_other_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, 2.0, 3.0],)], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="not of 2 numbers"):
        mx._pass(mx._blocks(df, 2), 2, {1: np.zeros((1, 2))}, hard=True)


def test_blocks_are_stored_once_for_fit_and_distribution(spark, tmp_path, monkeypatch):
    docs = [(i, f"First words number {i} of a text that is long enough here.\nSecond line {i}. Third sentence.", "en", "web", 80) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stored, doc_blocks = [], tp.doc_blocks
    monkeypatch.setattr(tp, "doc_blocks", lambda *a, **b: stored.append(doc_blocks(*a, **b)) or stored[-1])
    monkeypatch.setattr(tp, "lda_fit", lambda blocks, k, seed, path: tp.begin(spark, blocks, k, seed, path))
    features = q.clustering_features(spark, str(tmp_path))
    assert len(stored) == 1
    assert features.count() == 11  # document 0 misses its description

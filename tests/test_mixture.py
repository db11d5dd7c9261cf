"""Mixtures and k-means on planted data (own generator, 3 components x 500 points)."""
import numpy as np

from corpuslab.operators import cluster as cl
from corpuslab.operators import mixture as mx


def planted(spark, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 8, 0], [0, 8, 8]], dtype=float)
    rows = []
    for c, mu in enumerate(centres):
        for p in rng.normal(mu, 1.0, size=(500, 3)):
            rows.append((c, [float(v) for v in p]))
    return spark.createDataFrame(rows, "truth int, x array<double>")


def test_bic_sweep_finds_three(spark):
    df = planted(spark)
    fits = mx.em_sweep(df, [(k, t) for t in ("full", "diag") for k in (1, 2, 3, 4, 5)], seed=0)
    best = min(fits, key=lambda f: f["bic"])
    assert best["k"] == 3
    labels = mx.predict(df, best["params"]).groupBy("truth", "class").count().collect()
    purity = sum(max(r["count"] for r in labels if r["truth"] == t) for t in range(3)) / 1500
    assert purity > 0.99


def test_tied_and_spherical_run_and_likelihood_never_falls(spark):
    df = planted(spark, 1)
    fits = mx.em_sweep(df, [(3, "tied"), (3, "spherical"), (4, "full"), (2, "diag")], seed=0)
    for f in fits:
        assert np.isfinite(f["bic"]) and f["n_iter"] >= 1
        h = f["loglik_history"]
        assert all(b >= a - 1e-9 for a, b in zip(h, h[1:])), (f["covariance_type"], h)


def test_parameter_counts():
    assert mx.n_parameters(3, 3, "full") == 3 * 6 + 9 + 2
    assert mx.n_parameters(3, 3, "tied") == 6 + 9 + 2
    assert mx.n_parameters(3, 3, "diag") == 9 + 9 + 2
    assert mx.n_parameters(3, 3, "spherical") == 3 + 9 + 2


def test_kmeans_elbow_and_knee(spark):
    df = cl.array_features(planted(spark), "x")
    pts = cl.elbow(df, range(1, 7), seed=0)
    assert pts[0][1] > pts[1][1] > pts[2][1]
    assert cl.knee(pts) == 3


def test_fixed_centre_audit_is_empty(spark):
    df = planted(spark)
    centres = cl.centres_by_label(df, "x", "truth", 3)
    a = cl.assign_to_centres(df.withColumn("id", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id()), "x", centres)
    assert cl.audit(a, a, "id").count() == 0

"""k-means: fit (MLlib), the assignment step, elbow sweep and re-assignment audit.

Centres are k x d numbers.  They are read back to the driver only after a
check that k is small, and enter the plan as an array literal, so assigning a
row is one per-row expression: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import let

MAX_CENTRES = 10_000


def centres_by_label(df: DataFrame, vec_col: str, label_col: str, dim: int) -> list[tuple[int, list[float]]]:
    """Mean vector per label (one aggregate pass); returns [(label, centre)] sorted by label."""
    k = df.select(label_col).distinct().count()
    if k > MAX_CENTRES:
        raise ValueError(f"{k} labels: too many centres to hold as a literal")
    means = df.groupBy(label_col).agg(*[F.avg(F.col(vec_col)[i]).alias(f"c{i}") for i in range(dim)])
    rows = sorted(means.collect(), key=lambda r: r[label_col])
    return [(r[label_col], [float(r[f"c{i}"]) for i in range(dim)]) for r in rows]


def nearest(vec, centres: list[list[float]]) -> Column:
    """struct(idx, dist): 0-based index of the nearest centre (squared Euclidean;
    first on ties) and that squared distance."""
    lit_c = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])

    def body(v):
        x = v["x"]
        d = F.transform(lit_c, lambda c: F.aggregate(
            F.zip_with(x, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
            F.lit(0.0), lambda s, t: s + t))
        return let({"d": d}, lambda w: F.struct(
            (F.array_position(w["d"], F.array_min(w["d"])) - 1).cast("int").alias("idx"),
            F.array_min(w["d"]).alias("dist")))
    return let({"x": vec}, body)


def assign_to_centres(df: DataFrame, vec_col: str, centres: list[tuple[int, list[float]]],
                      out: str = "class") -> DataFrame:
    """The k-means predict step against given centres; class = the centre's label."""
    labels = F.array(*[F.lit(lab) for lab, _ in centres])
    n = nearest(F.col(vec_col), [c for _, c in centres])
    return df.withColumn("_n", n).withColumn(out, F.element_at(labels, F.col("_n.idx") + 1)) \
        .withColumn("dist", F.col("_n.dist")).drop("_n")


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Numeric columns -> one vector column (unscaled, as in the reference)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def array_features(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col)))


def kmeans_fit(df: DataFrame, k: int = 6, seed: int = 0, features: str = "features",
               max_iter: int = 20) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="class", initMode="k-means||",
                  maxIter=max_iter).fit(df)


def kmeans_fit_assign(df: DataFrame, k: int = 6, seed: int = 0, features: str = "features") -> DataFrame:
    """Fit and predict; predictions keep their row's id (no positional concat)."""
    model = kmeans_fit(df, k, seed, features)
    return model.transform(df)


def total_variance(df: DataFrame, features: str = "features") -> float:
    """Within-cluster sum of squares for k = 1 (MLlib rejects k = 1): the sum of
    squared distances to the mean, which a pass before has found (a difference of
    two large sums would lose digits); 0 for an empty table."""
    arr = df.select(vector_to_array(features).alias("a"))
    first = arr.first()
    if first is None:
        return 0.0
    mean = arr.agg(*[F.avg(F.col("a")[i]) for i in range(len(first["a"]))]).first()
    off = lambda i: F.col("a")[i] - F.lit(mean[i])
    return float(sum(arr.agg(*[F.sum(off(i) * off(i)) for i in range(len(mean))]).first()))


def elbow(df: DataFrame, ks=range(1, 12), seed: int = 0, features: str = "features") -> list[tuple[int, float]]:
    """Distortion (within-cluster sum of squares) per k; each fit is a distributed job."""
    out = []
    for k in ks:
        if k == 1:
            out.append((1, total_variance(df, features)))
        else:
            m = kmeans_fit(df, k, seed, features)
            out.append((k, float(m.summary.trainingCost)))
    return out


def knee(points: list[tuple[int, float]]) -> int:
    """The k farthest from the chord between the first and last points of the
    normalised curve (the 11-row result, on the driver)."""
    xs = [p[0] for p in points]
    ys = [p[1] for p in points]
    x0, x1, y0, y1 = xs[0], xs[-1], ys[0], ys[-1]
    if x1 == x0 or y1 == y0:
        return xs[0]
    nx = [(x - x0) / (x1 - x0) for x in xs]
    ny = [(y - y1) / (y0 - y1) for y in ys]
    dist = [abs(a + b - 1) for a, b in zip(nx, ny)]
    return xs[max(range(len(xs)), key=lambda i: dist[i])]


def audit(stored: DataFrame, repredicted: DataFrame, key: str, stored_col: str = "class",
          new_col: str = "class") -> DataFrame:
    """Rows whose stored class differs from the re-predicted one (expected: none)."""
    a = stored.select(key, F.col(stored_col).alias("stored_class"))
    b = repredicted.select(key, F.col(new_col).alias("predicted_class"))
    return a.join(b, key, "inner").where(F.col("stored_class") != F.col("predicted_class"))

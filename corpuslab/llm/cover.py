"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors with cosine >= t lie within r = sqrt(2 - 2t) of each other.

1. Equal vectors of one label form a class; its members link with each other
   and share all other links, so copies are counted and not compared.
2. The top of the tree: pivots, at most ``PIVOTS`` vectors in all, chosen by
   hash; every class joins the cell of the nearest pivot of its label, and a
   cell is split by hash into nodes of about ``NODE`` classes.  A node's
   covering radius is the largest distance to its pivot.  Nodes of one label
   are paired unless the distance of their pivots exceeds both radii plus r.
3. Inside a node a cover tree continues with nested levels of halving radii;
   two nodes are traversed together from their roots, pairs of tree nodes
   farther apart than both covering radii plus r are dropped, and pairs of
   leaves are compared exactly.
4. A traversal reports how many vectors each class links with and, for
   components, each class's smallest partner in every connected part, so its
   output is as large as its nodes and not as its links.

Every pair of classes with one label is in some pair of nodes or was excluded
by a bound, so the result is exact; the pivots only decide how much is pruned.

Edge cases: rows with a null label, or whose vector is null, empty, zero or
holds nulls, NaN or infinities, link with nothing and are their own component
(kept); vectors of different lengths do not link; a null vec_id never names a
component; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import read, saved
from corpuslab.llm.graph import components

COSINE = 0.93
PIVOTS = 64
NODE = 1500
LEAF = 16
SLACK = 1e-9


class Tree:
    """A cover tree: per node a centre, a covering radius, its children or its points."""

    def __init__(self, x: np.ndarray):
        self.x, self.centre, self.radius, self.kids, self.points = x, [], [], [], []
        if len(x):
            self._grow(np.arange(len(x)), 0, 1.0)

    def _grow(self, at: np.ndarray, centre: int, step: float) -> int:
        """A node over the points ``at``; its children's centres are farther than ``step`` apart."""
        me = len(self.centre)
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[at] @ self.x[centre])))
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.kids.append([])
        self.points.append(None)
        if len(at) <= LEAF or d.max() < 1e-7:
            self.points[me] = at
            return me
        while step >= d.max():
            step /= 2
        left, c = at, centre
        parts = []
        while len(left):                                   # a net: the parent's centre first, so that levels are nested
            near = np.sqrt(np.maximum(0, 2 - 2 * (self.x[left] @ self.x[c]))) <= step
            near |= left == c
            parts.append((c, left[near]))
            left = left[~near]
            if len(left):
                c = int(left[0])
        alone = np.array([p[0] for _, p in parts if len(p) == 1], np.int64)
        self.kids[me] = [self._grow(p, c, step / 2) for c, p in parts if len(p) > 1]
        for k in range(0, len(alone), LEAF):               # single points need no tree of their own
            self.kids[me].append(self._grow(alone[k:k + LEAF], int(alone[k]), step / 2))
        return me


def dual(a: Tree, b: Tree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of point arrays that may hold points within ``reach`` of each other."""
    if not len(a.x) or not len(b.x):
        return
    ca, cb, ra, rb = (np.array(v) for v in (a.centre, b.centre, a.radius, b.radius))
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        ii = np.array([i] if a.points[i] is not None else a.kids[i])
        jj = np.array([j] if b.points[j] is not None else b.kids[j])
        d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[ca[ii]] @ b.x[cb[jj]].T)))
        for p, q in zip(*np.nonzero(d <= ra[ii][:, None] + rb[jj][None, :] + reach + SLACK)):
            p, q = int(ii[p]), int(jj[q])
            if a.points[p] is not None and b.points[q] is not None:
                yield a.points[p], b.points[q]
            else:
                todo.append((p, q))


def _compare(cosine: float):
    reach = float(np.sqrt(2 - 2 * cosine))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, many = table.column("class").to_numpy(), table.column("many").to_numpy()
        x = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a node with itself
        count = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        edges = []
        ta = Tree(x[one])
        tb = ta if (side == 2).all() else Tree(x[two])
        for p, q in dual(ta, tb, reach):
            p, q = one[p], two[q]
            near = x[p] @ x[q].T >= cosine
            near &= p[:, None] != q[None, :]
            if near.any():
                count[p] += near @ many[q]
                if not (side == 2).all():
                    count[q] += near.T @ many[p]
                u, v = np.nonzero(near)
                edges.append(np.stack([p[u], q[v]]))
        if edges:
            u, v = np.unique(np.concatenate(edges, axis=1), axis=1)
            while True:                                    # smallest class of every connected part
                new = label.copy()
                low = np.minimum(label[u], label[v])
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
        hit = count > 0
        return pa.table({"class": ids[hit], "n": count[hit], "partner": ids[label[hit]]})
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("norm", F.when(F.col("label").isNotNull() & (F.size("v") > 0) & fine, norm))
    rows = rows.withColumn("v", F.when(F.col("norm") > 0, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    rows = rows.withColumn("group", F.when(F.col("v").isNotNull(), F.concat_ws("/", F.size("v"), "label")))
    rows = rows.withColumn("class", F.when(F.col("v").isNotNull(), F.xxhash64("group", "v")))
    rows = saved(rows, "vectors")
    classes = saved(rows.where("class is not null").groupBy("class").agg(
        F.count("*").alias("many"), F.first("group").alias("group"),
        F.first(F.transform("v", lambda x: x / F.col("norm"))).alias("unit")), "vector-classes")

    few = classes.orderBy(F.xxhash64("class"), "class").limit(PIVOTS).select("group", "class", "unit").collect()
    by_group: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in few:
        ids, units = by_group.get(r["group"], ([], []))
        by_group[r["group"]] = (ids + [r["class"]], units + [r["unit"]])
    by_group = {g: (np.array(i), np.array(u)) for g, (i, u) in by_group.items()}
    pivots = spark.sparkContext.broadcast(by_group)        # PIVOTS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, u in zip(batch.column("group").to_pylist(), batch.column("unit")):
                ids, units = pivots.value.get(g, (None, None))
                x = np.asarray(u.values)
                if ids is None:                            # a label without a pivot: cell 0 about its own first axis
                    units, ids = np.eye(1, len(x)), np.array([0])
                c = units @ x
                k = int(c.argmax())
                out.append((int(ids[k]), float(np.sqrt(max(0.0, 2 - 2 * c[k]))), units[k].tolist()))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([batch.column("class"), batch.column("group"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()),
                                   pa.array(cols[2], pa.list_(pa.float64()))], names=["class", "group", "cell", "away", "pivot"])
    cells = saved(classes.select("class", "group", "unit").mapInArrow(
        assign, "class long, group string, cell long, away double, pivot array<double>"), "vector-cells")
    parts = cells.groupBy("group", "cell").agg(F.ceil(F.count("*") / NODE).cast("int").alias("parts"))
    noded = cells.join(parts, ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("class", F.lit(7)), "parts"))
    key = F.struct("cell", "part")
    nodes = noded.groupBy("group", key.alias("node")).agg(F.max("away").alias("radius"), F.first("pivot").alias("pivot"))
    nodes = saved(nodes, "vector-nodes")
    a = nodes.select("group", F.col("node").alias("a"), F.col("radius").alias("ra"), F.col("pivot").alias("pa"))
    b = nodes.select("group", F.col("node").alias("b"), F.col("radius").alias("rb"), F.col("pivot").alias("pb"))
    apart = F.sqrt(F.aggregate(F.zip_with("pa", "pb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = (a.join(b, "group").where(F.col("a") <= F.col("b"))
             .where(apart <= F.col("ra") + F.col("rb") + float(np.sqrt(2 - 2 * cosine)) + SLACK))
    sides = pairs.select("group", F.xxhash64("group", "a", "b").alias("pair"), F.explode(
        F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(2).alias("side"))))
        .otherwise(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select("group", "pair", "s.node", "s.side")
    placed = noded.select("class", "group", key.alias("node")).join(classes.select("class", "many", "unit"), "class")
    found = saved(sides.join(placed, ["group", "node"]).select("pair", "side", "class", "many", "unit")
                  .groupBy("pair").applyInArrow(_compare(cosine), "class long, n long, partner long"), "vector-links")

    n = found.groupBy("class").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("class").alias("a"), F.col("partner").alias("b")))
    least = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    named = least.join(n, "class", "left").join(group.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    out = rows.select("vec_id", "class").join(named, "class", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") + F.col("many") - 1, F.col("many") - 1, F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``embeddings`` inside each label at a cosine of 0.93."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))

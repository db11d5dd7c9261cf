"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 32-bit ring.  A key belongs to the arc
that ends in the next point clockwise, and that point's shard takes it unless
the shard is full; then the key walks on clockwise to the next shard with room.
Loads are bounded exactly: shard i may hold ``floor(n / shards)`` rows, one
more for the first ``n mod shards`` shards, so after the walk every shard is
exactly full and two shards differ by one row at most (law ``rows``).

How it runs: keys of one arc are interchangeable for the walk, so the walk
needs only the number of keys on each arc, at most ``shards * vnodes`` counts
whatever the number of rows.  Spark counts them, the driver walks the ring once
over those counts, and rows find their shard by their rank inside the arc.  An
arc's rows are ranked in sub-ranges of the ring (``cells`` in all), so that no
task ranks more than about 1/cells of the rows; one key or text that holds many
rows does not land in one place, since the ring position comes from doc_id and,
among equal doc_ids, from the text.

Edge cases: a null or empty text has size 1; a null doc_id hashes as its own
key; repeated rows are separate rows and stay interchangeable; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.common import n_bytes, read, saved

RING = 1 << 32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard-{s}/vnode-{v}".encode()), s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, one past the last, shard) for every run of keys.

    ``counts`` has the keys of each arc.  First every shard keeps its own keys
    clockwise as far as it has room; then what overflowed walks on, arc by arc,
    to the next shards with room.
    """
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out, over = [], []
    for arc, (_, s) in enumerate(points):
        c = counts.get(arc, 0)
        stay = min(c, room[s])
        room[s] -= stay
        if stay:
            out.append((arc, 0, stay, s))
        if c > stay:
            over.append((arc, stay, c))
    for arc, at, end in over:
        k = arc
        while at < end:
            k = (k + 1) % len(points)
            s = points[k][1]
            take = min(end - at, room[s])
            if take:
                out.append((arc, at, at + take, s))
                room[s] -= take
                at += take
    return out


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 128, cells: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless rank in the shard) of every row."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    cuts = np.array([p for p, _ in points])

    @F.pandas_udf("int")
    def arc_of(pos: pd.Series) -> pd.Series:               # the point at or after pos, clockwise
        return pd.Series(np.searchsorted(cuts, pos.to_numpy()) % len(cuts))

    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        "doc_id", (n_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("pos"))
    keys = keys.withColumn("arc", arc_of("pos")).withColumn("cell", (F.col("pos") / F.lit(RING / cells)).cast("int"))
    keys = saved(keys, "ring-keys")
    by_cell = keys.groupBy("arc", "cell").count()          # at most shards * vnodes + cells rows
    cell_counts = sorted((r["arc"], r["cell"], r["count"]) for r in by_cell.collect())
    counts: dict[int, int] = {}
    firsts = []                                            # rank in the arc at which a cell begins
    for arc, cell, c in cell_counts:
        firsts.append((arc, cell, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + c
    runs, filled = [], [0] * shards
    for arc, a, b, s in sorted(walk(counts, points, shards)):
        runs.append((arc, a, b, s, filled[s]))             # slots of the run begin where the shard's last run ended
        filled[s] += b - a
    first = spark.createDataFrame(firsts, "arc int, cell int, first long")
    # a cell meets at most a few runs: one row per (arc, cell) with its runs, bounded by the ring's size
    run = spark.createDataFrame(runs, "arc int, a long, b long, shard int, slot0 long").groupBy("arc").agg(
        F.collect_list(F.struct("a", "b", "shard", "slot0")).alias("runs"))
    ranked = keys.withColumn("k", F.row_number().over(
        W.partitionBy("arc", "cell").orderBy("pos", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")) - 1)
    placed = (ranked.join(F.broadcast(first), ["arc", "cell"]).join(F.broadcast(run), "arc")
              .withColumn("k", F.col("k") + F.col("first"))
              .withColumn("run", F.filter("runs", lambda r: (r["a"] <= F.col("k")) & (F.col("k") < r["b"]))[0]))
    return placed.select("doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"),
                         (F.col("run.slot0") + F.col("k") - F.col("run.a")).alias("slot"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` over shards 0 to 7 under the law ``rows``."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

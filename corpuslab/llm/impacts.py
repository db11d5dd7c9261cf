"""Exact top-k by inner product over integer vectors: an impact-ordered index, read score at a time.

Rows are packed into blocks.  In a block every dimension gives two posting lists, one for queries that are positive there
(the impact of a row is how far its component lies above the block's least) and one for negative ones (how far it lies
below the block's greatest), so no impact is negative.  Impacts are quantised to ``LEVELS`` levels of a list's own step; the
rows of a list with levels in one band are a segment.  A group of queries reads the segments of all lists band by band, from
the highest impacts down, and adds weight times impact to its accumulators (a band's segments are a matrix, so a group reads them
in one product).  From the levels not yet read it is known how much any row can still gain.  A query stops when all rows but
a few are proven to stay below the k-th best score known, and scores those few exactly.

Every query first searches its own block, which gives it a score to beat; then query groups meet all other blocks,
a block and at most ``HALF`` groups in a task.  Nothing is approximate and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.common import read, saved
from corpuslab.llm.textnp import tidy

K = 5
EVERY = 50
#: Rows of a block, levels of an impact, least levels of the bands in which they are read, rows left that are scored exactly at once.
BLOCK, LEVELS, BANDS, FEW = 8192, 256, (128, 64, 16, 1), 32
#: Queries of a group, groups that meet a block in one task.
GROUP, HALF = 256, 64
LONG = (1 << 63) - 1

VECTORS = "vec_id long, term int, dims int, kind string, vec binary"


def _parsed(scale: float) -> callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, x in zip(batch.column("vec_id").to_pylist(), batch.column("vec")):
                values = x.values
                if values is None or values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(v).all():
                    continue
                top = int(np.abs(v).argmax()) if len(v) else 0
                most = float(np.abs(v).max()) if len(v) else 0.0
                kind = next((t for t, room in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 53)) if most < room), "<f8")
                out.append((key, 2 * top + int(len(v) > 0 and v[top] < 0), len(v), kind, v.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()))],
                ["vec_id", "term", "dims", "kind", "vec"])
    return run


def matrix(dims: list[int], kinds: list[str], vecs: list[bytes]) -> np.ndarray:
    """Rows as float64 (each component is a whole number that float64 holds), short ones filled up with zeros."""
    out = np.zeros((len(vecs), max(dims, default=0)))
    for i, (d, k, v) in enumerate(zip(dims, kinds, vecs)):
        out[i, :d] = np.frombuffer(v, k)
    return out


class Block:
    """The impact-ordered index of some rows."""

    def __init__(self, uid: np.ndarray, ids: list[int | None], rows: np.ndarray) -> None:
        self.uid, self.ids, self.rows = uid, ids, rows
        n, d = rows.shape
        self.low, self.high = (rows.min(0), rows.max(0)) if n else (np.zeros(d), np.zeros(d))
        self.span = self.high - self.low
        self.step = np.maximum(1.0, np.ceil((self.span + 1) / LEVELS))
        self.bands: dict[int, np.ndarray] = {}

    def band(self, at: int) -> np.ndarray:
        """The segments of one band: for each row its levels in the lists of positive, then of negative queries, 0 where the row
        stands in another band's segment."""
        if at not in self.bands:
            gain = np.concatenate([self.rows - self.low, self.high - self.rows], 1)
            level = gain // np.tile(self.step, 2)
            self.bands[at] = np.where((level >= BANDS[at]) & (level < (BANDS[at - 1] if at else LEVELS)), level, 0.0)
        return self.bands[at]

    def exact(self, q: np.ndarray, some: np.ndarray) -> list[int]:
        a = self.rows[some]
        if float(np.abs(a).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2 ** 53:
            return [int(x) for x in a @ q]
        whole = [int(y) for y in q]
        return [sum(int(x) * y for x, y in zip(r, whole)) for r in a]

    def search(self, q: np.ndarray, own: np.ndarray, beat: np.ndarray, k: int) -> list[list[tuple[int, int | None]]]:
        """Of every query (a row of ``q``, itself the row ``own`` if that is here): the ``k`` best (score, id) of the other rows,
        without some of those that score less than ``beat``."""
        d = self.rows.shape[1]
        q = q[:, :d] if q.shape[1] >= d else np.pad(q, ((0, 0), (0, d - q.shape[1])))
        weight = np.abs(q)
        reach = weight @ np.maximum(np.abs(self.low), np.abs(self.high)) if len(self.rows) else np.zeros(len(q))
        plain = (len(self.rows) > FEW) & (4 * reach < 2 ** 53)
        every = np.arange(len(self.rows))
        possible: list[np.ndarray] = [every] * len(q)
        at = np.flatnonzero(plain)
        for some, rows in zip(at, self._possible(q[at], own[at], beat[at], k) if len(at) else []):
            possible[some] = rows
        out = []
        for x, me, bar, rows in zip(q, own, beat, possible):
            rows = rows[self.uid[rows] != me]
            found = sorted(zip(self.exact(x, rows), [self.ids[i] for i in rows]), key=rank)
            out.append([f for f in found[:k] if f[0] >= bar])
        return out

    def _possible(self, q: np.ndarray, own: np.ndarray, beat: np.ndarray, k: int) -> list[np.ndarray]:
        """Of every query the rows that may be among its ``k`` best: all others are proven not to be."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        beat = beat.copy()
        gain = np.abs(q) * self.step                       # of one level
        slack = (np.abs(q) * np.minimum(self.step - 1, self.span)).sum(1)
        base = np.where(q > 0, q * self.low, q * self.high).sum(1)
        live = np.flatnonzero(base + (np.abs(q) * self.span).sum(1) >= beat)
        weights = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], 1) * np.tile(self.step, 2)
        acc = np.repeat(base[None, :], len(self.rows), 0)
        for at in range(len(BANDS)):
            if not len(live):
                break
            acc[:, live] += self.band(at) @ weights[live].T
            rest = slack[live] + gain[live].sum(1) * (BANDS[at] - 1)
            if at + 1 == len(BANDS) and len(self.rows) > k:     # the k-th best that is sure; a query's own row may be one of k + 1
                sure = acc[:, live]
                beat[live] = np.maximum(beat[live], np.partition(sure, len(sure) - k - 1, axis=0)[len(sure) - k - 1])
            enough = acc[:, live] + rest >= beat[live]
            count = enough.sum(0)
            done = (count <= FEW) | (at + 1 == len(BANDS))
            for j in np.flatnonzero(done):
                out[live[j]] = np.flatnonzero(enough[:, j])
            live = live[~done]
        return out


def rank(x: tuple[int, int | None]) -> tuple:
    return -x[0], x[1] is None, x[1] or 0


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(names), types)], names)


PACKED = "part int, uids array<long>, ids array<long>, dims array<int>, kinds array<string>, vecs array<binary>"


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["uid", "vec_id", "dims", "kind", "vec"]
    held: list[list] = [[] for _ in names]

    def block(n: int) -> pa.RecordBatch:
        out = [[0], *[[h[:n]] for h in held]]
        for h in held:
            del h[:n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
            pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())]))],
            ["part", "uids", "ids", "dims", "kinds", "vecs"])
    for batch in batches:
        for h, name in zip(held, names):
            h += batch.column(name).to_pylist()
        while len(held[0]) >= BLOCK:
            yield block(BLOCK)
    if held[0]:
        yield block(BLOCK)


FOUND = "own long, query_id long, vec_id long, score decimal(38,0)"
_FOUND = (["own", "query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)])
WIDE = 10 ** 38 - 1


def _hit(own: int, query: int, score: int, key: int | None) -> tuple:
    return own, query, key, max(-WIDE, min(WIDE, score))


def _open(row: dict) -> Block:
    return Block(np.array(row["uids"], np.int64), row["ids"], matrix(row["dims"], row["kinds"], row["vecs"]))


def _at_home(k: int, every: int) -> callable:
    """Every query against its own block."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("uids", "ids", "dims", "kinds", "vecs")}
                block, found = _open(row), []
                asked = np.array([j for j, key in enumerate(row["ids"]) if key is not None and key % every == 0], np.int64)
                for a in range(0, len(asked), GROUP):
                    some = asked[a:a + GROUP]
                    for j, hits in zip(some, block.search(block.rows[some], block.uid[some], np.full(len(some), -np.inf), k)):
                        found += [_hit(int(block.uid[j]), row["ids"][j], *x) for x in hits]
                yield _rows(found, *_FOUND)
    return run


def _away(k: int) -> callable:
    """A block against some groups of queries, those of its own rows excepted."""
    def run(blocks: pa.Table, groups: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if blocks.num_rows and groups.num_rows:
            row = blocks.select(["uids", "ids", "dims", "kinds", "vecs"]).to_pylist()[0]
            block, home = _open(row), set(row["uids"])
            for group in groups.column("queries"):
                asked = [q for q in group.as_py() if q["uid"] not in home]
                if asked:
                    v = matrix(*[[q[c] for q in asked] for c in ("dims", "kind", "vec")])
                    beat = np.array([-np.inf if q["beat"] is None else float(q["beat"]) for q in asked])
                    for q, hits in zip(asked, block.search(v, np.array([q["uid"] for q in asked]), beat, k)):
                        found += [_hit(q["uid"], q["vec_id"], *x) for x in hits]
        return pa.Table.from_batches([_rows(found, *_FOUND)])
    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, the
    ``k`` other rows with the highest inner products of floor(scale * component), ties to the smaller vec_id.

    Vectors that are null or hold a null, non-finite or (when scaled) overflowing component take no part.  A shorter vector counts
    as filled up with zeros.  Rows without a vec_id are candidates, last among ties, and no queries.  Repeated rows are rows of
    their own: a query's copies are candidates, and each copy of a query is a query.  Scores outside 64 bits are ranked exactly
    (up to 38 digits) and given as the nearest long.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    vecs = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vec")).where("vec is not null")
    vecs = saved(vecs.mapInArrow(_parsed(scale), VECTORS).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # neighbours in their strongest component share blocks; the hash spreads equal ones
    near = vecs.repartitionByRange(F.col("term"), F.xxhash64("uid"))
    blocks = saved(near.select("uid", "vec_id", "dims", "kind", "vec").mapInArrow(_packed, PACKED)
                   .withColumn("at", F.monotonically_increasing_id()), "blocks")
    number = blocks.select("at").withColumn("c", F.row_number().over(W.orderBy("at")) - 1)  # one row a block
    blocks = blocks.join(number, "at")
    n_blocks = blocks.count()
    home = saved(blocks.select("uids", "ids", "dims", "kinds", "vecs").repartition(max(1, min(n_blocks, 4 * spark.sparkContext.defaultParallelism)))
                 .mapInArrow(_at_home(k, every), FOUND), "home")
    beat = home.groupBy("own").agg(F.min("score").alias("beat"), F.count("*").alias("n")).select(
        F.col("own").alias("uid"), F.when(F.col("n") >= k, F.col("beat")).alias("beat"))
    queries = vecs.where((F.col("vec_id") % every) == 0).join(beat, "uid", "left")
    n_groups = max(1, -(-queries.count() // GROUP))
    groups = (queries.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_groups)).alias("g"))
              .agg(F.collect_list(F.struct("uid", "vec_id", "dims", "kind", "vec", "beat")).alias("queries")))
    halves = -(-n_groups // HALF)
    many = blocks.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(halves - 1)))).drop("at", "part")
    asked = (groups.withColumn("h", F.floor(F.col("g") / HALF).cast("int")).drop("g")
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))))))
    away = many.groupBy("c", "h").cogroup(asked.groupBy("c", "h")).applyInArrow(_away(k), FOUND)
    order = W.partitionBy("own").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id",
                    F.greatest(F.least("score", F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long").alias("score")))


def op13_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q, row_number() OVER () AS uid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY uid ORDER BY score DESC, vec_id ASC NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""

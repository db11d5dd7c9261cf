"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct k-word shingles.  Sets of
sizes a and b with Jaccard similarity s or more differ in at most
D(a) = floor(a (1 - s) / s) elements, and the larger is at most a / s.  k and s
are a ``Contract``, from which every bound below is derived; op6 has 4 words
and 0.85, hence D(a) = floor(3a / 17).

*Sketches.*  Sizes fall into bands; a band splits hashes into G groups, and a
group's sketch is the XOR of its hashes, so a difference in one element
changes one group.  With more than D(a) groups of ``weight`` elements or more, one of these
groups must agree between linked sets (pigeonhole), and only such groups are
sent as keys; ``weight`` is the largest for which random groups are that many.  A set with too few of them sends further keys under the next
seeds until it has enough; of a pair, the one that needs fewer seeds decides.
A set whose partners may lie in the next band sends keys there as well.
A second sketch, 512 parity bits per set, bounds the difference from below by
its Hamming distance and drops candidates before their sets are fetched.

*Links.*  Equal sets are one class from the start, so copies meet once per
batch and never pair up.  Classes that share a key form a bucket.  Every
class is verified against the least one of its buckets, components are formed,
then in buckets that still hold several components against one member, and
last every pair of one bucket that still lies in different components.
A pair that is not verified lies inside one component, so no component can be
missed, and a group of near copies costs about its size.

Edge cases: null and empty texts have no shingles and their own doc_id as
component; texts under k words are one shingle; a null doc_id never names a
component but its row gets the one of its links (null if it has none);
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import bounded_batches, read, saved, scalar, sheltered
from corpuslab.llm.graph import components
from corpuslab.llm.textnp import flat, mixed, shingles, slices, tidy, word_hashes, words

BITS = 512
WIDTH = 1.4           # of a band
PART_KEYS = 100_000   # keys per reduce group, about
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Contract:
    """Shingles of ``k`` words, links at a Jaccard similarity of ``like / of`` or more."""

    def __init__(self, k: int, like: int, of: int):
        if not 1 / WIDTH < like / of < 1:
            raise ValueError("partners must lie in a set's own band or the next one")
        self.k, self.like, self.of = k, like, of
        self.least = -(-like // (of - like))               # smaller sets link only with equal ones
        self.weight = max(w for w in (1, 2, 3) if w == 1 or self._heavy(w) * like > 1.05 * (of - like))
        bands = [self.least]
        while bands[-1] < 1 << 40:
            bands.append(max(bands[-1] + 2, int(bands[-1] * WIDTH)))
        self.bands = np.array(bands, np.int64)
        per = WIDTH * self.weight                          # elements a group, at the top of a band
        self.groups = np.maximum(2, np.round(np.r_[self.bands[1:], self.bands[-1] * 2] / per).astype(np.int64))
        self.keys = self._heavy(self.weight) * (1 + math.log(of / like, WIDTH))   # sent per shingle, about

    @staticmethod
    def _heavy(weight: int) -> float:
        """Groups of ``weight`` elements or more per element of a set, at the worse end of a band (Poisson)."""
        return min((1 - sum(math.exp(-x) * x ** j / math.factorial(j) for j in range(weight))) / x
                   for x in (weight, WIDTH * weight))

    def differ(self, size: np.ndarray) -> np.ndarray:
        """D, the most elements in which a linked set differs."""
        return size * (self.of - self.like) // self.like


OP6 = Contract(4, 85, 100)


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, sorted."""
    buf, off = flat(texts)
    buf = _LOWER[buf]
    start, end, doc = words(buf, off)
    h = word_hashes(buf, start, end)
    s = shingles(h, k)
    inside = doc[:len(s)] == doc[k - 1:] if len(s) else np.zeros(0, bool)
    n = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((n > 0) & (n < k))
    at = np.searchsorted(doc, few)
    short = np.zeros(len(few), np.uint64)
    for j in range(k - 1):                                 # the whole sequence as one
        more = n[few] > j
        short[more] = mixed(short[more] * np.uint64(31) + h[at[more] + j] + np.uint64(j + 1))
    row, key = np.r_[doc[:len(s)][inside], few], np.r_[s[inside], short]
    o = np.lexsort((key, row))
    row, key = row[o], key[o]
    new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])][:len(row)]
    return row[new], key[new]


def digests(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit digest of every set, 0 for the empty one."""
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
    out = np.zeros(n, np.uint64)
    if len(at):
        out[row[at]] = mixed(np.add.reduceat(mixed(key + np.uint64(1)), at)) | np.uint64(1)
    return out


def parity(row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS / 64) words of parity bits."""
    bits = np.bincount(row * BITS + (key >> np.uint64(55)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).reshape(n, BITS // 64)


def _describe(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    row, key = sets(some.column("text"), k)
                    n = some.num_rows
                    yield pa.record_batch(
                        [some.column("doc_id"), pa.array(np.bincount(row, minlength=n), pa.int64()),
                         pa.array(digests(row, key, n).view(np.int64)), pa.array(list(parity(row, key, n)), pa.list_(pa.int64()))],
                        names=["doc_id", "n_shingles", "node", "sketch"])
    return run


def sketch_keys(row: np.ndarray, key: np.ndarray, node: np.ndarray, size: np.ndarray,
                by: Contract) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of every group that is sent."""
    keys, nodes = [], []
    band = np.searchsorted(by.bands, size, side="right") - 1
    own = size >= by.least
    up = own & (size * by.of >= by.like * by.bands[np.minimum(band + 1, len(by.bands) - 1)])
    for of, scheme in ((own, band), (up, band + 1)):
        todo, seed = of.copy(), 0
        while todo.any():
            take = todo[row]
            r, h = row[take], mixed(key[take] + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            g = (h >> np.uint64(20)).astype(np.int64) % by.groups[scheme[r]]
            o = np.argsort(r * (1 << 32) + g, kind="stable")
            r, g, h = r[o], g[o], h[o]
            at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
            count = np.diff(np.r_[at, len(r)])
            x = np.bitwise_xor.reduceat(h, at)
            heavy = count >= by.weight
            r, g, x = r[at][heavy], g[at][heavy], x[heavy]
            name = mixed((scheme[r] * 1009 + seed).astype(np.uint64) * np.uint64(1 << 32) + g.astype(np.uint64))
            keys.append(mixed(x ^ name))
            nodes.append(node[r])
            todo &= np.bincount(r, minlength=len(size)) <= by.differ(size)
            seed += 1
    return (np.concatenate(keys), np.concatenate(nodes)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _send(parts: int, by: Contract):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count = 0
        for batch in batches:
            for part in slices(batch, "text"):
                row, key = sets(part.column("text"), by.k)
                n = part.num_rows
                node = digests(row, key, n)
                _, first = np.unique(node, return_index=True)  # copies in one slice send once
                only = np.zeros(n, bool)
                only[first] = True
                size = np.where(only, np.bincount(row, minlength=n), 0)
                held.append(sketch_keys(row, key, node, size, by))
                count += len(held[-1][0])
                if count > 400_000:
                    yield _blobs(held, parts)
                    held, count = [], 0
        if held:
            yield _blobs(held, parts)
    return run


def _blobs(held: list, parts: int) -> pa.RecordBatch:
    key, node = (np.concatenate(x) for x in zip(*held))
    part = (key >> np.uint64(32)).astype(np.int64) % parts
    o = np.lexsort((node, key, part))
    part, key, node = part[o], key[o], node[o]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][:len(key)]
    part, key, node = part[new], key[new], node[new]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:len(part)])
    ends = np.r_[at[1:], len(part)]
    return pa.record_batch(
        [pa.array(part[at], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
         pa.array([node[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], names=["part", "keys", "nodes"])


def _buckets(table: pa.Table) -> pa.Table:
    """(bucket, node) of keys that two or more classes sent; a bucket is named by its members."""
    key, node = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "nodes"))
    o = np.lexsort((node, key))
    key, node = key[o], node[o]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][:len(key)]
    key, node = key[new], node[new]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    n = np.diff(np.r_[at, len(key)])
    many = np.repeat(n > 1, n)
    name = np.repeat(mixed(np.add.reduceat(mixed(node), at)), n)[many] if len(at) else key
    pair = np.unique(np.stack([name, node[many]], 1), axis=0) if many.any() else np.zeros((0, 2), np.uint64)
    return pa.table({"bucket": pa.array(pair[:, 0].view(np.int64).copy()), "node": pa.array(pair[:, 1].view(np.int64).copy())})


def _hamming(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _near(a: str, b: str, by: Contract):
    """Whether the sketches allow a link: differing elements <= (a + b) (1 - s) / (1 + s)."""
    return (_hamming(f"{a}.sketch", f"{b}.sketch") * (by.of + by.like)
            <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (by.of - by.like))


def _verified(pairs: DataFrame, held: DataFrame, by: Contract) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as the contract asks."""
    both = (pairs.join(held.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * by.of >= (F.size("x") + F.size("y") - common) * by.like).select("a", "b")


def _noded(docs: DataFrame, k: int, name: str) -> DataFrame:
    """``docs`` with the class of every row in a further column; only the texts go to Python."""
    def run(texts: pa.Array) -> pa.Array:
        sets_of = (sets(part.column("text"), k) + (part.num_rows,) for part in slices(pa.record_batch([texts], ["text"]), "text"))
        nodes = [digests(row, key, n).view(np.int64) for row, key, n in sets_of]
        return pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))
    return docs.withColumn(name, scalar(run, "long")(F.col("text")))


def groups(docs: DataFrame, by: Contract = OP6) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles and node of every row of ``docs``; node, least doc_id and component of every class)."""
    docs = docs.select("doc_id", "text")
    rows = saved(docs.mapInArrow(_describe(by.k), "doc_id long, n_shingles long, node long, sketch array<long>"), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(16, int(total * by.keys) // PART_KEYS)
    classes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sent = docs.mapInArrow(_send(parts, by), "part long, keys binary, nodes binary")
    buckets = saved(sent.groupBy("part").applyInArrow(_buckets, "bucket long, node long").distinct(), "buckets")
    # the sets of the classes that share a key, each from the document that names it, or from any row if none has a doc_id
    nodes = buckets.select("node").distinct()
    shared = classes.join(nodes, "node", "left_semi").select(F.col("least").alias("doc_id"), "node")
    carried = docs.join(shared.where("doc_id is not null"), "doc_id").select("text", "node")
    nameless = _noded(docs.where("doc_id is null").select("text"), by.k, "node").dropDuplicates(["node"])
    carried = carried.unionByName(nameless.join(shared.where("doc_id is null").select("node"), "node", "left_semi").select("text", "node"))

    @tidy
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, key = sets(part.column("text"), by.k)
                node = digests(row, key, part.num_rows).view(np.int64)
                same = node == part.column("node").to_numpy()
                found = np.split(key.view(np.int64), np.searchsorted(row, np.arange(1, part.num_rows)))
                yield pa.record_batch([pa.array(node[same]), pa.array([f for f, s in zip(found, same) if s], pa.list_(pa.int64()))],
                                      names=["node", "elements"])
    held = saved(carried.mapInArrow(elements, "node long, elements array<long>")
                 .dropDuplicates(["node"]), "elements")
    info = classes.select("node", "n", "sketch")
    member = saved(buckets.join(info, "node"), "members")

    one = F.struct("node", "n", "sketch")
    first = member.groupBy("bucket").agg(F.min_by(one, "node").alias("a"))
    near = (member.select("bucket", one.alias("b")).join(first, "bucket").where(F.col("a.node") != F.col("b.node")).where(_near("a", "b", by)))
    # every class against the least one that it shares a key with
    star = near.groupBy(F.col("b.node").alias("b")).agg(F.min("a.node").alias("a"))
    links = saved(_verified(star, held, by), "verified")

    def labelled(links: DataFrame) -> DataFrame:
        of = member.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        return saved(of.join(apart, "bucket").select("bucket", "component", one.alias("a")), "apart")
    # in buckets that still hold several components: all against one member, then every pair of two components
    left = labelled(links)
    low = left.groupBy("bucket").agg(F.min_by(F.struct("component", "a"), "component").alias("m"))
    cross = (left.join(low.select("bucket", F.col("m.component").alias("other"), F.col("m.a").alias("b")), "bucket")
             .where((F.col("component") != F.col("other")) & _near("a", "b", by))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    links = saved(links.select("a", "b").unionByName(_verified(cross, held, by)), "verified")
    left = labelled(links)
    right = left.select("bucket", F.col("component").alias("other"), F.col("a").alias("b"))
    cross = (left.join(right, "bucket").where((F.col("component") < F.col("other")) & _near("a", "b", by))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    group = components(links.unionByName(_verified(cross, held, by)))
    named = (classes.select("node", "least").join(group, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return rows.select("doc_id", "n_shingles", "node"), named


def linked(docs: DataFrame, by: Contract = OP6) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows, named = groups(docs, by)
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, by: Contract = OP6) -> DataFrame:
    """One row of ``docs`` for every group of linked documents, that of its smallest doc_id; texts without
    words are no group and stay."""
    bounded_batches(docs.sparkSession)
    docs, whole = sheltered(docs, "doc_id", "text")
    _, named = groups(docs, by)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("x"), "least", "node")).alias("m"))
    keep = best.select(F.col("m.least").alias("keep_id"), F.col("m.node").alias("keep_node"))
    noded = _noded(docs, by.k, "keep_of")
    mine = noded.join(keep, (F.col("keep_of") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return whole(mine.dropDuplicates(["keep_of", "doc_id"]).unionByName(noded.where("keep_of = 0")))


def op6_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of ``documents`` at a Jaccard similarity of 0.85 on 4-word shingles."""
    return linked(read(spark, sf_dir, "documents"))

"""Prefix trie of conversations, built by van Emde Boas recursion.

A range of depths is cut in half: the upper half is a trie of the cut prefixes, the lower half a forest with a tree below
each of them, and both are cut again in the same way.  All parts of one size are worked on by one job, as rows of a table:

* going up, the digests of neighbouring halves join into the digest of the doubled piece of a conversation (one shuffle a
  size, half as many rows each time);
* going down, a cut prefix is named by the digest of the prefix above it and the piece in between, so that equal prefixes of
  any conversations have one name and each depth is named once;
* totals go the same way: sums inside the lower parts first, then the totals of the trees below are grafted on the cut
  prefixes of the part above, from the largest parts to the smallest.

A depth d is cut in a part of size 2^j, where 2^j is the largest power of two that divides d; the prefix above it in the
recursion has depth d - 2^j.  No conversation is ever held as a whole: every join is on (conversation, depth), which is
unique, and every group by names is summed before it is shuffled.  Names are SHA-256 digests, each over exactly two parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.common import n_bytes, read, saved
from corpuslab.llm.textnp import tidy

#: Conversations share their base's first turns; a fixed number of residues and of turns.
FAMILY, TURNS = 5, 9
#: Member ids that are joined into one string before they are hashed.
CHUNK = 1024


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, token, bytes) with the turns of each conversation numbered from 1 in the order of turn (null first),
    the first 256 characters of role and text, and token, the digest of both as a whole.  Sorted by ranges, numbered within a range and moved on by what
    earlier ranges hold of the conversation, so that a conversation may be of any length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", digest(n_bytes(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")).alias("token"),
        F.substring(role, 1, 256).alias("role"), F.substring(text, 1, 256).alias("head"), n_bytes(text).alias("bytes"),
        F.monotonically_increasing_id().alias("row"))
    # equal keys differ in the last column only, whose order cannot be seen
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("token"), F.col("row")]
    t = saved(t.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
              .select("conv_id", "turn", "role", "head", "token", "bytes", "row", "part"), "turns")
    held = t.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.coalesce(F.sum("held").over(
        W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "part", "before")
    inner = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*keys[1:]))
    return t.withColumn("inner", inner).join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("inner") + F.col("before")).cast("long").alias("pos"), "token", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id), (conv_id, pos, token, bytes)) of the rebuilt conversations: the first h turns of conversation c - c % 5, then
    the own turns after the first h; h is the CRC-32 of the decimal conv_id modulo 9."""
    t = saved(numbered(turns), "numbered")
    c = F.col("conv_id")
    sizes = saved(t.groupBy("conv_id").agg(F.count("*").alias("size"))
                  .withColumn("h", F.crc32(c.cast("string").cast("binary")) % TURNS).withColumn("base", c - c % FAMILY), "sizes")
    base = sizes.select(c.alias("base"), F.col("size").alias("base_size"))
    convs = sizes.join(base, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_size", F.lit(0))))
    own = t.join(convs.select("conv_id", "h", "shared"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).cast("long").alias("pos"), "token", "bytes")
    heads = t.where((F.col("pos") < TURNS) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.where("shared > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shared").cast("long"))).alias("pos"))
    shared = taken.join(heads, ["base", "pos"]).select("conv_id", "pos", "token", "bytes")
    rows = saved(own.unionByName(shared), "rebuilt")
    return sizes.select("conv_id"), rows


ROOT = hashlib.sha256(b"").digest()


def prefixes(rows: DataFrame, levels: int) -> list[DataFrame]:
    """By j: (conv_id, depth, name, above) of the depths that 2^j divides and 2^(j+1) does not; ``above`` is the name of the
    prefix above the cut, 2^j turns shorter."""
    piece = rows.select("conv_id", (F.col("pos") - 1).alias("i"), F.col("token").alias("name"))
    pieces = [piece]
    for j in range(1, levels):
        half = F.col("i") % 2
        joined = piece.groupBy("conv_id", F.floor(F.col("i") / 2).cast("long").alias("i")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        piece = saved(joined.where("a is not null and b is not null").select("conv_id", "i", digest(F.col("a"), F.col("b")).alias("name")), f"pieces-{j}")
        pieces.append(piece)
    out: list[DataFrame] = [None] * levels
    for j in reversed(range(levels)):
        size = 1 << j
        cut = pieces[j].where("i % 2 = 0").select("conv_id", (F.col("i") * size).alias("from"), F.col("name").alias("piece"))
        start = cut.where("`from` = 0").withColumn("above", F.lit(ROOT))
        if j + 1 < levels:
            known = reduce(DataFrame.unionByName, out[j + 1:]).select("conv_id", F.col("depth").alias("from"), F.col("name").alias("above"))
            start = start.unionByName(cut.where("`from` > 0").join(known, ["conv_id", "from"]))
        out[j] = saved(start.select("conv_id", (F.col("from") + size).alias("depth"), digest(F.col("above"), F.col("piece")).alias("name"), "above"), f"prefixes-{j}")
    return out


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's chunks of ids, which follow one another: only the hash's state is kept."""
    at, state = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if name != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["name", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends"])


def ends(last: DataFrame) -> DataFrame:
    """(name, ends): the SHA-256 of the ids (conv_id) that end at each name, in ascending order and joined by commas.  Ids are
    joined in chunks of neighbouring ones first; a task reads chunks and keeps the state of the hash."""
    chunk = F.floor(F.col("conv_id") / CHUNK).cast("long")
    chunks = last.groupBy("name", chunk.alias("chunk")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(_hashed, "name binary, ends string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first); equal ones by the first 256 characters of role, then of text, then by a digest; null roles and texts are empty; repeated rows are turns
    of their own.  Rows without a conv_id belong to no conversation.  A conversation without turns ends at the root.  An
    empty table has no conversation and no node, not even a root.  Other columns are not read.
    """
    convs, rows = rebuilt(turns)
    longest = rows.agg(F.max("pos")).first()[0] or 0
    levels = max(1, int(longest).bit_length())
    by_level = prefixes(rows, levels)
    level = F.round(F.log2(F.col("depth").bitwiseAND(-F.col("depth")))).cast("int")
    named = saved(reduce(DataFrame.unionByName, by_level).withColumn("level", level), "named")
    # the prefix a turn shorter, and the bytes of the last turn
    parents = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    full = (named.join(rows.select("conv_id", F.col("pos").alias("depth"), "bytes"), ["conv_id", "depth"])
            .join(parents, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT))))
    nodes = full.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("level").alias("level"), F.first("parent").alias("parent"),
        F.first("above").alias("above"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    nodes = saved(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                  .withColumn("own", ((F.col("n_convs") - 1) * F.col("bytes")).cast("long")), "weights")

    def summed(parts: list[DataFrame], key: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(F.col(key).alias("name")).agg(F.sum("leaf").alias("more_leaf"), F.sum("own").alias("more_own"))

    def plus(own: DataFrame, more: DataFrame) -> DataFrame:
        return (own.join(more, "name", "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0)))
                .withColumn("own", F.col("own") + F.coalesce("more_own", F.lit(0))).drop("more_leaf", "more_own"))
    # inside the parts: a node below which 2^j depths lie in its part, with what the smaller parts in there hold
    inside: list[DataFrame] = []
    for j in range(levels):
        own = nodes.where(F.col("level") == j).select("name", "conv_id", "depth", "above", "leaf", "own")
        inside.append(saved(plus(own, summed(inside, "above")) if inside else own, f"inside-{j}"))
    whole = summed(inside, "above").where(F.col("name") == F.lit(ROOT))
    # grafting: the totals at the end of a part count for the cut prefix at its start
    totals: list[DataFrame] = []
    for j in reversed(range(levels)):
        own = inside[j]
        if totals:
            ends_at = reduce(DataFrame.unionByName, totals).select("conv_id", (F.col("depth") - (1 << j)).alias("depth"), "leaf", "own").where("depth > 0")
            cut = by_level[j].select("conv_id", "depth", F.col("name").alias("cut"))
            own = plus(own, summed([ends_at.join(cut, ["conv_id", "depth"])], "cut"))
        totals.append(saved(own, f"totals-{j}"))
    total = reduce(DataFrame.unionByName, totals).select("name", F.col("leaf").alias("n_leaves"), F.col("own").alias("saved_tokens"))

    last = rows.groupBy("conv_id").agg(F.max("pos").alias("depth"))
    at_end = saved(convs.join(last, "conv_id", "left").join(named.select("conv_id", "depth", "name"), ["conv_id", "depth"], "left")
                   .select("conv_id", F.coalesce("name", F.lit(ROOT)).alias("name")), "ends")
    smallest = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .withColumn("name", F.lit(ROOT)).withColumn("depth", F.lit(0).cast("long"))
            .join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
            .join(whole, "name", "left").withColumn("parent_conv_id", F.lit(None).cast("long"))
            .withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("more_leaf")))
            .withColumn("saved_tokens", F.coalesce("more_own", F.lit(0))))
    top = convs.agg(F.min("conv_id").alias("top"))
    columns = ["name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    below = nodes.join(total, "name").join(smallest, "parent", "left").select(*columns)
    least = top.first()["top"]
    below = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id")))
    out = below.unionByName(root.select(*columns)).join(ends(at_end), "name", "left")
    return out.select(*[F.col(c).cast("long").alias(c) for c in columns[1:]],
                      F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


_CRC = ("list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        "lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, y: xor(s >> 1, (s & 1) * 3988292384)))")
ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY pos) AS xs, xor({_CRC.format(c='c')}, 4294967295) % 9 AS h FROM t GROUP BY c),
s AS (SELECT o.c, list_concat(coalesce(b.xs[1:o.h], []), o.xs[o.h + 1:]) AS xs FROM o LEFT JOIN o b ON b.c = o.c - o.c % 5),
p AS (SELECT c, xs[1:d] AS k, d, len(xs) AS n FROM s, unnest(range(0, len(xs) + 1)) AS u(d)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(k[d].t)) END AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
  FROM p GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
weighed AS (SELECT a.*, coalesce(b.n, 0) AS n_children FROM nodes a LEFT JOIN children b ON a.k = b.k),
totals AS (
  SELECT k[1:e] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w) AS saved_tokens
  FROM weighed, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM weighed a JOIN totals t ON a.k = t.k LEFT JOIN nodes q ON a.d > 0 AND q.k = a.k[1:a.d - 1]
"""

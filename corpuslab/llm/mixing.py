"""Mixing sources to target weights.

1. ``targets``: every source asks for its share of all words by weight, no
   source for more than ``repeats`` times its own words; the excess goes to the
   others by weight until none is above.
2. ``pack``: the words of a source, documents in a pseudorandom order, form one
   long run that is cut into blocks of ``block`` words (the last may be short).
   A document's place in the run comes from exact running sums in two passes
   (bucket totals, then inside buckets), so a source with a third of all rows
   is packed by ``buckets`` tasks.
3. ``slots``: how many block slots a source needs to come nearest its target is
   counted, then every output shard draws its source counts from a multinomial
   over the slots still to be dealt; the totals per source are exact.
4. A source's j-th slot is block ``perm(j mod blocks)`` under a keyed
   pseudorandom permutation (a Feistel network, walked until it is inside the
   range), another one for each pass, so no block is taken again before all
   others were, and none more than ``repeats`` times.
5. ``mix`` joins slots with blocks on (source, block index).

The driver handles one row per source, and shards x sources counts; everything
per document, block or slot stays in Spark.  All draws come from ``seed``, so
reruns agree.

Edge cases: null or empty texts have no words and are never taken; a null
source is a source of its own, last in order; null doc_ids and repeated rows
are packed as rows of their own; an empty table gives empty results; extra
columns of any name are kept by ``mixed_documents``; ``pack`` has ``sid``, ``start``
and ``size`` of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.text import let
from corpuslab.llm.common import WORD, n_words, read, saved, sheltered

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLOCK = 32
SHARDS = 64
PIECE = 4096


def targets(sizes: list[int], weights=WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words that each source should give, in the order of ``sizes``."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / total for i in open_}
        above = [i for i in sorted(open_) if share[i] > repeats * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Element-wise: the image of j under the pseudorandom permutation of 0..n-1 that ``key`` names (or with ``back`` the place
    whose image j is)."""
    half = np.ones(len(n), np.uint64)
    for _ in range(32):
        half = np.where((np.uint64(1) << (half + half)) < n.astype(np.uint64), half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = j.astype(np.uint64), np.zeros(len(j), np.int64)
    at = np.arange(len(j))
    while len(at):
        left, right = x[at] >> half[at], x[at] & mask[at]
        for r in reversed(range(4)) if back else range(4):
            f = ((left if back else right) + key[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.uint64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            f = (f ^ (f >> np.uint64(31))) & mask[at]
            left, right = (right ^ f, left) if back else (right, left ^ f)
        x[at] = (left << half[at]) | right
        done = x[at] < n[at].astype(np.uint64)             # outside the range: walk on along the cycle
        out[at[done]] = x[at[done]].astype(np.int64)
        at = at[~done]
    return out


def _key(sid, turn, seed):
    return sid * 1_000_003 + turn * 7919 + seed


def pack(docs: DataFrame, source_of: list, buckets: int = 1024, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, source, text ...) with sid, size and start, the place of its first word in the source's run."""
    spark = docs.sparkSession
    ids = spark.createDataFrame([(s, i) for i, s in enumerate(source_of)], "pack_source string, sid int")
    # one row per source: as many as distinct sources, counted before
    d = docs.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("pack_source"))).drop("pack_source")
    d = d.withColumn("size", n_words(F.col("text"))).withColumns({
        "pack_h": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))})
    d = d.withColumn("pack_b", F.pmod(F.col("pack_h"), F.lit(buckets)).cast("int"))
    total = d.groupBy("sid", "pack_b").agg(F.sum("size").alias("pack_n"))
    first = total.select("sid", "pack_b", (F.sum("pack_n").over(W.partitionBy("sid").orderBy("pack_b")) - F.col("pack_n")).alias("pack_0"))
    inside = W.partitionBy("sid", "pack_b").orderBy("pack_h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(first, ["sid", "pack_b"])
    return d.withColumn("start", F.col("start") + F.col("pack_0")).drop("pack_h", "pack_b", "pack_0")


def plan(sizes: list[int], goal: list[float], block: int = BLOCK, shards: int = SHARDS, seed: int = 0):
    """Slots per source, and (sid, shard, first slot, slots) of every output shard."""
    need = []
    for sid, (n, t) in enumerate(zip(sizes, goal)):
        blocks, last = -(-n // block), n % block or block
        if not n:
            need.append(0)
            continue
        turns, rest = divmod(t, n)
        turns = int(turns)
        # where in its last pass a source meets its short block
        at = int(permuted(*(np.array([x]) for x in (blocks - 1, blocks, _key(sid, turns, seed))), back=True)[0]) if last < block else blocks
        near = [q for q in range(max(0, int(rest // block) - 1), min(blocks, int(rest // block) + 3) + 1)]
        q = min(near, key=lambda q: abs(q * block - (block - last) * (q > at) - rest))
        need.append(turns * blocks + q)
    rng, left, runs = np.random.default_rng(seed), np.array(need, dtype=np.int64), []
    taken = np.zeros(len(need), np.int64)
    for k in range(shards):
        want = int(left.sum() // (shards - k))
        drawn = np.zeros(len(need), np.int64)
        while want > 0:
            c = np.minimum(rng.multinomial(want, (left - drawn) / (left - drawn).sum()), left - drawn)
            drawn, want = drawn + c, want - int(c.sum())
        runs += [(sid, k, int(taken[sid]), int(c)) for sid, c in enumerate(drawn) if c]
        taken, left = taken + drawn, left - drawn
    return need, runs


def slots(spark: SparkSession, runs: list, blocks: list[int], seed: int = 0) -> DataFrame:
    """(sid, shard, slot, block_index) of every slot."""
    few = spark.createDataFrame([r + (blocks[r[0]],) for r in runs], "sid int, shard int, slot0 long, n long, blocks long")
    pieces = few.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {PIECE} as int)"))).alias("piece"))
    pieces = pieces.repartition(spark.sparkContext.defaultParallelism * 4)
    each = pieces.select("sid", "shard", "blocks", F.explode(F.sequence(
        F.col("slot0") + F.col("piece") * PIECE,
        F.least(F.col("slot0") + F.col("n"), F.col("slot0") + (F.col("piece") + 1) * PIECE) - 1)).alias("slot"))

    @F.pandas_udf("long")
    def index(sid: pd.Series, slot: pd.Series, n: pd.Series) -> pd.Series:
        s, j, m = (x.to_numpy().astype(np.int64) for x in (sid, slot, n))
        return pd.Series(permuted(j % m, m, _key(s, j // m, seed)))
    return each.withColumn("block_index", index("sid", "slot", "blocks")).drop("blocks")


def pieces(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every part of a document inside a block: its block_index, first word and number of words."""
    d = packed.where("size > 0").withColumn("block_index", F.explode(F.sequence(
        F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    first = F.greatest(F.col("block_index") * block - F.col("start"), F.lit(0))
    past = F.least((F.col("block_index") + 1) * block - F.col("start"), F.col("size"))
    return d.withColumn("first_word", first).withColumn("n_taken", past - first)


def _sources(docs: DataFrame) -> tuple[list, list[int]]:
    """Sources in code point order, null last, and their words: one row per source on the driver."""
    per = docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()
    per = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    return [r["source"] for r in per], [r["n"] for r in per]


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 0, weights=WEIGHTS, repeats: int = REPEATS):
    """(packed documents, the mix, sizes and targets by source).

    The mix has a row for every part of a block in every slot: sid, shard, slot,
    block_index, start (which names the document inside its source), first_word
    and n_taken; ``words`` gives the words.
    """
    spark = docs.sparkSession
    names, sizes = _sources(docs)
    goal = targets(sizes, weights, repeats)
    packed = saved(pack(docs.select("doc_id", "source", "text"), names, seed=seed).drop("text", "source"), "mix-packed")
    need, runs = plan(sizes, goal, block, shards, seed)
    at = slots(spark, runs, [-(-n // block) for n in sizes], seed)
    # the plan's row count for slots is that of their runs: without the hint they would be broadcast
    mixed = at.join(pieces(packed, block).hint("merge").select("sid", "block_index", "start", "doc_id", "first_word", "n_taken"), ["sid", "block_index"])
    info = spark.createDataFrame(list(zip(range(len(names)), names, sizes, goal)), "sid int, source string, source_size long, target double")
    return packed, mixed, info


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: each text holds the words that were taken, block after block, as often as
    they were taken; documents of which nothing was taken are left out, and n_chars is counted anew."""
    kind = docs.schema["n_chars"].dataType
    docs, whole = sheltered(docs, "doc_id", "source", "text", "n_chars")
    _, mixed, _ = mix(docs, seed=seed)
    names, _ = _sources(docs)
    taken = mixed.groupBy("sid", "start").agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "first_word", "n_taken"))).alias("mix_parts"))
    full = pack(docs, names, seed=seed).where("size > 0").join(taken, ["sid", "start"])
    # the words are found once a document, not once a part
    text = let({"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), "parts": F.col("mix_parts")}, lambda v: F.array_join(
        F.transform(v["parts"], lambda p: F.array_join(
            F.slice(v["words"], p["first_word"].cast("int") + 1, p["n_taken"].cast("int")), " ")), " "))
    full = full.withColumn("text", text)
    return whole(full.withColumn("n_chars", F.length("text").cast(kind)))


def words(text: Column, first, n) -> Column:
    """``n`` words of a text from word ``first`` on, joined by spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), first.cast("int") + 1, n.cast("int")), " ")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of ``documents`` takes."""
    packed, mixed, info = mix(read(spark, sf_dir, "documents"))
    taken = mixed.groupBy("sid", "start").agg(F.sum("n_taken").alias("taken"), F.count("*").alias("n_parts"))
    # start names a document with words; those without may share it
    return (packed.join(taken, ["sid", "start"], "left").join(F.broadcast(info), "sid")
            .select("doc_id", "size", "source_size", "target",
                    F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken")))

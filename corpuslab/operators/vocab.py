"""Vocabulary, bag-of-words counts and encoded training examples.

The token table is the only large input.  Counting is a ``groupBy`` with a
map-side combine; the vocabulary gets term ids from an exact rank by ranges
(no single-task sort); lookups join exploded tokens to the vocabulary, which is
broadcast only if its measured bytes are few, otherwise by its hot tokens only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators.joins import lookup
from corpuslab.operators.ranking import ordered_sum

# Reserved ids of the word-level encoding.
PAD_ID, UNK_ID, MASK_ID, FIRST_ID = 0, 1, 2, 3
# Fixed value: the label of positions that a masked-language-model loss leaves out.
IGNORE = -100


def vocabulary(docs: DataFrame, id_col: str, tokens_col: str, min_df: int = 1) -> DataFrame:
    """(token, tf, df, term_id): term frequency, document frequency and an id
    ordered by df descending, then token (ids start at FIRST_ID)."""
    # Occurrences (tf) and the row's distinct tokens (df) go through one
    # per-token aggregate; the partial aggregate combines map-side, so a hot
    # token costs one row per task in the shuffle, never one per occurrence.
    # One explode per document: every occurrence (o=1) plus every distinct token (d=1).
    marks = tx.let({"t": F.col(tokens_col)}, lambda v: F.concat(
        F.transform(v["t"], lambda x: F.struct(x.alias("token"), F.lit(1).alias("o"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(v["t"]),
                    lambda x: F.struct(x.alias("token"), F.lit(0).alias("o"), F.lit(1).alias("d")))))
    rows = docs.select(F.explode(marks).alias("m")).select("m.token", "m.o", "m.d")
    v = rows.groupBy("token").agg(F.sum("o").cast("bigint").alias("tf"), F.sum("d").cast("bigint").alias("df"))
    ranked = ordered_sum(v.where(F.col("df") >= min_df), [F.col("df").desc(), F.col("token")], F.lit(1), "_rk")
    return ranked.select("token", "tf", "df", (F.col("_rk") + FIRST_ID - 1).cast("bigint").alias("term_id"))


def doc_term_counts(docs: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame) -> DataFrame:
    """(doc, token, term_id, n) against a fixed vocabulary; unknown tokens dropped."""
    counts = (docs.select(id_col, F.explode(tokens_col).alias("token"))
              .groupBy(id_col, "token").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return lookup(counts, vocab.select("token", "term_id"))


def encode_ids(docs: DataFrame, id_col, tokens_col: str, vocab: DataFrame, max_len: int) -> DataFrame:
    """Word-level ids of the first ``max_len`` tokens, unknown -> UNK_ID, in order.

    ``id_col`` is a column name or a list of key columns.  Truncation happens
    before the explode, so a row contributes at most ``max_len`` rows to the
    regrouping shuffle.
    """
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    t = docs.select(*keys, F.slice(tokens_col, 1, max_len).alias("_t"))
    # posexplode_outer keeps rows without tokens (one row, NULL token).
    ex = t.select(*keys, F.posexplode_outer("_t").alias("pos", "token"))
    j = lookup(ex, vocab.select("token", "term_id"), "left")
    item = F.when(F.col("token").isNotNull(),
                  F.struct("pos", F.coalesce("term_id", F.lit(UNK_ID)).cast("bigint").alias("id")))
    ids = j.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_p"))
    return ids.select(*keys, F.transform("_p", lambda s: s["id"]).alias("ids"))


def pad(ids, max_len: int) -> Column:
    """Pad to ``max_len`` with PAD_ID; ``attention`` mask = 1 on real ids."""
    return tx.let({"i": ids}, lambda v: F.struct(
        F.concat(v["i"], F.array_repeat(F.lit(PAD_ID).cast("bigint"), max_len - F.size(v["i"]))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(v["i"])), F.array_repeat(F.lit(0), max_len - F.size(v["i"])))
        .alias("attention_mask")))


def mask_ids(ids, doc_id, n_vocab: int, prob: float = 0.15, seed: int = 42) -> Column:
    """Masked-LM examples as struct (masked, labels).

    md5('<doc>:<pos>:<seed>') decides for each non-pad position whether it is
    taken (probability ``prob``), and for a taken one what stands there: MASK_ID
    (8 of 10), another id of the vocabulary's ``n_vocab`` (1 of 10), or what
    stood there (1 of 10).  Labels hold the id of taken positions, IGNORE elsewhere.
    """
    # (digits + 0.5) / 16^13 < prob, as a bound of the digits; hex strings of equal length are in the order of their numbers
    bound = math.ceil(prob * 16 ** 13 - 0.5)

    def one(key, t, i):
        h = F.md5(F.concat(key, i.cast("string"), F.lit(f":{seed}")))
        below = F.lit(True) if bound >= 16 ** 13 else h < F.lit(f"{max(bound, 0):013x}")
        t = t.cast("bigint")

        def body(v):
            kind = F.substring(v["h"], 14, 7)
            other = F.lit(FIRST_ID).cast("bigint") + F.conv(F.substring(v["h"], 21, 12), 16, 10).cast("bigint") % max(1, n_vocab)
            put = F.when(kind < F.lit(f"{16 ** 7 * 8 // 10:07x}"), F.lit(MASK_ID).cast("bigint")).when(kind < F.lit(f"{16 ** 7 * 9 // 10:07x}"), other).otherwise(t)
            return F.struct(put.alias("x"), t.alias("y"))
        # no digest for padding, and no more than the digest for positions that are not taken
        return F.when((t != PAD_ID) & below, tx.let({"h": h}, body)).otherwise(F.struct(t.alias("x"), F.lit(IGNORE).cast("bigint").alias("y")))
    masks = lambda v: F.transform(v["ids"], lambda t, i: one(v["key"], t, i))
    return tx.let({"m": tx.let({"ids": ids, "key": F.concat(doc_id.cast("string"), F.lit(":"))}, masks)}, lambda v: F.struct(
        F.transform(v["m"], lambda s: s["x"]).alias("masked"), F.transform(v["m"], lambda s: s["y"]).alias("labels")))

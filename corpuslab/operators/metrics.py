"""Per-document metrics, one row per document, as column expressions.

``prepare`` adds the token and sentence arrays once (its own projection), and
every metric reads those arrays: the text is tokenised once however many
metrics consume it.  No metric shuffles; everything stays inside the row.
Undefined values are NULL; ``filters.with_sentinels`` restores 999.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx


def prepare(df: DataFrame, text: str = "description", summary: str | None = "summary",
            lang: str | None = None) -> DataFrame:
    cols = {"d_tok": tx.tokenize(tx.pipes_to_space(text)), "d_sent": tx.sentences(tx.pipes_to_space(text))}
    if summary:
        cols["s_tok"] = tx.tokenize(tx.pipes_to_space(summary))
        cols["s_sent"] = tx.sentences(tx.pipes_to_space(summary))
    return df.withColumns(cols)


def _ratio_cmp(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.round(F.lit(1.0) - a / b, 4))


def length_features(df: DataFrame) -> DataFrame:
    """Words and sentences of text and summary; compression = round(1 - sum/desc, 4)."""
    sw, ss = F.size("s_tok").cast("int"), F.size("s_sent").cast("int")
    dw, ds = F.size("d_tok").cast("int"), F.size("d_sent").cast("int")
    return df.withColumns({"sum_words": sw, "sum_sents": ss, "desc_words": dw, "desc_sents": ds,
                           "cmp_words": _ratio_cmp(sw, dw), "cmp_sents": _ratio_cmp(ss, ds)})


def length_features_text(df: DataFrame) -> DataFrame:
    return df.withColumns({"desc_words": F.size("d_tok").cast("int"), "desc_sents": F.size("d_sent").cast("int")})


def abstractivity(s_tok="s_tok", d_tok="d_tok") -> Column:
    """1 - share of summary token positions whose token occurs in the text.

    Equal to the greedy-fragment definition: a matching position always starts
    or extends a fragment, and every fragment token occurs in the text.  Empty
    summary -> NULL.  ``array_contains`` is a per-row scan, no shuffle.
    """
    def body(v):
        s, shared = v["s"], v["shared"]
        matched = F.size(F.filter(s, lambda t: F.array_contains(shared, t)))
        return F.when(F.size(s) > 0, F.round(F.lit(1.0) - matched / F.size(s), 4))
    # hash-based intersection first (linear in the text), then a scan over the
    # few shared summary types per summary position
    return tx.let({"s": s_tok, "d": d_tok}, lambda v: tx.let(
        {"s": v["s"], "shared": F.array_intersect(F.array_distinct(v["s"]), v["d"])}, body))


def redundancy_ttr(tokens: Column) -> Column:
    """round(1 - distinct/total, 4) on stop-word-free tokens; no tokens -> NULL."""
    def body(v):
        n = F.size(v["t"])
        return F.when(n > 0, F.round(F.lit(1.0) - F.size(F.array_distinct(v["t"])) / n, 4))
    return tx.let({"t": tokens}, body)


def jaccard(a: Column, b: Column) -> Column:
    """Default pair score for coherence: Jaccard of the two token sets (0 if both empty)."""
    def body(v):
        inter = F.size(F.array_intersect(v["a"], v["b"]))
        union = F.size(F.array_union(v["a"], v["b"]))
        return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return tx.let({"a": F.array_distinct(a), "b": F.array_distinct(b)}, body)


def coherence(sents: Column, score=None, first_k: int | None = None) -> Column:
    """Mean pair score over adjacent sentences (0 when fewer than two), rounded 4.

    ``score(tokens_a, tokens_b) -> Column`` is pluggable; the default is Jaccard.
    Pairs are formed inside the row from the sentence array (no window, no join).
    """
    score = score or jaccard
    s = F.slice(sents, 1, first_k) if first_k else sents

    def body(v):
        toks, n = v["toks"], v["n"]
        vals = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                           lambda i: score(F.element_at(toks, i), F.element_at(toks, i + 1)))
        total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x / (n - 1))
        return F.when(n >= 2, F.round(total, 4)).otherwise(F.lit(0.0))
    toks = F.transform(s, lambda x: tx.tokenize(x))
    return tx.let({"toks": toks}, lambda v: tx.let({"toks": v["toks"], "n": F.size(v["toks"])}, body))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def js_of_counts(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance between the token frequency distributions of two
    token arrays, inside the row and linear in the text.

    With m = (p + q) / 2:  JS^2 = (sum p ln p + sum q ln q) / 2 - sum m ln m.
    Each side is counted once (sort + run lengths); the text's counts become a
    map, and only the summary's distinct tokens are looked up in it."""
    def body(v):
        sc, dc, na, nb, dmap = v["sc"], v["dc"], v["na"], v["nb"], v["dmap"]
        hp = tx.array_sum(F.transform(sc, lambda e: _xlogx(e["n"] / na)))
        hq = tx.array_sum(F.transform(dc, lambda e: _xlogx(e["n"] / nb)))
        half_q = tx.array_sum(F.transform(dc, lambda e: _xlogx(e["n"] / nb / 2)))

        def own(e):
            q = F.coalesce(F.element_at(dmap, e["token"]), F.lit(0)) / nb
            return _xlogx((e["n"] / na + q) / 2) - _xlogx(q / 2)
        hm = tx.array_sum(F.transform(sc, own)) + half_q
        return F.sqrt(F.greatest((hp + hq) / 2 - hm, F.lit(0.0)))

    def counts(v):
        return tx.let({"sc": v["sc"], "dc": v["dc"], "na": F.size(v["a"]).cast("double"),
                       "nb": F.size(v["b"]).cast("double"), "dmap": F.map_from_entries(v["dc"])}, body)
    return tx.let({"a": a, "b": b}, lambda v: tx.let(
        {"a": v["a"], "b": v["b"], "sc": tx.token_counts(v["a"]), "dc": tx.token_counts(v["b"])}, counts))


def unigram_similarity(a: str = "s_tok", b: str = "d_tok") -> Column:
    """round(1 - JS distance of unigram distributions, 4); NULL when a side is empty."""
    def body(v):
        x, y = v["x"], v["y"]
        return F.when((F.size(x) > 0) & (F.size(y) > 0), F.round(F.lit(1.0) - js_of_counts(x, y), 4))
    return tx.let({"x": F.col(a), "y": F.col(b)}, body)


def topic_similarity(p: Column, q: Column) -> Column:
    return F.round(F.lit(1.0) - tx.js_distance(p, q), 4)

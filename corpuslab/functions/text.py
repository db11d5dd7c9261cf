"""Pure Column functions for text preparation (no Python at run time).

Every function takes a column name or ``Column`` and returns a ``Column``, so
callers compose them inside one ``select`` and Catalyst keeps the work inside
whole-stage codegen.  Token and sentence arrays that feed several metrics
should be materialised once with ``withColumn`` before the metric ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.stopwords import STOP_WORDS, all_stop_words

# The patterns that define words, tokens and sentences.
WHITESPACE = r"\s+"
TOKEN_PATTERN = r"[\p{L}\p{N}]{2,}"
WORD_PATTERN = r"\S+"
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"
EDGE_SPACE = r"^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(values: dict, body) -> Column:
    """Evaluate each value once and hand it to ``body`` as a lambda variable.

    Catalyst inlines a projected expression wherever it is referenced, and a
    reference inside a higher-order function's lambda is evaluated per element:
    ``transform(a, x -> x / array_sum(tokens(text)))`` would re-tokenise the
    text for every element.  Packing the values into a one-element array and
    mapping ``body`` over it binds them once, whatever the optimizer does.
    """
    packed = F.array(F.struct(*[_c(v).alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(packed, lambda x: body({k: x[k] for k in values})), 1)


def pipes_to_space(c) -> Column:
    """Multi-valued tags are pipe-joined; turn the pipes into spaces."""
    return F.replace(_c(c), F.lit("|"), F.lit(" "))


def word_count(c) -> Column:
    """Whitespace-separated word count (runs of non-space); the empty string has 0.
    One codegen'd regex count, no array is built."""
    return F.regexp_count(_c(c), F.lit(WORD_PATTERN)).cast("bigint")


def tokenize(c) -> Column:
    """Lower-cased letter/digit runs of at least two characters (the text is
    lower-cased first, so no per-token lambda runs)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def stop_words_for(lang) -> Column:
    """The stop list of a row's language as an array literal column."""
    expr = F.array(*[F.lit(w) for w in all_stop_words()])
    for code in sorted(STOP_WORDS):
        expr = F.when(_c(lang) == code, F.array(*[F.lit(w) for w in STOP_WORDS[code]])).otherwise(expr)
    return expr


def tokenize_nostop(c, lang=None) -> Column:
    """``tokenize`` without stop words; keeps repeats (unlike ``array_except``)."""
    stop = stop_words_for(lang) if lang is not None else F.array(*[F.lit(w) for w in all_stop_words()])
    return F.filter(tokenize(c), lambda t: ~F.array_contains(stop, t))


def remove_stop(tokens, lang=None) -> Column:
    stop = stop_words_for(lang) if lang is not None else F.array(*[F.lit(w) for w in all_stop_words()])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, t))


def sentences(c) -> Column:
    """Rule-based sentences: runs of non-terminators plus their terminators, trimmed, non-empty."""
    parts = F.regexp_extract_all(_c(c), F.lit(SENTENCE_PATTERN), F.lit(0))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, EDGE_SPACE, ""))
    return F.filter(trimmed, lambda s: s != "")


def strip_markers(c) -> Column:
    """Drop the 7-char start marker and the 4-char end marker of generated text."""
    x = _c(c)
    return F.substring(x, F.lit(8), F.greatest(F.length(x) - 11, F.lit(0)))


def id_fields(c) -> Column:
    return F.split(_c(c), ":")


def decade_of_id(c) -> Column:
    """Fourth ':'-field of the identifier is the year; floor it to the decade."""
    year = F.element_at(id_fields(c), 4).cast("int")
    return (F.floor(year / 10) * 10).cast("int")


def year_of_id(c) -> Column:
    return F.element_at(id_fields(c), 4).cast("int")


def ngrams(words, n: int) -> Column:
    """Space-joined n-grams of a word array (empty when shorter than n)."""
    def body(v):
        w = v["w"]
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1),
                            lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))
    return let({"w": words}, body)


def token_counts(tokens) -> Column:
    """array<struct<token, n>>: each distinct token of the row with its count.

    Sort once, find where runs of equal tokens start, and take run lengths from
    consecutive starts: linear after the sort, inside the row (no explode /
    groupBy shuffle per (document, token))."""
    def body(v):
        s, n = v["s"], v["n"]
        starts = F.filter(F.sequence(F.lit(1), n),
                          lambda i: F.when(i == 1, F.lit(True))
                          .otherwise(F.element_at(s, i) != F.element_at(s, i - 1)))

        def runs(w):
            st = w["st"]
            ends = F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(n + 1))
            return F.zip_with(st, ends, lambda a, b: F.struct(F.element_at(s, a).alias("token"),
                                                             (b - a).cast("bigint").alias("n")))
        return F.when(n > 0, let({"st": starts}, runs)).otherwise(
            F.array().cast("array<struct<token:string,n:bigint>>"))
    return let({"s": F.array_sort(_c(tokens))}, lambda v: let({"s": v["s"], "n": F.size(v["s"])}, body))


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda a, x: a + x)


def softmax(arr) -> Column:
    def body(v):
        ex = F.transform(v["a"], lambda x: F.exp(x - v["mx"]))
        return let({"ex": ex}, lambda e: let({"s": array_sum(e["ex"])},
                                             lambda t: F.transform(e["ex"], lambda x: x / t["s"])))
    a = _c(arr)
    return let({"a": a, "mx": F.array_max(a)}, body)


def normalise(arr) -> Column:
    return let({"a": arr}, lambda v: let({"s": array_sum(v["a"])},
                                         lambda t: F.transform(v["a"], lambda x: x / t["s"])))


def _kl_to(p, m) -> Column:
    terms = F.zip_with(p, m, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0)))
    return array_sum(terms)


def js_distance(p, q) -> Column:
    """Jensen-Shannon distance (natural log, square root); inputs are normalised first."""
    def body(v):
        m = F.zip_with(v["p"], v["q"], lambda a, b: (a + b) / 2)
        return let({"m": m}, lambda w: F.sqrt(F.greatest(
            (_kl_to(v["p"], w["m"]) + _kl_to(v["q"], w["m"])) / 2, F.lit(0.0))))
    return let({"p": normalise(p), "q": normalise(q)}, body)


def argmax(arr) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return let({"a": arr}, lambda v: (F.array_position(v["a"], F.array_max(v["a"])) - 1).cast("int"))


def rouge_words(c) -> Column:
    """Words as the ROUGE scorer sees them: split on '.', drop empty parts,
    collapse whitespace inside each part, split on single spaces, concatenate."""
    parts = F.filter(F.split(_c(c), r"\."), lambda s: F.length(s) > 0)
    words = F.transform(parts, lambda s: F.split(F.trim(F.regexp_replace(s, WHITESPACE, " ")), " "))
    return F.flatten(words)

"""Projections, filters and predicates (narrow: no shuffle except semi joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import word_count
from corpuslab.operators.ranking import exact_quantiles

SENTINEL = 999
SCORE_PREFIXES = ("inf", "rel", "flu", "coh")
SCORE_TARGETS = ("summary", "summary_full_model", "summary_cluster_model")


def viable_filter(cases: DataFrame, min_summary_words: int = 10, max_desc_words: int | None = 1024,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Complete cases with an informative summary (>= 10 words, not '-') and a
    description of at most 1,024 words; keeps identifier, summary, description."""
    cond = ((F.col("missing_parts") == "none") & (F.col("summary") != "-")
            & (word_count("summary") >= min_summary_words))
    if max_desc_words is not None:
        cond = cond & (word_count("description") <= max_desc_words)
    return cases.where(cond).select("identifier", "summary", "description", *keep)


def complete_filter(cases: DataFrame, min_summary_words: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    return viable_filter(cases, min_summary_words, None, keep)


def id_subset(df: DataFrame, ids, col: str = "identifier") -> DataFrame:
    """Keep rows whose id is in ``ids``: a short Python list becomes ``isin``
    (pushed to the scan); a DataFrame becomes a left-semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.where(F.col(col).isin(list(ids)))


def id_lookup(df: DataFrame, value, col: str = "identifier") -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def length_equals(df: DataFrame, n: int = 1000, col: str = "desc_words") -> DataFrame:
    return df.where(F.col(col) == n)


def quantile_trim(df: DataFrame, col: str, p: float = 0.99) -> DataFrame:
    """Keep min <= x <= p-quantile (both inclusive, linear interpolation).  The
    two bounds are exact scalars computed without a single-task sort."""
    lo, hi = exact_quantiles(df, col, [0.0, p])
    if lo is None:
        return df.limit(0)
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def any_sentinel(cols: list[str], sentinel=SENTINEL) -> Column:
    cond = None
    for c in cols:
        x = F.col(c) == sentinel
        cond = x if cond is None else cond | x
    return cond


def no_sentinel(cols: list[str], sentinel=SENTINEL) -> Column:
    cond = None
    for c in cols:
        x = F.col(c) != sentinel
        cond = x if cond is None else cond & x
    return cond


def drop_sentinel(df: DataFrame, cols: list[str], sentinel=SENTINEL) -> DataFrame:
    return df.where(no_sentinel(cols, sentinel))


def sentinel_audit(df: DataFrame, cols: list[str], sentinel=SENTINEL) -> DataFrame:
    return df.where(any_sentinel(cols, sentinel))


def with_sentinels(df: DataFrame, cols: list[str], sentinel=SENTINEL) -> DataFrame:
    """NULL means 'undefined' inside the library; restore the reference's 999."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in cols})


def computed_only(df: DataFrame, col: str, drop: list[str] = ("summary", "description")) -> DataFrame:
    return df.where(F.col(col).isNotNull()).drop(*drop)


def add_score_columns(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    cols = {f"{m}_{t}": F.lit(0).cast("int") for t in SCORE_TARGETS for m in SCORE_PREFIXES}
    return df.drop(*drop).withColumns(cols)


def rename_prefix(df: DataFrame, prefix: str, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in cols})

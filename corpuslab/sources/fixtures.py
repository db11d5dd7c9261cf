"""Stand-in views that map the driver tables onto the reference's data model.

The reference works on court decisions (identifier, summary, description,
missing_parts ...).  The driver ships a generic document corpus instead; these
views derive the reference's tables from it with column expressions only, so
their cost grows with the input and every operator downstream runs on whole
tables.  Each view has a DuckDB twin in ``corpuslab.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.sources.tables import table

SCORE_COLUMNS = [f"{m}_{s}" for s in ("summary", "summary_full_model", "summary_cluster_model")
                 for m in ("inf", "rel", "flu", "coh")]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_case stand-in: identifier, summary, description, missing_parts, class.

    A labelled document has a summary (its first line; '-' when flagged toxic);
    an unlabelled one misses it.  Every 97th document misses its description.
    Sentinel 'none' is kept in-band as in the reference's raw table.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").alias("d")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    no_label = F.col("l.doc_id").isNull()
    no_desc = (F.col("d.doc_id") % 97) == 0
    identifier = F.concat(F.lit("ID:XX:"), F.upper("d.source"), F.lit(":"),
                          (F.lit(1910) + F.col("d.doc_id") % 111).cast("string"), F.lit(":"),
                          F.col("d.doc_id").cast("string"))
    summary = (F.when(no_label, F.lit("none"))
               .when(F.col("l.toxic") == 1, F.lit("-"))
               .otherwise(F.split_part(F.col("d.text"), F.lit("\n"), F.lit(1))))
    description = F.when(no_desc, F.lit("none")).otherwise(F.col("d.text"))
    missing = (F.when(no_label & no_desc, F.lit("summary|description"))
               .when(no_label, F.lit("summary"))
               .when(no_desc, F.lit("description"))
               .otherwise(F.lit("none")))
    return j.select(F.col("d.doc_id").alias("doc_id"), identifier.alias("identifier"),
                    summary.alias("summary"), description.alias("description"),
                    missing.alias("missing_parts"), F.col("d.lang").alias("class"),
                    F.col("d.n_chars").alias("n_chars"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference/candidate pairs: a user turn and the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"),
        F.concat(F.lit("</s><s>"), F.col("text"), F.lit("</s>")).alias("c_summary"))
    return u.join(a, ["conv_id", "turn"], "inner")


# The runs of the stand-in loss curves, as the events table names them.
CURVE_RUNS = ["click", "error", "purchase", "signup", "view"]


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss-curve stand-in: one run per event type, one point per day.

    (run, epoch, n, loss): epoch counts days from 0; n is the number of events,
    used as the run's weight; loss is the day's mean value.
    """
    from pyspark.sql import Window as W
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    daily = (ev.groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day"))
             .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("loss")))
    w = W.partitionBy("run").orderBy("day")
    return daily.select("run", (F.row_number().over(w) - 1).cast("int").alias("epoch"),
                        F.col("n").cast("bigint").alias("n"), "loss")


def generated(spark: SparkSession, sf_dir: str, cases_df: DataFrame | None = None) -> DataFrame:
    """generated_summary stand-in: (identifier, model, c_summary).

    Model 'full' emits the description's second line, the class model (named
    after the class) its third line; both wrapped in the generator's markers.
    """
    c = cases_df if cases_df is not None else cases(spark, sf_dir)
    c = c.where(F.col("description") != "none")
    wrap = lambda x: F.concat(F.lit("</s><s>"), x, F.lit("</s>"))
    line = lambda k: F.split_part(F.col("description"), F.lit("\n"), F.lit(k))
    # both models from one pass over the cases (no union of two scans)
    both = F.array(F.struct(F.lit("full").alias("model"), wrap(line(2)).alias("c_summary")),
                   F.struct(F.col("class").alias("model"), wrap(line(3)).alias("c_summary")))
    return c.select("identifier", F.explode(both).alias("g")).select("identifier", "g.model", "g.c_summary")


def eval_scores(spark: SparkSession, sf_dir: str, cases_df: DataFrame | None = None) -> DataFrame:
    """Human-score stand-in: 12 scores in 1..5 per case, derived from n_chars."""
    c = cases_df if cases_df is not None else cases(spark, sf_dir)
    cols = [(F.lit(1) + (F.col("n_chars") * (2 * k + 1) + k) % 5).cast("int").alias(name)
            for k, name in enumerate(SCORE_COLUMNS)]
    return c.select("identifier", "class", *cols)

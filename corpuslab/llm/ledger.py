"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The
ledger is a table (blob, rules, findings); a scan computes the blobs of its
input, leaves out those that the ledger has for this rule version, scans each
unseen blob once however many paths carry it, adds the findings to the ledger,
and joins them back to all paths.  DataFrame functions only.

Positions without a UDF: a text split at a pattern's matches gives the gaps
between them, so the start of match i is the length of the gaps and matches
before it.  Lengths are in code points.

Rules (fixed values, ``RULES``): kind, pattern, and the test that a match must
pass; matches are leftmost and non-overlapping, a failing match is dropped
after it was matched.

Edge cases: a null or empty text has no findings; null paths and repeated rows
each get their row back; an empty table gives an empty result; columns other
than the path and the text are carried along if they do not clash with
``blob`` and the result's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import read, shared_dir, sheltered

# The three base kinds, in the order in which equal starts are listed.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RULES = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
RULE_VERSION = "base-1"


def _spans(text: Column, order: int, kind: str, pattern: str) -> Column:
    """Spans (start, order, kind, end) of one kind, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    at = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length),
                    lambda g, m: F.struct(F.coalesce(g, F.lit(0)).alias("g"), F.coalesce(m, F.lit(0)).alias("m")))
    ends = F.aggregate(
        at, F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<a:int,b:int>>").alias("all")),
        lambda acc, x: F.struct((acc["p"] + x["g"] + x["m"]).alias("p"),
                                F.concat(acc["all"], F.array(F.struct((acc["p"] + x["g"]).alias("a"), (acc["p"] + x["g"] + x["m"]).alias("b")))).alias("all")),
        lambda acc: acc["all"])
    both = F.zip_with(ends, value, lambda e, v: F.struct(e["a"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), e["b"].alias("end"), F.length(v).alias("n")))
    kept = F.filter(both, lambda s: s["n"] >= (6 if kind == "assign" else 1))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,n:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(none)


def find(text: Column) -> Column:
    """All spans of a text, sorted by start, then by kind as listed in RULES."""
    return F.sort_array(F.concat(*[_spans(text, i, k, p) for i, (k, p) in enumerate(RULES)]))


def scan(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: str = RULE_VERSION,
         with_text: bool = False) -> DataFrame:
    """``versions`` with blob and findings (and without the text unless asked for); the ledger folder gains the blobs that it did not have.

    ``ledger`` may be a folder that does not exist yet.
    """
    spark = versions.sparkSession
    v = versions.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("blob", F.sha2(F.col(text).cast("binary"), 256))
    # one carrier per blob; only blobs that the ledger lacks for these rules
    carrier = v.groupBy("blob").agg(F.min(path).alias("carrier"))
    try:
        known = spark.read.parquet(ledger).where(F.col("rules") == rules).select("blob")
    except Exception as e:  # noqa: BLE001 - a ledger that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    unseen = carrier if known is None else carrier.join(known, "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("b"), F.col("carrier").alias("c"))
    # dealt by (blob, path): copies of one text do not meet in one task
    blobs = v.select("blob", path, text).join(unseen, (F.col("blob") == F.col("b")) & F.col(path).eqNullSafe(F.col("c")), "left_semi")
    found = (blobs.select("blob", find(F.col(text)).alias("findings")).dropDuplicates(["blob"])
             .withColumn("rules", F.lit(rules)))
    found.write.mode("append").parquet(ledger)
    entries = spark.read.parquet(ledger).where(F.col("rules") == rules).where(F.size("findings") > 0)
    entries = entries.groupBy("blob").agg(F.first("findings").alias("findings"))  # a rerun after a failure may add a blob twice
    empty = F.array().cast(entries.schema["findings"].dataType)
    return (v if with_text else v.drop(text)).join(entries, "blob", "left").withColumn("findings", F.coalesce("findings", empty))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``*``, and n_chars counted anew; null texts become empty."""
    kind = docs.schema["n_chars"].dataType
    docs, whole = sheltered(docs, "doc_id", "text", "n_chars")
    out = scan(docs, shared_dir(docs.sparkSession, "ledger"), with_text=True)
    out = out.withColumn("text", redact(F.col("text"), F.col("findings")))
    return whole(out.withColumn("n_chars", F.length("text").cast(kind)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span's characters replaced by one ``*`` for each maximal run of covered characters."""
    end = F.length(text)
    cut = F.aggregate(
        spans, F.struct(F.lit(0).alias("p"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["p"], s["end"]).alias("p"),
            F.when(s["start"] >= acc["p"], F.concat(acc["out"], F.substring(text, acc["p"] + 1, s["start"] - acc["p"]), F.lit("*")))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["p"] + 1, end)))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of ``documents`` through a new ledger."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, shared_dir(spark, "ledger"))
    def n(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                      F.sha2(listed(F.col("findings")).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, regexp_extract_all(t, '{assign}', 0) AS m, regexp_extract_all(t, '{assign}', 2) AS v,
         string_split_regex(t, '{assign}') AS g FROM d WHERE regexp_matches(t, '{assign}')
  UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(t, '{access}', 0), NULL, string_split_regex(t, '{access}') FROM d WHERE regexp_matches(t, '{access}')
  UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(t, '{hex}', 0), NULL, string_split_regex(t, '{hex}') FROM d WHERE regexp_matches(t, '{hex}')),
pos AS (
  SELECT doc_id, rank, kind, i, m[i] AS hit, v[i] AS val,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
kept AS (SELECT *, CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS se FROM pos WHERE val IS NULL OR length(val) >= 6),
per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
               string_agg(kind || ':' || se, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
""".format(assign=ASSIGN.replace("'", "''"), access=ACCESS, hex=HEX)

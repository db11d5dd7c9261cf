"""WARC archives with content-addressed payloads.

``write`` turns pages into three tables in a shared folder:

* ``payloads``: one row per distinct payload (zstd), addressed by its SHA-256,
  which ``read_back`` verifies against the bytes;
* ``headers``: per record the exact header block (bytes up to and including
  the empty line), the payload's address and the record's identity;
* nothing is stored twice: a revisit has a header and no payload of its own.

``read_back`` joins the headers with the payloads, rebuilds every record byte
for byte (header block, payload, two line ends), and takes the result columns
from the parsed header block, not from the table that was written.

Which record holds the payload: of the records with equal payloads of at least
``min_bytes`` bytes the one with the largest page_id is ``response``, the
others are ``revisit`` records that name it; smaller payloads are ``response``
always.  Groups are found with one aggregation on the digest (partial sums
first, so a payload on a third of all pages moves one row per task) and a join
back on the digest that adaptive execution may split.

Edge cases: null html is an empty payload; a null page_id writes ``-``, reads
back as null, and ranks below every other id; of rows that repeat the largest
page_id every one is a response; an empty table gives empty archives; a null
url writes an empty target; other columns are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import read, shared_dir

MIN_BYTES = 1000
EOL = "\r\n"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the archive of ``pages`` (page_id, url, html) into ``folder``."""
    spark = pages.sparkSession
    pack, _ = _codec()
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "sha1": F.sha1("payload"),
                             "n": F.octet_length("payload").cast("long")})
    holder = rows.groupBy("address").agg(F.max("page_id").alias("holder"))
    records = rows.drop("payload").join(holder, "address")
    revisit = (F.col("n") >= min_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    stored = F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    # an url cannot break a header line: control characters are percent-encoded
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1" + EOL), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(EOL),
        F.lit("WARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(EOL),
        F.lit("WARC-Target-URI: "), target, F.lit(EOL),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(EOL),
        F.lit("WARC-Payload-Length: "), F.col("n").cast("string"), F.lit(EOL),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("holder")), F.lit(EOL))).otherwise(F.lit("")),
        F.lit("Content-Length: "), stored.cast("string"), F.lit(EOL + EOL))
    records.select("page_id", "address", head.cast("binary").alias("header")).write.parquet(f"{folder}/headers")
    # only the holders' payloads: dealt by (address, page_id), so that no group of copies meets in one task
    def key(c):
        return [F.col(c).isNull().alias("k0"), F.coalesce(c, F.lit(0)).alias("k1")]
    held = holder.select("address", *key("holder"))
    (rows.select("address", *key("page_id"), pack("payload").alias("payload")).join(held, ["address", "k0", "k1"], "left_semi")
     .dropDuplicates(["address", "k0", "k1"]).select("address", "payload").write.parquet(f"{folder}/payloads"))


def _codec():
    """Arrow functions that compress and restore payloads; stored and shuffled they are compressed."""
    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        import zstandard
        c = zstandard.ZstdCompressor()
        return x.map(c.compress)

    @F.pandas_udf("binary")
    def unpack(x: pd.Series) -> pd.Series:
        import zstandard
        d = zstandard.ZstdDecompressor()
        return x.map(d.decompress, na_action="ignore")
    return pack, unpack


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive: page_id, record (exact bytes), the payload, and the parsed header fields.

    A payload whose SHA-256 differs from its address, or a record whose header
    does not fit its payload, raises an error.
    """
    heads = spark.read.parquet(f"{folder}/headers")
    _, unpack = _codec()
    payloads = spark.read.parquet(f"{folder}/payloads")
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))

    def page(ref: Column) -> Column:
        return F.regexp_extract(ref, r"^<urn:page:(-?\d+)>$", 1)
    rec = heads.join(payloads, "address", "left").withColumn("payload", unpack("payload"))
    rec = rec.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload"))
                         .otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("address"))).cast("binary")))
    rec = rec.withColumns({
        "record_type": field("WARC-Type"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "payload_bytes": field("WARC-Payload-Length").cast("long"), "stored_bytes": field("Content-Length").cast("long"),
        "id_text": page(field("WARC-Record-ID")), "ref_text": page(field("WARC-Refers-To"))})
    whole = (F.col("payload").isNotNull() & (F.octet_length("payload") == F.col("payload_bytes"))
             & (F.sha1("payload") == F.col("payload_digest")))
    rec = rec.withColumn("payload", F.when(whole, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("record does not fit its payload: "), text)).cast("binary")))
    body = F.when(F.col("stored_bytes") > 0, F.col("payload")).otherwise(F.lit("").cast("binary"))
    return rec.select(
        F.nullif("id_text", F.lit("")).cast("long").alias("page_id"),
        F.concat("header", body, F.lit(EOL + EOL).cast("binary")).alias("record"), "payload", "payload_bytes",
        "payload_digest", "record_type", F.nullif("ref_text", F.lit("")).cast("long").alias("refers_to"))


def op8_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as a content-addressed archive and read back."""
    folder = shared_dir(spark, "warc")
    write(read(spark, sf_dir, "pages"), folder)
    back = read_back(spark, folder)
    # length and digest come from the payload that the join returned
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS a, octet_length(encode(coalesce(page_id::VARCHAR, '-'))) AS id_len FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY a) AS top FROM d),
r AS (SELECT *, (n >= {least} AND top IS NOT NULL AND page_id IS DISTINCT FROM top) AS again FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM r
""".format(least=MIN_BYTES)

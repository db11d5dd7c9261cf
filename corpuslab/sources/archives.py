"""Month archives of XML case documents: build, list, explode, parse.

* ``case_xml`` renders a cases table as XML documents in the layout of the
  public case-law open-data format (RDF metadata block, summary element, body
  element) with column expressions only.
* ``write_archives`` writes zip archives and ``archive_explode`` reads their
  members, both through the data source in ``ziparchives``: no task holds an
  archive, and a failed write leaves no file.
* ``archive_scan`` lists archives with the ``binaryFile`` source (content is
  not read unless selected); ``parse_cases`` turns the XML into the raw_case
  table with ``xpath`` expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import EDGE_SPACE
from corpuslab.sources import ziparchives as zp

# Element names of the source format (local names; the
# metadata elements carry the dcterms / psi namespace prefixes).
NS = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
      "dcterms": "http://purl.org/dc/terms/",
      "psi": "urn:corpuslab:psi"}
SINGLE_TAGS = {"identifier": "identifier", "seat_location": "spatial", "creator": "creator", "case_type": "type"}
MULTI_TAGS = {"jurisdiction": "subject", "case_number": "zaaknummer", "procedures": "procedure",
              "references": "references", "relation": "relation"}
DATE_TAGS = {"issue_date": "issued", "judgment_date": "date"}
DATETIME_TAGS = {"modified": "modified"}
SUMMARY_TAG, BODY_TAG, BODY_FALLBACK_TAG = "inhoudsindicatie", "uitspraak", "conclusie"
DATE_FMT, DATETIME_FMT = "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss"
FIRST_YEAR, LAST_YEAR, MISSING_YEARS = 1911, 2022, (1912,)

#: Bytes of text that one archive is written with at about most; a month with more is cut into parts.
PART_BYTES = 256 << 20


def _esc(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def _el(tag: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), _esc(c), F.lit(f"</{tag}>"))


def _paras(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda s: s != "")
    return F.array_join(F.transform(lines, lambda s: _el("para", s)), "")


def case_xml(cases: DataFrame) -> DataFrame:
    """(identifier, year, month, xml) from the cases stand-in.

    Metadata is derived from the row: seat = source field of the identifier,
    subjects = class and the identifier's country field, dates from the year.
    Every 7th body uses the fallback element name.
    """
    f = F.split("identifier", ":")
    year = F.element_at(f, 4)
    month = F.lpad(((F.col("doc_id") / 111).cast("bigint") % 12 + 1).cast("string"), 2, "0")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    date = F.concat(year, F.lit("-"), month, F.lit("-"), day)
    meta = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="%s" xmlns:dcterms="%s" xmlns:psi="%s"><rdf:Description>'
              % (NS["rdf"], NS["dcterms"], NS["psi"])),
        _el("dcterms:identifier", F.col("identifier")),
        _el("dcterms:spatial", F.element_at(f, 3)),
        _el("dcterms:creator", F.concat(F.lit("court-"), F.element_at(f, 3))),
        _el("dcterms:type", F.lit("uitspraak")),
        _el("dcterms:subject", F.col("class")),
        _el("dcterms:subject", F.element_at(f, 2)),
        _el("psi:zaaknummer", F.element_at(f, 5)),
        _el("dcterms:issued", date),
        _el("dcterms:date", date),
        _el("dcterms:modified", F.concat(date, F.lit("T12:00:00"))),
        F.lit("</rdf:Description></rdf:RDF>"))
    summary = F.when(F.col("summary") != "none",
                     F.concat(F.lit(f"<{SUMMARY_TAG}>"), _paras(F.col("summary")), F.lit(f"</{SUMMARY_TAG}>")))
    body_tag = F.when(F.col("doc_id") % 7 == 3, F.lit(BODY_FALLBACK_TAG)).otherwise(F.lit(BODY_TAG))
    body = F.when(F.col("description") != "none",
                  F.concat(F.lit("<"), body_tag, F.lit(">"), _paras(F.col("description")),
                           F.lit("</"), body_tag, F.lit(">")))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><document>'), meta,
                   F.coalesce(summary, F.lit("")), F.coalesce(body, F.lit("")), F.lit("</document>"))
    return cases.select("identifier", year.alias("year"), month.alias("month"), xml.alias("xml"))


def write_archives(xml_df: DataFrame, out_dir: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write ``<out>/<year>/<year><month>_p<part>.zip`` archives of about ``part_bytes`` bytes of text; returns the archives found.

    Rows are dealt out by archive and sorted by member, so a task streams them into its files; the files appear
    together when all tasks are done (see ``ziparchives``).
    """
    spark = xml_df.sparkSession
    zp.register(spark)
    sizes = xml_df.groupBy("year", "month").agg(F.sum(F.octet_length("xml")).alias("_n"))
    parts = sizes.select(F.col("year").alias("_y"), F.col("month").alias("_m"), F.greatest(F.ceil(F.col("_n") / part_bytes), F.lit(1)).cast("int").alias("_parts"))
    j = xml_df.join(parts, F.col("year").eqNullSafe(F.col("_y")) & F.col("month").eqNullSafe(F.col("_m")))
    part = F.lpad(F.pmod(F.xxhash64("identifier"), F.col("_parts")).cast("string"), 4, "0")
    rows = j.select(F.concat("year", F.lit("/"), "year", "month", F.lit("_p"), part, F.lit(".zip")).alias("archive"),
                    F.concat(F.replace("identifier", F.lit(":"), F.lit("_")), F.lit(".xml")).alias("member"), F.col("xml").cast("binary").alias("data"))
    rows.repartition("archive").sortWithinPartitions("archive", "member").write.format("ziparchives").mode("append").save(out_dir)
    return archive_scan(spark, out_dir)


def _archives(spark, root: str, cols: list[str]) -> DataFrame:
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.zip")
          .option("recursiveFileLookup", "true").load(root).select("path", *cols))
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    out = df.select("path", name.alias("name"), F.substring(name, 1, 4).alias("year"),
                    F.substring(name, 5, 2).alias("month"), *cols)
    y = F.col("year").cast("int")
    return out.where(y.between(FIRST_YEAR, LAST_YEAR) & ~y.isin(*MISSING_YEARS))


def archive_scan(spark, root: str) -> DataFrame:
    """Archives under year folders (1911-2022 without 1912): path, name, year, month, length.

    year = name[:4], month = the two characters after it (the archive part
    suffix is ignored).  The file content is not read here.
    """
    return _archives(spark, root, ["length"])


def archive_explode(spark, root: str, range_bytes: int = zp.RANGE_BYTES) -> DataFrame:
    """One row per archive member: (year, month, member, xml); every task reads a byte range of one archive."""
    zp.register(spark)
    rows = spark.read.format("ziparchives").option("rangeBytes", range_bytes).load(root)
    name = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    out = rows.select(F.substring(name, 1, 4).alias("year"), F.substring(name, 5, 2).alias("month"), "member", F.decode("data", "UTF-8").alias("xml"))
    y = F.col("year").cast("int")
    return out.where(y.between(FIRST_YEAR, LAST_YEAR) & ~y.isin(*MISSING_YEARS))


def _local(tag: str) -> str:
    return f"//*[local-name()='{tag}']"


#: Between the parts of ``_head``; no XML document may hold it.
_SEP = "\x01"
_FIRST_TAGS = [*SINGLE_TAGS.values(), *DATE_TAGS.values(), *DATETIME_TAGS.values()]
_TEXT_TAGS = [SUMMARY_TAG, BODY_TAG, BODY_FALLBACK_TAG]


def _head() -> Column:
    """What few parses of the document tell of all tags: whether each is there, the text of the first of those with one
    value, and if the others have text nodes.  Every xpath function parses the document anew, but an expression may
    have no more than 100 operators."""
    parts = [p for t in _FIRST_TAGS for p in (f"boolean({_local(t)})", f"string({_local(t)})")]
    parts += [f"count({_local(t)}/text()) > 0" for t in MULTI_TAGS.values()] + [f"boolean({_local(t)})" for t in _TEXT_TAGS]
    joined = [f", '{_SEP}', ".join(parts[i:i + 6]) for i in range(0, len(parts), 6)]
    return F.split(F.concat_ws(_SEP, *[F.expr(f"xpath_string(xml, \"concat({j})\")") for j in joined]), _SEP)


def _part(i: int) -> Column:
    return F.get("_head", F.lit(i))


def _first(tag: str) -> Column:
    at = 2 * _FIRST_TAGS.index(tag)
    return F.when(_part(at) == "true", _part(at + 1))


def _all(tag: str) -> Column:
    there = _part(2 * len(_FIRST_TAGS) + list(MULTI_TAGS.values()).index(tag))
    return F.when(there == "true", F.array_join(F.expr(f"xpath(xml, \"{_local(tag)}/text()\")"), "|"))


def element_text(tag: str) -> Column:
    """All text nodes under the element, each trimmed, empty ones dropped, joined by one space."""
    nodes = F.expr(f"xpath(xml, \"{_local(tag)}//text()\")")
    clean = F.filter(F.transform(nodes, lambda s: F.regexp_replace(s, EDGE_SPACE, "")), lambda s: s != "")
    there = _part(2 * len(_FIRST_TAGS) + len(MULTI_TAGS) + _TEXT_TAGS.index(tag))
    return F.when(there == "true", F.array_join(clean, " "))


def parse_cases(xml_df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """XML documents -> raw_case columns (NULL for absent values; see ``with_none``) beside the columns ``keep``."""
    cols = {k: _first(t) for k, t in SINGLE_TAGS.items()}
    for k, t in MULTI_TAGS.items():
        cols[k] = _all(t)
    for k, t in DATE_TAGS.items():
        cols[k] = F.try_to_timestamp(_first(t), F.lit(DATE_FMT))
    for k, t in DATETIME_TAGS.items():
        cols[k] = F.try_to_timestamp(_first(t), F.lit(DATETIME_FMT))
    cols["summary"] = element_text(SUMMARY_TAG)
    cols["description"] = F.coalesce(element_text(BODY_TAG), element_text(BODY_FALLBACK_TAG))
    cols["publisher"] = F.lit(None).cast("string")
    out = xml_df.withColumn("_head", _head()).select(*keep, "year", "month", *[v.alias(k) for k, v in cols.items()])
    missing = F.concat_ws("|", F.when(F.col("summary").isNull(), F.lit("summary")),
                          F.when(F.col("description").isNull(), F.lit("description")))
    return out.withColumn("missing_parts", F.coalesce(F.nullif(missing, F.lit("")), F.lit("none")))


def with_none(df: DataFrame) -> DataFrame:
    """Restore the reference's in-band 'none' for absent string values."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("none")) for c in strings})

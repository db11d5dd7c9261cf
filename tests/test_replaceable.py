"""Replaced archives: the stream's tables equal the batch over the deliveries that count, after replacements and restarts."""
import os
import zipfile

from pyspark.sql import functions as F

from corpuslab.operators.aggregates import decade_counts
from corpuslab.session import fresh_dir
from corpuslab.sources import archives as ar
from corpuslab.streaming import replaceable as rpl


def doc(identifier, summary):
    return (f'<document><rdf:RDF xmlns:rdf="r" xmlns:dcterms="d"><dcterms:identifier>{identifier}</dcterms:identifier></rdf:RDF>'
            + (f"<inhoudsindicatie>{summary}</inhoudsindicatie>" if summary else "") + "<uitspraak>Body of it</uitspraak></document>")


def deliver(root, folder, name, docs, at):
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    path = f"{root}/{folder}/{name}.zip"
    with zipfile.ZipFile(path + ".part", "w") as z:
        for identifier, summary in docs:
            z.writestr(zipfile.ZipInfo(identifier.replace(":", "_") + ".xml"), doc(identifier, summary))
    os.utime(path + ".part", (at, at))
    os.rename(path + ".part", path)


def ident(year, n):
    return f"ECLI:NL:X:{year}:{n}"


def check(spark, out, now):
    """``now``: archive -> documents that count."""
    rows = sorted((r["identifier"], r["summary"]) for r in rpl.current_rows(spark, out).collect())
    assert rows == sorted((i, s) for docs in now.values() for i, s in docs)
    xml = spark.createDataFrame([("2000", "01", doc(i, s)) for docs in now.values() for i, s in docs], "year string, month string, xml string")
    want = decade_counts(ar.with_none(ar.parse_cases(xml)))
    got = rpl.rollup(spark, out).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replacements(spark):
    root, out, ck = (fresh_dir(spark, x) for x in ("rep-in", "rep-out", "rep-ck"))
    root = root.removeprefix("file:")
    a1 = [(ident(2001, 1), "a short one"), (ident(2001, 2), None)]
    b1 = [(ident(2012, i), "words " * (i + 1)) for i in range(12)]
    deliver(root, "1", "200101_p0000", a1, 1000)
    deliver(root, "1", "201202_p0000", b1, 1000)
    deliver(root, "1", "191201_p0000", [(ident(1912, 1), "a year that is left out")], 1000)
    rpl.ingest(spark, root, out, ck)
    check(spark, out, {"a": [(i, s) for i, s in a1], "b": [(i, s.strip()) for i, s in b1]})
    # another state of one archive, the same bytes again of the other, and an older state that comes late
    a2 = [(ident(2001, 2), "now it has a summary of ten words at the least"), (ident(2003, 3), "x")]
    deliver(root, "2", "200101_p0000", a2, 3000)
    deliver(root, "2", "201202_p0000", b1, 3000)
    rpl.ingest(spark, root, out, ck)
    check(spark, out, {"a": a2, "b": [(i, s.strip()) for i, s in b1]})
    deliver(root, "3", "200101_p0000", [(ident(2001, 9), "late and old")], 2000)
    rpl.ingest(spark, root, out, ck)
    check(spark, out, {"a": a2, "b": [(i, s.strip()) for i, s in b1]})
    # two states in one batch: the newer counts; an archive without members takes all its rows back; the first state may return
    deliver(root, "4", "200101_p0000", a1, 4000)
    deliver(root, "5", "200101_p0000", [], 5000)
    rpl.ingest(spark, root, out, ck)
    check(spark, out, {"a": [], "b": [(i, s.strip()) for i, s in b1]})
    deliver(root, "6", "200101_p0000", a1, 6000)
    rpl.ingest(spark, root, out, ck)
    rpl.ingest(spark, root, out, ck)                        # nothing new
    check(spark, out, {"a": a1, "b": [(i, s.strip()) for i, s in b1]})


def test_a_batch_that_is_run_again_changes_nothing(spark):
    root, out, ck = (fresh_dir(spark, x) for x in ("rep-in", "rep-out", "rep-ck"))
    root = root.removeprefix("file:")
    a = [(ident(2001, 1), "some words")]
    deliver(root, "1", "200101_p0000", a, 1000)
    rpl.ingest(spark, root, out, ck)
    rpl.ingest(spark, root, out, fresh_dir(spark, "rep-ck"))      # the checkpoint is lost: all batches again, into the same tables
    check(spark, out, {"a": a})
    assert spark.read.parquet(f"{out}/rows").agg(F.count("*")).first()[0] == 1

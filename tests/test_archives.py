"""XML parsing on hand-made documents, and the archive round trip."""
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuslab.session import fresh_dir
from corpuslab.sources import archives as ar
from corpuslab.sources import ziparchives as zp
from corpuslab.sources.fixtures import cases

RDF = ('<rdf:RDF xmlns:rdf="r" xmlns:dcterms="d" xmlns:psi="p"><rdf:Description>{}</rdf:Description></rdf:RDF>')


def doc(meta, rest=""):
    return f"<document>{RDF.format(meta)}{rest}</document>"


XML_DOCS = [
    ("all", doc("<dcterms:identifier>A</dcterms:identifier><dcterms:spatial>X</dcterms:spatial>"
                "<dcterms:creator>C</dcterms:creator><dcterms:type>T</dcterms:type>"
                "<dcterms:subject>s1</dcterms:subject><dcterms:subject>s2</dcterms:subject>"
                "<psi:zaaknummer>z</psi:zaaknummer><dcterms:issued>2020-01-02</dcterms:issued>"
                "<dcterms:date>2020-01-03</dcterms:date><dcterms:modified>2020-01-04T05:06:07</dcterms:modified>",
                "<inhoudsindicatie><para>Sum  one</para></inhoudsindicatie><uitspraak><p>Body</p></uitspraak>")),
    ("nosum", doc("<dcterms:identifier>B</dcterms:identifier>", "<uitspraak>Only body</uitspraak>")),
    ("concl", doc("<dcterms:identifier>C</dcterms:identifier>",
                  "<inhoudsindicatie>S</inhoudsindicatie><conclusie>Fallback text</conclusie>")),
    ("nobody", doc("<dcterms:identifier>D</dcterms:identifier>", "<inhoudsindicatie>S</inhoudsindicatie>")),
    ("emptybody", doc("<dcterms:identifier>E</dcterms:identifier>", "<inhoudsindicatie>S</inhoudsindicatie><uitspraak></uitspraak>")),
    ("mixed", doc("<dcterms:identifier>F</dcterms:identifier>",
                  "<inhoudsindicatie>S</inhoudsindicatie><uitspraak><p>a <b>b</b></p> c</uitspraak>")),
    ("baddate", doc("<dcterms:identifier>G</dcterms:identifier><dcterms:date>03-01-2020</dcterms:date>", "")),
]


def test_parse_hand_documents(spark):
    df = spark.createDataFrame([(k, "2020", "01", x) for k, x in XML_DOCS], "k string, year string, month string, xml string")
    p = {r["identifier"]: r for r in ar.with_none(ar.parse_cases(df)).collect()}
    a = p["A"]
    assert (a["seat_location"], a["creator"], a["case_type"]) == ("X", "C", "T")
    assert a["jurisdiction"] == "s1|s2" and a["case_number"] == "z" and a["relation"] == "none"
    assert str(a["judgment_date"]) == "2020-01-03 00:00:00" and str(a["modified"]) == "2020-01-04 05:06:07"
    assert a["summary"] == "Sum  one" and a["description"] == "Body" and a["missing_parts"] == "none"
    assert p["B"]["missing_parts"] == "summary" and p["B"]["summary"] == "none"
    assert p["C"]["description"] == "Fallback text"
    assert p["D"]["missing_parts"] == "description"
    assert p["E"]["description"] == "" and p["E"]["missing_parts"] == "none"
    assert p["F"]["description"] == "a b c"
    assert p["G"]["judgment_date"] is None and p["G"]["seat_location"] == "none"


def test_archive_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    c = cases(spark, sf)
    root = fresh_dir(spark, "arch-test")
    ar.write_archives(ar.case_xml(c), root, part_bytes=40_000).collect()
    scanned = ar.archive_scan(spark, root)
    assert scanned.where(F.col("year").isin("1910", "1912")).count() == 0
    parsed = ar.parse_cases(ar.archive_explode(spark, root))
    expect = c.where(~F.element_at(F.split("identifier", ":"), 4).isin("1910", "1912"))
    assert parsed.count() == expect.count()
    j = parsed.alias("p").join(expect.alias("e"), "identifier")
    assert j.where(F.col("p.missing_parts") != F.col("e.missing_parts")).count() == 0
    # summaries are one line, so they come back verbatim (after edge trimming)
    bad = j.where((F.col("e.summary") != "none") & (F.col("p.summary") != F.trim(F.col("e.summary"))))
    assert bad.count() == 0


def zip_rows(spark, rows):
    return spark.createDataFrame(rows, "archive string, member string, data binary")


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    r = random.Random(1)
    want = {}
    with zipfile.ZipFile(tmp_path / "202001_p0000.zip", "w") as z:
        for i in range(300):
            name, data = f"m{i}é.xml", bytes(r.choices(b"abc ", k=r.randint(0, 3000)))
            z.writestr(name, data, zipfile.ZIP_STORED if i % 3 else zipfile.ZIP_DEFLATED)
            want[name] = data
        z.writestr("folder/", b"")
        z.comment = b"a comment"
    zp.register(spark)
    df = spark.read.format("ziparchives").option("rangeBytes", 50_000).load(str(tmp_path))
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert {x["member"]: bytes(x["data"]) for x in got} == want and len(got) == 300
    assert len({x["task"] for x in got}) > 5
    assert spark.read.format("ziparchives").load(str(tmp_path / "nothing here")).count() == 0


def test_long_directories_and_wide_fields(tmp_path, monkeypatch):
    monkeypatch.setattr(zp, "CHUNK", 100)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)       # sizes and offsets go to the 64-bit fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 10)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for i in range(50):
            z.writestr("n" * (i + 1), b"x" * i * 10)
    with open(path, "rb") as f:
        found = list(zp.members(f, path.stat().st_size))
        assert [m[0] for m in found] == ["n" * (i + 1) for i in range(50)]
        assert [zp.content(f, *m[1:4]) for m in found] == [b"x" * i * 10 for i in range(50)]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    zp.register(spark)
    root = str(tmp_path / "out")

    def bad(batches):
        for b in batches:
            yield b
        raise RuntimeError("on purpose")
    good = zip_rows(spark, [(f"a{i % 3}.zip", f"m{i}", b"data") for i in range(30)]).repartition("archive").sortWithinPartitions("archive", "member")
    with pytest.raises(Exception, match="on purpose"):
        good.mapInPandas(bad, good.schema).write.format("ziparchives").mode("append").save(root)
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    for _ in range(2):                                      # a repeated write gives the same files
        good.write.format("ziparchives").mode("append").save(root)
        assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["a0.zip", "a1.zip", "a2.zip"]
        got = spark.read.format("ziparchives").load(root).collect()
        assert sorted(x["member"] for x in got) == sorted(f"m{i}" for i in range(30))


def test_what_a_repeated_task_wrote_is_not_seen(tmp_path):
    w = zp.ZipWriter(str(tmp_path))

    class Context:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            self.attempt += 1
            return self.attempt
    import pyspark
    context, real = Context(), pyspark.TaskContext.get
    pyspark.TaskContext.get = classmethod(lambda cls: context)
    try:
        rows = [{"archive": "x/a.zip", "member": "m", "data": b"1"}]
        w.write(iter(rows))                                 # its message is lost
        second = w.write(iter(rows))
    finally:
        pyspark.TaskContext.get = real
    assert zp.ZipReader(str(tmp_path), 100).partitions()[0].ranges == []
    w.commit([second, None])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["x/a.zip"]

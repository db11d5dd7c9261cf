"""Stream result = batch result; the driver entry points."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslab.operators.aggregates import decade_rollup
from corpuslab.plans import queries as Q
from corpuslab.sources.fixtures import cases

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 12 and "viable_cases" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_rollup_equals_batch(spark):
    got = {r["decade"]: r.asDict() for r in Q.q_incremental_decade_rollup(spark, SF).collect()}
    exp = {r["decade"]: r.asDict() for r in decade_rollup(cases(spark, SF)).collect()}
    assert got == exp


def test_stream_ingest_equals_batch(spark):
    s = Q.q_incremental_ingest(spark, SF).select("identifier", "missing_parts")
    b = Q.parsed_cases(spark, SF).select("identifier", "missing_parts")
    assert s.count() == b.count() and s.exceptAll(b).count() == 0

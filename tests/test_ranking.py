"""The two-pass exact rank equals the plain window; the split is an exact partition."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.operators import sampling as smp
from corpuslab.operators.ranking import exact_quantiles, exact_rank, exact_running_sum, seeded_key
from corpuslab.sources.fixtures import cases

SF = "/root/testdata/sf0.01"


def test_exact_rank_equals_window(spark):
    c = cases(spark, SF).select("identifier", "class").withColumn("_key", seeded_key("identifier"))
    fast = exact_rank(c, "_key", parts=["class"], out="r")
    slow = c.withColumn("r2", F.row_number().over(W.partitionBy("class").orderBy("_key")))
    j = fast.join(slow.select("identifier", "r2"), "identifier")
    assert j.where(F.col("r") != F.col("r2")).count() == 0 and j.count() == 1000


def test_running_sum_equals_window(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars").withColumn("_key", seeded_key("doc_id"))
    fast = exact_running_sum(d, "_key", "n_chars", out="c")
    slow = d.withColumn("c2", F.sum("n_chars").over(W.orderBy("_key").rowsBetween(W.unboundedPreceding, 0)))
    j = fast.join(slow.select("doc_id", "c2"), "doc_id")
    assert j.where(F.col("c") != F.col("c2")).count() == 0


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [int(x) for x in np.random.default_rng(1).integers(0, 500, 3001)]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.99, 1.0])
    exp = np.quantile(np.array(vals, dtype=float), [0.0, 0.25, 0.5, 0.99, 1.0])
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


def test_split_partitions_input_with_quotas(spark):
    from corpuslab.operators.filters import viable_filter
    c = cases(spark, SF)
    v = c.select("identifier", "class")
    s = smp.stratified_split(v)
    assert s.count() == v.count() and s.select("identifier").distinct().count() == v.count()
    sizes = smp.class_sizes(v)
    q = {r["class"]: r for r in smp.split_quotas(sizes).collect()}
    got = {(r["class"], r["split"]): r["count"] for r in s.groupBy("class", "split").count().collect()}
    for cls, r in q.items():
        for sp in ("train", "validation", "test"):
            assert got.get((cls, sp), 0) == r[sp]
        n = r["n"]
        assert abs(r["train"] - n * 0.7) <= 1 + n * 0.001


def test_sample_per_class_sizes(spark):
    c = cases(spark, SF).select("identifier", "class")
    got = {r["class"]: r["count"] for r in smp.sample_per_class(c, 0.004).groupBy("class").count().collect()}
    sizes = {r["class"]: r["n"] for r in smp.class_sizes(c).collect()}
    for cls, n in sizes.items():
        assert got.get(cls, 0) == round(n * 0.004)


def test_null_classes_and_keys_keep_their_rows(spark):
    from corpuslab.operators.sampling import shuffle
    df = spark.createDataFrame([(None if i % 5 == 0 else f"id{i}", i) for i in range(100)], "identifier string, n int")
    assert shuffle(df, "identifier").count() == 100


def test_csv_text_round_trip(spark, tmp_path):
    from corpuslab.sinks.writers import csv_write
    from corpuslab.sources.tables import csv_scan
    rows = [("a", 'two\nlines, "quoted"'), ("b", "plain"), ("c", None), ("d", None)]  # CSV does not tell empty from null
    csv_write(spark.createDataFrame(rows[:3] + [("d", "")], "id string, t string"), str(tmp_path / "c"))
    assert sorted((r.id, r.t) for r in csv_scan(spark, str(tmp_path / "c"), "id string, t string").collect()) == rows


def test_ranges_are_even_whatever_the_keys(spark):
    from corpuslab.operators.ranking import by_ranges, ordered_sum
    far = spark.range(20000).select(F.when(F.col("id") == 7, F.lit(1 << 62)).otherwise(F.col("id")).alias("x"))
    rare = spark.range(20000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id")).alias("df"), F.concat(F.lit("enone"), F.col("id")).alias("token"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # the rows are few here
    for df, order in ((far, [F.col("x")]), (rare, [F.col("df").desc(), F.col("token")])):
        n = [r["count"] for r in by_ranges(df, order).groupBy("_part").count().collect()]
        assert len(n) > 4 and max(n) <= 2 * sum(n) / len(n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = ordered_sum(far, [F.col("x")], F.col("x") % 10, "s")
    want = far.withColumn("w", F.sum(F.col("x") % 10).over(W.orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    assert got.join(want, "x").where("s <> w").count() == 0
    assert exact_quantiles(far, "x", [0.0, 0.5, 1.0]) == [0.0, 10000.5, float(1 << 62)]
    assert ordered_sum(far.where("x < 0"), [F.col("x")], F.col("x"), "s").count() == 0

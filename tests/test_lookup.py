"""Token lookups give the same rows whether the table is broadcast or split by hot tokens; plans deal rows once for exact ranks."""
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import joins as jn
from corpuslab.operators.ranking import exact_rank, exact_running_sum, seeded_key


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup(spark, how):
    tokens = spark.range(6000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 7 == 0, F.lit(None))
                                      .otherwise(F.concat(F.lit("w"), (F.col("id") % 501).cast("string"))).alias("token"))
    table = spark.range(400).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token"), F.col("id").alias("term_id")) \
        .unionByName(spark.createDataFrame([("the", 9999)], "token string, term_id long"))
    small = jn.lookup(tokens, table, how)
    split = jn.lookup(tokens, table, how, most_bytes=0)
    assert small.columns == split.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, split.collect()))
    plain = tokens.join(table.hint("merge"), "token", how)
    assert sorted(map(str, plain.select(small.columns).collect())) == sorted(map(str, small.collect()))
    assert jn.lookup(tokens.where("doc < 0"), table, how, most_bytes=0).count() == 0


def test_exact_ranks_deal_the_rows_once(spark):
    d = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("class"), F.repeat(F.lit("text"), 50).alias("text"))
    d = d.withColumn("_key", seeded_key("id"))
    for out in (exact_rank(d, "_key", parts=["class"], out="r"), exact_running_sum(d, "_key", "id", out="r")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "\n".join(plan.split("Initial Plan")[:1]).count("Exchange hashpartitioning(_group") <= 2      # the rows, and the small table
    ranked = exact_rank(d, "_key", parts=["class"], out="r")
    assert ranked.where("class is null").agg(F.max("r"), F.count("*")).first() == (200, 200)


def test_total_variance_keeps_its_digits(spark):
    from corpuslab.operators import cluster as cl
    x = cl.array_features(spark.createDataFrame([([1e9 + i, float(i % 2)],) for i in range(10)], "a array<double>"), "a")
    assert abs(cl.total_variance(x) - (82.5 + 2.5)) < 1e-6
    assert cl.total_variance(x.limit(0)) == 0.0

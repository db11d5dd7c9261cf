"""Golden numbers restated from the reference's published results."""
from pyspark.sql import functions as F

from corpuslab.operators import aggregates as agg
from corpuslab.operators import sampling as smp

CLASS_SIZES = [23584, 13504, 19156, 6669, 15413, 21875]
TRAIN = [16509, 9453, 13409, 4668, 10789, 15312]
VAL = [4740, 2714, 3850, 1341, 3098, 4397]
TEST = [2335, 1337, 1897, 660, 1526, 2166]


def test_split_quotas_match_published_sizes(spark):
    counts = spark.createDataFrame([(str(c), n) for c, n in enumerate(CLASS_SIZES)], "class string, n long")
    q = {r["class"]: r for r in smp.split_quotas(counts).collect()}
    assert [q[str(c)]["train"] for c in range(6)] == TRAIN
    assert [q[str(c)]["validation"] for c in range(6)] == VAL
    assert [q[str(c)]["test"] for c in range(6)] == TEST
    assert sum(TRAIN) == 70140 and sum(VAL) == 20140 and sum(TEST) == 9921


def test_eval_sample_quota(spark):
    df = spark.createDataFrame([(str(c), n) for c, n in enumerate(TEST)], "class string, n long")
    got = [r[0] for r in df.select(F.bround(F.col("n") * 0.004, 0).cast("int")).collect()]
    assert got == [9, 5, 8, 3, 6, 9] and sum(got) == 40


def test_weighted_combine_of_published_scores(spark):
    scores = spark.createDataFrame(
        [(0, 39.74, 26.41, 37.73), (1, 46.74, 35.42, 45.60), (2, 43.82, 31.20, 41.98),
         (3, 52.57, 43.15, 52.15), (4, 46.56, 34.35, 44.84), (5, 41.21, 28.13, 39.26)],
        "class int, r1 double, r2 double, rl double")
    sizes = spark.createDataFrame(list(enumerate(CLASS_SIZES)), "class int, size long")
    r = agg.weighted_combine(scores, sizes, "class", ["r1", "r2", "rl"]).first()
    assert (r["r1"], r["r2"], r["rl"]) == (43.69, 31.25, 41.99)


def test_best_checkpoint_hand_curve(spark):
    c = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.3), ("a", 3, 0.3), ("a", 4, 0.4), ("b", 1, 2.0)],
                              "run string, epoch int, loss double")
    got = {r["run"]: (r["best_step"], r["best_value"]) for r in agg.best_checkpoint(c).collect()}
    assert got == {"a": (2, 0.3), "b": (1, 2.0)}


def test_decade_identity_and_zero_fill(spark):
    from corpuslab.sources.fixtures import cases
    rows = agg.decade_rollup(cases(spark, "/root/testdata/sf0.01")).collect()
    assert [r["decade"] for r in rows] == list(range(1910, 2021, 10)) or sorted(r["decade"] for r in rows) == list(range(1910, 2021, 10))
    for r in rows:
        assert r["viable_cases"] == r["complete_cases"] - r["oneword_summaries"] - r["short_summaries"]
    assert sum(r["cases"] for r in rows) == 1000

import pytest
from pyspark.sql import functions as F

from lexmill.operators.eager import eager_join_aggregate


def both(spark, left, right, how):
    l = spark.createDataFrame(left, "k string, g string, v long, w string")
    r = spark.createDataFrame(right, "k string, x long, g string")
    got = eager_join_aggregate(l, r, "k", {"g": F.col("g")}, {"v": F.col("v")}, {"x": F.col("x")}, how)
    plain = l.join(r.select(F.col("k"), F.col("x"), F.lit(1).alias("m")), "k", how).groupBy("g").agg(F.count(F.lit(1)).alias("n_joined"), F.sum("v").alias("v"), F.sum("x").alias("x"))
    key = lambda t: tuple((v is not None, v) for v in t)
    return sorted(((r["g"], r["n_joined"], r["v"], r["x"]) for r in got.collect()), key=key), sorted(((r["g"], r["n_joined"], r["v"], r["x"]) for r in plain.collect()), key=key)


LEFT = [("a", "g1", 1, "z"), ("a", "g1", 2, None), ("a", None, 3, "z"), ("b", "g2", None, "z"), (None, "g1", 5, "z"), (None, None, 7, None), ("c", "g2", 4, "z"), ("a", "g1", 1, "z")]
RIGHT = [("a", 10, "q"), ("a", None, "q"), ("b", 3, None), (None, 9, "q"), ("d", 1, "q"), ("a", 10, "q")]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("left", "right"), [(LEFT, RIGHT), (LEFT, []), ([], RIGHT), ([], [])])
def test_like_the_plain_join(spark, how, left, right):
    got, want = both(spark, left, right, how)
    assert got == want


def test_rows_of_the_left_side_count_once(spark):
    l = spark.createDataFrame(LEFT, "k string, g string, v long, w string")
    r = spark.createDataFrame(RIGHT, "k string, x long, g string")
    got = {x["g"]: x["n_left"] for x in eager_join_aggregate(l, r, "k", {"g": F.col("g")}, how="left").collect()}
    assert got == {"g1": 4, "g2": 2, None: 2}
    with pytest.raises(ValueError):
        eager_join_aggregate(l, r, "k", {"g": F.col("g")}, {"g": F.col("v")})
    with pytest.raises(ValueError):
        eager_join_aggregate(l, r, "k", {"g": F.col("g")}, how="right")


def test_a_hot_key_moves_as_one_row_per_task(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit("g").alias("g"))
    right = spark.range(1).select(F.lit("hot").alias("k"), F.lit(2).alias("x"))
    got = eager_join_aggregate(rows, right, "k", {"g": F.col("g")}, right_sums={"x": F.col("x")})
    assert got.collect()[0]["x"] == 40_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 2

import random

from pyspark.sql import functions as F

from rootstock.operators.eager import compact, eager_join, heavy_keys, over_join, roll_up


def test_same_as_the_join_itself(spark):
    r = random.Random(2)
    key = lambda: r.choice(["hot"] * 5 + [None, "a", "b", "c", "d"])
    left = spark.createDataFrame([(key(), r.choice([None, float("nan"), float(r.randrange(9))])) for _ in range(300)], "k string, x double")
    right = spark.createDataFrame([(key(), r.randrange(9)) for _ in range(200)], "k string, y bigint")
    s = eager_join(compact(left, {"k": F.col("k")}, {"x": F.col("x")}, "l"), compact(right, {"k": F.col("k")}, {"y": F.col("y")}, "r"), ["k"])
    got = {x.k: (x.pairs, x.sx, x.sy, x.l_max_x) for x in s.select("k", "pairs", over_join("l", "r", "x").alias("sx"), over_join("r", "l", "y").alias("sy"), "l_max_x").where("pairs > 0").collect()}
    clean = left.withColumn("x", F.nanvl("x", F.lit(None)))
    want = {x.k: (x.n, x.sx, x.sy, x.mx) for x in clean.join(right, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("x").alias("mx")).collect()}
    assert got == want
    total = roll_up(s.where("k is not null"), [F.lit(1).alias("one")], {"pairs": F.sum("pairs")}).first().pairs
    assert total == sum(w[0] for w in want.values())
    n = lambda df: df.agg(F.count(F.lit(1)))
    assert sorted(map(tuple, heavy_keys(s, "k", {"left": ("l_n", n(left)), "right": ("r_n", n(right))}, 0.3).collect())) == [("left", "hot"), ("right", "hot")]


def test_empty_sides_and_missing_keys(spark):
    left = spark.createDataFrame([("a", 1.0)], "k string, x double")
    none = spark.createDataFrame([], "k string, y bigint")
    s = eager_join(compact(left, {"k": F.col("k")}, {"x": F.col("x")}, "l"), compact(none, {"k": F.col("k")}, {"y": F.col("y")}, "r"), ["k"]).collect()
    assert [(x.k, x.l_n, x.r_n, x.pairs, x.r_sum_y) for x in s] == [("a", 1, 0, 0, None)]

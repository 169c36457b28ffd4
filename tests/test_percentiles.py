import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootstock.operators.percentiles import combine, grouped_percentiles, percentile_state, percentiles

P = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "top": 1.0}


def made(seed=1, n=3000):
    r = random.Random(seed)
    value = lambda: r.choice([None, math.nan, -0.0, 0.0, 1.5, r.gauss(0, 100), float(r.randrange(5))])
    return [(r.choice(["hot", "hot", "hot", None, *"abcdef"]), value()) for _ in range(n)] + [("none", None), ("one", 4.0)]


def test_exact_over_several_partitions_and_from_combined_parts(spark):
    rows = made()
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {x[0] for x in rows if x[0]}:
        held = [x[1] for x in rows if x[0] == g and x[1] is not None and not math.isnan(x[1])]
        want[g] = (len(held), sum(x[0] == g for x in rows) - len(held), *[float(np.quantile(held, p)) if held else None for p in P.values()])
    key = {"g": F.col("g")}
    state = percentile_state(df, key, F.col("v"))
    parts = combine(percentile_state(df.where("v > 1"), key, F.col("v")), percentile_state(df.where("v <= 1 or v is null"), key, F.col("v")), percentile_state(df.limit(0), key, F.col("v")))
    for got in (percentiles(state, P, 7), percentiles(state, P), percentiles(parts, P, 3)):
        rows_of = {r.g: (r.n, r.n_missing, *[r[k] for k in P]) for r in got.collect()}
        assert set(rows_of) == set(want)
        for g, w in want.items():
            assert rows_of[g][:2] == w[:2]
            assert rows_of[g][2:] == (pytest.approx(w[2:]) if w[0] else w[2:])


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert grouped_percentiles(df, ["g"], "v", P).count() == 0
    with pytest.raises(ValueError, match="clash"):
        percentiles(percentile_state(df, {"mid": F.col("g")}, F.col("v")), P)


def test_infinite_values_float_groups_and_several_group_columns(spark):
    inf, nan = math.inf, math.nan
    rows = [(nan, "x", -inf), (nan, "x", 1.0), (0.0, "x", 2.0), (-0.0, "x", inf), (0.0, "y", -inf), (0.0, "y", inf), (2.0, "z", None)]
    df = spark.createDataFrame(rows, "a double, b string, v double")
    for partitions in (1, 5):
        got = {(str(r.a), r.b): (r.n, r.n_missing, r.q) for r in percentiles(percentile_state(df, {"a": F.col("a"), "b": F.col("b")}, F.col("v")), {"q": 0.25}, partitions).collect()}
        assert got == {("0.0", "x"): (2, 0, inf), ("0.0", "y"): (2, 0, -inf), ("2.0", "z"): (0, 1, None)}


def test_one_group_in_every_partition_and_few_exchanges(spark):
    df = spark.range(10_000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 7 as string)) as g", "cast(id * 37 % 9973 as double) as v")
    out = percentiles(percentile_state(df, {"g": F.col("g")}, F.col("v")), P, 40)
    got = {r.g: r for r in out.collect()}
    pd_ = df.toPandas()
    for g, v in pd_.groupby("g").v:
        assert [got[g][k] for k in P] == pytest.approx([float(np.quantile(v, p)) for p in P.values()]) and got[g].n == len(v)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2

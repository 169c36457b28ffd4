"""Bit-sliced feature tables against plain counting."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rootstock.functions import bitmaps
from rootstock.operators.entity_features import as_columns, as_rows, entity_features

EVENTS = "eid bigint, user bigint, kind string, at timestamp_ntz, value double"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=200), st.lists(st.integers(0, 2**40), min_size=1, max_size=200))
def test_carry_addition_adds(a, b):
    size = max(len(a), len(b))
    x, y = np.zeros(size, np.int64), np.zeros(size, np.int64)
    x[: len(a)], y[: len(b)] = a, b
    of = lambda v: bitmaps.slices(np.flatnonzero(v), v[v > 0], size)
    total = bitmaps.add(of(x), of(y))
    assert (bitmaps.numbers(total, size) == x + y).all()
    again, end = bitmaps.load(memoryview(data := bitmaps.dump(total)), 0)
    assert end == len(data) and (bitmaps.numbers(again, size) == x + y).all()


def made(n=1500, seed=3):
    r = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    value = lambda: r.choice([None, math.nan, math.inf, 57_150_000.0, -3.25, 1e16, round(r.uniform(-50, 50), 2), round(r.uniform(0, 9), 2)])
    rows = [(k, r.choice([1, 1, 1, 1, None, *range(40)]), r.choice([None, "a", "b", "c", "d"]), r.choice([None, t0 + timedelta(seconds=r.randrange(10**6))]), value()) for k in range(n)]
    return rows + rows[: n // 4]


def expected(rows):
    out = defaultdict(lambda: [0, None, 0.0])
    for _, user, kind, at, value in set(map(str, rows)) and {repr(x): x for x in rows}.values():
        if user is None or kind is None:
            continue
        c = out[user, kind]
        c[0] += 1
        c[1] = at if c[1] is None else max(c[1], at) if at else c[1]
        c[2] += value if value is not None and math.isfinite(value) else 0
    return out


@pytest.mark.parametrize("group", [30, 100_000])
def test_same_as_counting_with_and_without_hot_blocks(spark, group):
    rows = made()
    types = ["a", "b", "c", "d"]
    got = entity_features(spark.createDataFrame(rows, EVENTS), entity="user", time="at", value="value", kind=F.col("kind"), types=types, rows_per_group=group)
    long = {(r.user, r.event_type): r for r in as_rows(got, types, "user").collect()}
    want = expected(rows)
    assert set(long) == set(want)
    for k, (n, last, total) in want.items():
        assert (long[k].n, long[k].latest) == (n, last)
        assert long[k].total == pytest.approx(total, rel=1e-12, abs=1e-6)
    assert {r.user for r in got.collect()} == {x[1] for x in rows if x[1] is not None}
    wide = as_columns(got, types, "user").collect()
    assert {(r.user, "a"): r["n_a"] for r in wide if r["n_a"]} == {k: v[0] for k, v in want.items() if k[1] == "a"}


def test_empty_and_text_keys(spark):
    empty = spark.createDataFrame([], EVENTS)
    assert entity_features(empty, entity="user", time="at", value="value", kind=F.col("kind")).count() == 0
    rows = spark.createDataFrame([("x", "a", None, 1.0), ("x", None, None, 1.0), ("y", None, None, None)], "u string, kind string, at timestamp_ntz, v double")
    rows = rows.selectExpr("*", "1 as __block", "2 as __salt", "3 as n")
    got = {r.u: r.counts for r in entity_features(rows, entity="u", time="at", value="v", kind=F.col("kind")).collect()}
    assert got == {"x": [1], "y": [0]}


def test_many_states_are_added_in_rounds(spark):
    """One user with all rows: 60 states, added eight at a time; entities of other types."""
    rows = [(k, 1, "ab"[k % 2], datetime(2024, 1, 1) + timedelta(seconds=k), 0.25 * k) for k in range(3000)]
    df = spark.createDataFrame(rows, EVENTS)
    for entity in ("user", "cast(user as date)", "cast(user as decimal(9,2))", "cast(user as timestamp)", "cast(user as smallint)", "cast(user as double)"):
        if "date" in entity:
            entity = "date_add(date'2024-01-01', cast(user as int))"
        got = entity_features(df.selectExpr("eid", f"{entity} as user", "kind", "at", "value"), entity="user", time="at", value="value", kind=F.col("kind"), rows_per_group=50).collect()
        assert [(r.counts, r.latest[1], r.totals) for r in got] == [([1500, 1500], rows[-1][3], [0.25 * sum(range(0, 3000, 2)), 0.25 * sum(range(1, 3000, 2))])]
    with pytest.raises(ValueError, match="entities"):
        entity_features(df.selectExpr("eid", "array(user) as user", "kind", "at", "value"), entity="user", time="at", value="value", kind=F.col("kind"))

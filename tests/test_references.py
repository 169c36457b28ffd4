import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rootstock.functions import bloom
from rootstock.functions.skew import join_counted
from rootstock.operators.references import Child, Link, Parent, links_of, orphans, report

T0 = datetime(2024, 1, 1)
LINKS = [Link("child", "ref", "parent", "id"), Link("child", "other", "absent", "id")]


def made(seed=5):
    r = random.Random(seed)
    hour = lambda: T0 + timedelta(hours=r.randrange(200))
    parents = [(k, r.choice([None, hour()]), r.choice([None, hour()])) for k in range(0, 60, 2)]
    spell = lambda k: r.choice([f"{k}", f" {k}.0", f"0{k}", f"+{k}"])
    children = [(k, r.choice([None, "nan", "", spell(0), spell(0), spell(r.randrange(80)), "x1"]), r.choice([None, hour()])) for k in range(600)]
    return parents, children


def brute(parents, children):
    lives, out = {k: (b, d) for k, b, d in parents}, {}
    for row, ref, at in children:
        if ref is None or ref.strip() in ("", "nan"):
            continue
        key = int(float(ref)) if ref != "x1" else ref
        if key not in lives:
            out[row] = "missing"
        elif at is not None and lives[key][0] is not None and lives[key][0] >= at:
            out[row] = "late"
        elif at is not None and lives[key][1] is not None and lives[key][1] <= at:
            out[row] = "deleted"
    return out


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_same_as_brute_force_with_and_without_broadcast(spark, limit):
    parents, children = made()
    p = spark.createDataFrame(parents, "id bigint, born timestamp_ntz, died timestamp_ntz")
    c = spark.createDataFrame(children, "row bigint, ref string, at timestamp_ntz").withColumn("other", F.lit("1"))
    got = orphans(LINKS, {"child": Child(c, "row", F.col("at"))}, {"parent": Parent(p, "born", "died")}, limit)
    assert {r.row_id: r.kind for r in got.collect()} == brute(parents, children)
    assert sum(r.n_rows for r in report(got).collect()) == len(brute(parents, children))
    untimed = orphans(LINKS, {"child": Child(c, "row")}, {"parent": Parent(p)}, limit)
    assert {r.kind for r in untimed.collect()} == {"missing"}


def test_empty_sides_and_links(spark):
    p = spark.createDataFrame([], "id bigint")
    c = spark.createDataFrame([(1, "5"), (2, None)], "row bigint, ref string")
    assert [r.row_id for r in orphans(LINKS[:1], {"child": Child(c, "row")}, {"parent": Parent(p)}).collect()] == [1]
    assert orphans(LINKS[:1], {"child": Child(c.limit(0), "row")}, {"parent": Parent(p)}).count() == 0
    with pytest.raises(ValueError, match="no link"):
        orphans(LINKS, {}, {})
    schema = spark.createDataFrame([("child", "ref", "parent.id"), ("child", "x", None)], "table_name string, column_name string, link_to string")
    assert links_of(schema) == LINKS[:1]


def test_bloom_filter_never_loses_a_key(spark):
    keys = spark.range(5000).select((F.col("id") * 7).cast("string").alias("k"))
    f = bloom.build(keys, ["k"], 5000)
    words, bits = f.frame, f.bits
    probe = spark.range(35000).select(F.col("id"), bloom.might_contain([F.col("id").cast("string")], words.scalar(), bits).alias("maybe"))
    rows = probe.collect()
    assert all(r.maybe for r in rows if r.id % 7 == 0)
    assert sum(r.maybe for r in rows if r.id % 7) < 0.03 * 30000


def test_counted_join_keeps_heavy_and_null_keys(spark):
    big = spark.createDataFrame([(k, None if k % 10 == 0 else 1 if k % 2 else k) for k in range(1000)], "row bigint, k bigint")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 500)], "k bigint, v string")
    want = sorted(((r.row, r.v) for r in big.join(small, "k", "left").collect()), key=str)
    got = sorted(((r.row, r.v) for r in join_counted(big, small, ["k"], 500, "left", max_rows=10, hot=0.1).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_same_as_brute_force_with_a_filter_that_is_met_by_a_join(spark, limit):
    parents, children = made(8)
    p = spark.createDataFrame(parents, "id bigint, born timestamp_ntz, died timestamp_ntz")
    c = spark.createDataFrame(children, "row bigint, ref string, at timestamp_ntz").withColumn("other", F.lit("1"))
    got = orphans(LINKS, {"child": Child(c, "row", F.col("at"))}, {"parent": Parent(p, "born", "died")}, limit, filter_bits=64)
    assert {r.row_id: r.kind for r in got.collect()} == brute(parents, children)


def test_filters_stay_selective_beyond_the_bound(spark):
    """Ten times as many keys as fit in the bits that may be broadcast: all are held, and hardly any others."""
    keys = spark.range(40_000).selectExpr("cast(id as string) as key", "1 as p")
    f = bloom.build(keys, ["p", "key"], 40_000, max_bits=1 << 15)
    assert f.blocks > 1 and f.bits >= 10 * 40_000
    held = f.mark(keys, ["p", "key"], "m").agg(F.count_if("m")).first()[0]
    others = f.mark(spark.range(50_000, 90_000).selectExpr("cast(id as string) as key", "1 as p"), ["p", "key"], "m").agg(F.count_if("m")).first()[0]
    assert held == 40_000 and others < 0.02 * 40_000

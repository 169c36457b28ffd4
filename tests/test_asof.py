"""Attributes as known at event time, against a look at every version."""

import random
from datetime import datetime, timedelta

import pytest

from rootstock.operators.asof import as_known_at

T0 = datetime(2024, 1, 1)
VERSIONS = "vid bigint, user bigint, valid_from timestamp_ntz, recorded_at timestamp_ntz, plan string"
PROBES = "pid bigint, user bigint, at timestamp_ntz, plan string"


def brute(probes, versions):
    out = {}
    for pid, user, at, _ in probes:
        held = [v for v in versions if user is not None and at is not None and v[1] == user and v[2] is not None and v[3] is not None and v[2] < at and v[3] < at]
        best = max(held, key=lambda v: (v[2], v[3], v[0]), default=None)
        out[pid] = best and (best[0], best[4])
    return out


def made(seed, users=4, versions=150, probes=150):
    r = random.Random(seed)
    hour = lambda: T0 + timedelta(hours=r.randrange(60))
    pick = lambda x: None if r.random() < 0.05 else x
    user = lambda: pick(1 if r.random() < 0.5 else r.randrange(users))
    vs = [(k, user(), pick(hour()), pick(hour()), r.choice("abc")) for k in range(versions)]
    return [(k, user(), pick(hour()), "own") for k in range(probes)], vs + vs[:20]


@pytest.mark.parametrize("shard", [5, 40, 10_000])
def test_same_as_brute_force_at_every_shard_size(spark, shard):
    probes, versions = made(shard)
    got = as_known_at(spark.createDataFrame(probes, PROBES), spark.createDataFrame(versions, VERSIONS), key="user", time="at", known=["valid_from", "recorded_at"], tie=["vid"], attributes=["plan"], rows_per_shard=shard)
    rows = got.collect()
    assert got.columns[:4] == ["pid", "user", "at", "plan"] and len(rows) == len(probes)
    assert {r.pid: (r.as_known_vid, r.as_known_plan) if r.as_known_vid is not None else None for r in rows} == brute(probes, versions)


def test_repeated_probes_stay_and_ties_at_the_cutoff_are_excluded(spark):
    versions = [(1, 7, T0, T0, "x")]
    probes = [(1, 7, T0, ""), (2, 7, T0 + timedelta(microseconds=1), ""), (2, 7, T0 + timedelta(microseconds=1), "")]
    rows = as_known_at(spark.createDataFrame(probes, PROBES), spark.createDataFrame(versions, VERSIONS), key="user", time="at", known=["valid_from", "recorded_at"], tie=["vid"]).collect()
    assert sorted((r.pid, r.as_known_vid) for r in rows if r.pid == 2) == [(2, 1), (2, 1)]
    assert [r.as_known_vid for r in rows if r.pid == 1] == [None]


def test_empty_tables_and_clashing_names(spark):
    p, v = spark.createDataFrame([(1, 7, T0, "")], PROBES), spark.createDataFrame([], VERSIONS)
    known = dict(key="user", time="at", known=["valid_from"], tie=["vid"])
    assert as_known_at(p, v, **known).collect()[0].as_known_vid is None
    assert as_known_at(p.limit(0), v, **known).count() == 0
    with pytest.raises(ValueError, match="prefix"):
        as_known_at(p.withColumnRenamed("plan", "as_known_vid"), v, **known)

"""Feature computation: hand-made boundaries, differential and metamorphic tests, and a naive evaluator."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import rootstock as rs
from rootstock.functions.primitives import NUMERIC

T0 = datetime(2023, 1, 1)
U, I = "user-probe", "item-probe"


def visits():
    """One user and one item with fourteen visits each at known times, among others."""
    r = random.Random(0)
    s = timedelta(seconds=1)
    rows = [(U, f"i{k}", T0) for k in range(4)] + [(U, f"i{k}", T0 + 60 * s) for k in range(10)]
    rows += [("u0", I, T0)] + [(f"u{k}", I, T0 + (31 + 60 * k) * s) for k in range(6)] + [(f"u{k}", I, T0 + (451 + 300 * k) * s) for k in range(6)] + [("u9", I, T0 + 4500 * s)]
    rows += [(f"u{r.randrange(20)}", f"i{r.randrange(20)}", T0 + r.randrange(5000) * s) for _ in range(300)]
    users, items = [U, *[f"u{k}" for k in range(20)]], [I, *[f"i{k}" for k in range(20)]]
    tables = {
        "user": pd.DataFrame({"user_id": users, "user_feature_0": [r.random() for _ in users]}),
        "item": pd.DataFrame({"item_id": items, "item_feature_0": [r.random() for _ in items]}),
        "interaction": pd.DataFrame(rows, columns=["user_id", "item_id", "timestamp"]),
    }
    return rs.create_rdb(tables, "v", {"user": "user_id", "item": "item_id"}, [("interaction", "user_id", "user", "user_id"), ("interaction", "item_id", "item", "item_id")], {"interaction": "timestamp"})


KEYS = {"user_id": "user.user_id", "item_id": "item.item_id"}


@pytest.mark.parametrize("engine", ["range", "window"])
def test_cutoff_boundaries(spark, engine):
    cases = [(timedelta(hours=-1), 0, 0), (timedelta(0), 0, 0), (timedelta(seconds=30), 4, 1), (timedelta(seconds=450), 14, 7), (timedelta(seconds=2610), 14, 13), (timedelta(hours=2), 14, 14)]
    target = pd.DataFrame([(k, U, I, T0 + d) for k, (d, _, _) in enumerate(cases)], columns=["k", "user_id", "item_id", "at"])
    out = rs.compute_features(visits(), target, KEYS, "at", config_overrides={"agg_primitives": ["count"], "engine": engine}).collect()
    assert {r.k: (r["user.COUNT(interaction)"], r["item.COUNT(interaction)"]) for r in out} == {k: (u, i) for k, (_, u, i) in enumerate(cases)}


def test_exact_columns_by_depth(spark):
    target = pd.DataFrame({"user_id": [U, "u1"], "item_id": ["i1", I]})
    names = lambda d, *p: set(rs.plan_features(visits(), KEYS, rs.FeatureConfig(agg_primitives=p, max_depth=d)))
    one = {"user.user_feature_0", "item.item_feature_0"}
    two = one | {"user.COUNT(interaction)", "item.COUNT(interaction)"}
    assert names(0, "count") == set() and names(1, "count") == one and names(2, "count", "mean", "max", "mode") == two
    assert names(3, "count", "mean", "quantile_25") == two | {f"user.{p}(interaction.item.item_feature_0)" for p in ("MEAN", "QUANTILE_25")} | {f"item.{p}(interaction.user.user_feature_0)" for p in ("MEAN", "QUANTILE_25")}
    assert rs.compute_features(visits(), target, KEYS, config_overrides={"max_depth": 0}).columns == ["user_id", "item_id"]
    assert len(rs.plan_features(visits(), KEYS, rs.FeatureConfig(max_features=1))) == 1
    assert names(3, "count") > set(rs.plan_features(visits(), KEYS, rs.FeatureConfig(agg_primitives=["count"], ignore_entities=["interaction"])))
    assert set(rs.plan_features(visits(), KEYS, rs.FeatureConfig(agg_primitives=["count"], include_entities=["user"]))) == {"user.user_feature_0"}


def test_target_columns_of_any_type_stay(spark):
    target = spark.createDataFrame([(U, [1, 2], {"a": 1}, (1, "x"))], "user_id string, l array<int>, m map<string,int>, s struct<a:int,b:string>")
    row = rs.compute_features(visits(), target, {"user_id": "user.user_id"}).first()
    assert (row.l, row.m, row.s.b, row["user.COUNT(interaction)"]) == ([1, 2], {"a": 1}, "x", 14)


def test_target_history(spark):
    day = lambda k: datetime(2020, 1, k)
    r = rs.create_rdb({"user": pd.DataFrame({"user_id": [1, 2, 3], "age": [1, 2, 3]})}, primary_keys={"user": "user_id"})
    r = r.add_table(pd.DataFrame({"user_id": [1, 1, 2, 3], "timestamp": [day(1), day(2), day(3), day(4)], "amount": [10.0, 20.0, 30.0, 40.0]}), "history", "timestamp", None, [("user_id", "user", "user_id")])
    target = pd.DataFrame({"user_id": [1, 2, 3], "at": [day(5), day(5), day(1)]})
    for engine in ("range", "window"):
        out = rs.compute_features(r, target, {"user_id": "user.user_id"}, "at", config_overrides={"agg_primitives": ["mean"], "engine": engine})
        assert {x.user_id: x["user.MEAN(history.amount)"] for x in out.collect()} == {1: 15.0, 2: 30.0, 3: None}


def test_bad_calls(spark):
    r, target = visits(), pd.DataFrame({"user_id": [U], "x": [1]})
    for mapping, text in [({"nope": "user.user_id"}, "nope"), ({"user_id": "nope.user_id"}, "nope"), ({"user_id": "user.user_feature_0"}, "primary key"), ({"user_id": "user"}, "primary_key"), ({}, "mappings")]:
        with pytest.raises(ValueError, match=text):
            rs.compute_features(r, target, mapping)
    good = {"user_id": "user.user_id"}
    with pytest.raises(ValueError, match="cutoff"):
        rs.compute_features(r, target, good, "nope")
    with pytest.raises(ValueError, match="not a timestamp"):
        rs.compute_features(r, target, good, "x")
    with pytest.raises(ValueError, match="unknown settings"):
        rs.compute_features(r, target, good, config_overrides={"depth": 3})
    with pytest.raises(ValueError, match="unknown engine"):
        rs.compute_features(r, target, good, config_overrides={"engine": "none"})
    with pytest.raises(ValueError, match="unknown primitive"):
        rs.compute_features(r, target, good, config_overrides={"agg_primitives": ["nothing"]})
    with pytest.raises(ValueError, match="reserved"):
        rs.compute_features(r, target.assign(__target__=1), good)
    doubled = r.update_table("user", r.get_table("user").unionByName(r.get_table("user")), r.get_table_metadata("user"))
    with pytest.raises(ValueError, match="repeats"):
        rs.compute_features(doubled, target, good, config_overrides={"check_unique_keys": True})


def test_null_keys_strings_and_cutoffs(spark):
    target = spark.createDataFrame([(1, U, "2023-01-01 00:00:30"), (2, None, "2023-01-01 00:00:30"), (3, "nobody", "2023-01-01 00:00:30"), (4, U, None)], "k int, user_id string, at string")
    out = rs.compute_features(visits(), target, {"user_id": "user.user_id"}, "at", config_overrides={"agg_primitives": ["count"]}).collect()
    assert {r.k: r["user.COUNT(interaction)"] for r in out} == {1: 4, 2: 0, 3: 0, 4: 0}
    assert rs.compute_features(visits(), target.limit(0), {"user_id": "user.user_id"}, "at").count() == 0
    bad = spark.createDataFrame([(U, "whenever")], "user_id string, at string")
    with pytest.raises(Exception, match="no timestamp"):
        rs.compute_features(visits(), bad, {"user_id": "user.user_id"}, "at").collect()


def test_integer_key_that_became_float(spark):
    r = rs.create_rdb({"u": pd.DataFrame({"id": [1, 2], "x": [5.0, 6.0]})}, primary_keys={"u": "id"})
    target = pd.DataFrame({"id": [1.0, None, 2.0]})
    out = rs.compute_features(r, target, {"id": "u.id"}, config_overrides={"max_depth": 1}).collect()
    assert sorted(((x.id, x["u.x"]) for x in out), key=str) == [(1.0, 5.0), (2.0, 6.0), (None, None)]
    assert target["id"].dtype == float


def test_two_keys_into_one_table_and_two_links_to_one_parent(spark):
    people = pd.DataFrame({"id": ["a", "b"], "age": [1.0, 2.0]})
    calls = pd.DataFrame({"src": ["a", "a", "b"], "dst": ["b", "b", "a"]})
    r = rs.create_rdb({"p": people, "call": calls}, primary_keys={"p": "id"}, foreign_keys=[("call", "src", "p", "id"), ("call", "dst", "p", "id")])
    target = pd.DataFrame({"x": ["a"], "y": ["b"]})
    row = rs.compute_features(r, target, {"x": "p.id", "y": "p.id"}, config_overrides={"agg_primitives": ["count"]}).first().asDict()
    assert row == {"x": "a", "y": "b", "p[x].age": 1.0, "p[x].COUNT(call[src])": 2, "p[x].COUNT(call[dst])": 1, "p[y].age": 2.0, "p[y].COUNT(call[src])": 1, "p[y].COUNT(call[dst])": 2}


def test_self_links_are_skipped_and_own_primitives_work(spark):
    r = rs.create_rdb({"t": pd.DataFrame({"id": [1, 2], "boss": [1, 1], "x": [1.0, 4.0]}), "c": pd.DataFrame({"t": [1, 1], "v": [2.0, 6.0]})}, primary_keys={"t": "id"}, foreign_keys=[("t", "boss", "t", "id"), ("c", "t", "t", "id")])
    p = rs.register_primitive("span", NUMERIC, NUMERIC, lambda c, t: F.max(c) - F.min(c))
    row = rs.compute_features(r, pd.DataFrame({"id": [1]}), {"id": "t.id"}, config_overrides={"agg_primitives": ["span", p]}).first()
    assert row["t.SPAN(c.v)"] == 4.0 and not any("boss" in n for n in row.asDict())


def test_arrays_element_by_element(spark):
    kids = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, 1.0]), ("b", None)], "t string, v array<double>")
    r = rs.create_rdb({"t": pd.DataFrame({"id": ["a", "b"]}), "c": kids}, primary_keys={"t": "id"}, foreign_keys=[("c", "t", "t", "id")])
    out = rs.compute_features(r, pd.DataFrame({"id": ["a", "b"]}), {"id": "t.id"}, config_overrides={"agg_primitives": ["arraymax", "arraymin", "arraymean"]})
    assert {x.id: tuple(x[f"t.{n}(c.v)"] for n in ("ARRAYMAX", "ARRAYMIN", "ARRAYMEAN")) for x in out.collect()} == {"a": ([3.0, 5.0], [1.0, 1.0], [2.0, 3.0]), "b": (None, None, None)}


# --- a naive evaluator over random databases

LEVELS = {"root": None, "mid": "root", "leaf": "mid"}


def random_tables(seed):
    r = random.Random(seed)
    hour = lambda: T0 + timedelta(hours=r.randrange(48))
    maybe = lambda x: None if r.random() < 0.1 else x
    return {
        "root": [{"id": f"r{k}", "x": maybe(float(r.randrange(9))), "at": hour()} for k in range(6)],
        "mid": [{"id": f"m{k}", "root": maybe(f"r{r.choice([0, 0, 0, 1, 2, 3, 8])}"), "x": maybe(float(r.randrange(9))), "c": maybe(r.choice("ab")), "at": hour()} for k in range(40)],
        "leaf": [{"id": f"l{k}", "mid": maybe(f"m{r.choice([0, 0, r.randrange(45)])}"), "x": maybe(float(r.randrange(9))), "c": maybe(r.choice("abc")), "at": hour()} for k in range(120)],
    }


def naive(tables, table, key, cut, name):
    """Value of root features by looping over rows."""
    seen = lambda t: [x for x in tables[t] if cut is None or x["at"] < cut]
    row = next((x for x in seen(table) if x["id"] == key), None)
    agg = lambda f, xs: f([x for x in xs if x is not None])
    mean = lambda v: sum(v) / len(v) if v else None
    kids = lambda t, k: [x for x in seen(t) if x[LEVELS[t]] == k]
    mids = kids("mid", row["id"]) if row else []
    return {
        "root.x": row and row["x"],
        "root.COUNT(mid)": len(mids),
        "root.MEAN(mid.x)": agg(mean, [m["x"] for m in mids]),
        "root.MAX(mid.x)": agg(lambda v: max(v, default=None), [m["x"] for m in mids]),
        "root.STD(mid.x)": agg(lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None, [m["x"] for m in mids]),
        "root.MODE(mid.c)": agg(lambda v: min(set(v), key=lambda c: (-v.count(c), c)) if v else None, [m["c"] for m in mids]),
        "root.MEAN(mid.COUNT(leaf))": agg(mean, [len(kids("leaf", m["id"])) or None for m in mids]),
        "root.MAX(mid.MEAN(leaf.x))": agg(lambda v: max(v, default=None), [agg(mean, [x["x"] for x in kids("leaf", m["id"])]) for m in mids]),
    }[name]


NAMES = ["root.x", "root.COUNT(mid)", "root.MEAN(mid.x)", "root.MAX(mid.x)", "root.STD(mid.x)", "root.MODE(mid.c)", "root.MEAN(mid.COUNT(leaf))", "root.MAX(mid.MEAN(leaf.x))"]
SCHEMAS = {"root": "id string, x double, at timestamp_ntz", "mid": "id string, root string, x double, c string, at timestamp_ntz", "leaf": "id string, mid string, x double, c string, at timestamp_ntz"}


def random_rdb(spark, tables):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}
    return rs.create_rdb(frames, "n", {n: "id" for n in tables}, [("mid", "root", "root", "id"), ("leaf", "mid", "mid", "id")], {n: "at" for n in tables})


@pytest.mark.parametrize(("seed", "engine", "timed", "hot"), [(1, "range", True, 0), (2, "window", True, 0), (3, "range", False, 0), (4, "auto", True, 6), (5, "auto", True, 10**9)])
def test_same_as_naive_evaluation(spark, seed, engine, timed, hot):
    tables = random_tables(seed)
    r = random.Random(seed)
    target = [(k, r.choice(["r0", "r0", "r1", "r2", "r5", "r8", None]), T0 + timedelta(hours=r.randrange(50))) for k in range(60)]
    df = spark.createDataFrame(target, "k int, root string, cut timestamp_ntz")
    out = rs.compute_features(random_rdb(spark, tables), df, {"root": "root.id"}, "cut" if timed else None, config_overrides={"max_depth": 3, "engine": engine, "hot_rows": hot}).collect()
    for x in out:
        for n in NAMES:
            want = naive(tables, "root", x.root, x.cut if timed else None, n)
            assert x[n] == (pytest.approx(want) if isinstance(want, float) else want), (x.k, n)


ALL = ["count", "sum", "mean", "min", "max", "std", "variance", "skewness", "kurtosis", "product", "median", "quantile_25", "quantile_90", "any_value", "first", "last", "mode", "discrete_entropy", "nunique", "num_unique"]


def test_windows_and_selection_give_what_the_range_join_gives(spark, monkeypatch):
    """Every primitive, with one key that holds most rows, ties of time and value, buckets and parts so small that they split."""
    from rootstock.api import feature_engine
    from rootstock.plans import compile as c

    monkeypatch.setattr(c, "SPLITS", 4)
    feature_engine("tiny")(lambda rdb, config: c.Compiler(rdb, "window", bucket_rows=5))
    r = random.Random(11)
    minute = lambda: T0 + timedelta(minutes=r.randrange(3000) if r.random() < 0.7 else 60)
    value = lambda: r.choice([None, math.nan, 0.5, 0.5, 0.5, r.uniform(-3, 3), float(r.randrange(4))])
    kids = [("a" if r.random() < 0.8 else r.choice(["b", "c", None]), minute(), value(), r.choice([None, "x", "x", "y", "zz"]), r.choice([None, True, False]), r.choice([None, 1, 2, 3])) for _ in range(250)] + [("d", T0, None, None, None, None)]
    child = spark.createDataFrame(kids, "p string, at timestamp_ntz, v double, c string, f boolean, n int")
    rdb = rs.create_rdb({"p": spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string"), "kid": child}, primary_keys={"p": "id"}, foreign_keys=[("kid", "p", "p", "id")], time_columns={"kid": "at"}, type_hints={"kid": {"v": "float", "f": "float", "n": "float", "c": "category"}})
    target = spark.createDataFrame([(k, r.choice("aaabcde"), minute() if k % 9 else T0) for k in range(80)], "i int, p string, cut timestamp_ntz")
    got = {}
    for engine in ("range", "tiny", "auto"):
        out = rs.compute_features(rdb, target, {"p": "p.id"}, "cut", config_overrides={"agg_primitives": ALL, "engine": engine, "hot_rows": 50})
        got[engine] = {x.i: x.asDict() for x in out.collect()}
    names = [n for n in got["range"][0] if n.startswith("p.")]
    assert len(names) > 40
    for engine in ("tiny", "auto"):
        for i, want in got["range"].items():
            for n in names:
                x, y = got[engine][i][n], want[n]
                assert (x is None) == (y is None) and (x == y or (isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=1e-6, nan_ok=True))), (engine, i, n, x, y)


def short_histories(spark):
    """Keys with few children each, with ties of time and value, NULLs, NaN and a key without children; cutoffs at the children's own instants."""
    r = random.Random(31)
    moment = lambda: T0 + timedelta(minutes=r.randrange(12))
    kids = [(f"p{r.randrange(20)}", moment(), r.choice([None, math.nan, 0.5, 0.5, r.uniform(-3, 3)]), r.choice([None, "x", "x", "y"]), r.choice([None, True, False])) for _ in range(200)] + [("p20", T0, None, None, None)]
    child = spark.createDataFrame(kids, "p string, at timestamp_ntz, v double, c string, f boolean")
    parents = spark.createDataFrame([(f"p{k}",) for k in range(22)], "id string")
    rdb = rs.create_rdb({"p": parents, "kid": child}, primary_keys={"p": "id"}, foreign_keys=[("kid", "p", "p", "id")], time_columns={"kid": "at"}, type_hints={"kid": {"v": "float", "f": "float", "c": "category"}})
    return rdb, spark.createDataFrame([(k, f"p{k % 23}", moment() if k % 9 else None) for k in range(150)], "i int, p string, cut timestamp_ntz")


def same_by_windows(spark, primitives):
    rdb, target = short_histories(spark)
    got = {e: {x.i: x.asDict() for x in rs.compute_features(rdb, target, {"p": "p.id"}, "cut", config_overrides={"agg_primitives": primitives, "engine": e}).collect()} for e in ("range", "window")}
    for i, want in got["range"].items():
        for n, y in want.items():
            x = got["window"][i][n]
            assert type(x) is type(y) and (x == y or (isinstance(y, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9, nan_ok=True))), (i, n, x, y)


def test_histograms_of_short_keys_need_no_count_per_value_and_bucket(spark, monkeypatch):
    from rootstock.plans import compile as c

    monkeypatch.setattr(c.Compiler, "_upto", lambda *_: pytest.fail("running counts by value and time bucket"))
    same_by_windows(spark, ["nunique", "num_unique", "mode", "discrete_entropy"])


def test_quantiles_of_short_keys_write_no_rounds(spark, monkeypatch):
    from rootstock.plans import compile as c

    monkeypatch.setattr(c, "keep", lambda _: pytest.fail("rounds of selection, written to the shared folder"))
    same_by_windows(spark, ["quantile_25", "median", "quantile_90"])


def test_nested_aggregates_in_steps_give_what_the_range_join_gives(spark):
    tables = random_tables(21)
    r = random.Random(22)
    df = spark.createDataFrame([(k, r.choice(["r0", "r0", "r1", "r2", "r5", "r8", None]), T0 + timedelta(hours=r.randrange(50))) for k in range(70)], "k int, root string, cut timestamp_ntz")
    got = {}
    for engine in ("range", "auto"):
        out = rs.compute_features(random_rdb(spark, tables), df, {"root": "root.id"}, "cut", config_overrides={"agg_primitives": ["count", "max", "std", "mode"], "max_depth": 3, "engine": engine, "hot_rows": 6, "zero_nested_counts": True})
        got[engine] = {x.k: x.asDict() for x in out.collect()}
    names = [n for n in got["range"][0] if n.startswith("root.")]
    assert len(names) > 10
    for i, want in got["range"].items():
        for n in names:
            x, y = got["auto"][i][n], want[n]
            assert (x is None) == (y is None) and (x == y or (isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=1e-6))), (i, n, x, y)


def test_rows_at_or_after_the_cutoff_never_matter(spark):
    tables = random_tables(7)
    cut = T0 + timedelta(hours=24)
    later = {n: [x if x["at"] < cut else x | {"x": 999.0} for x in rows] for n, rows in tables.items()}
    df = spark.createDataFrame([(f"r{k}", cut) for k in range(6)], "root string, cut timestamp_ntz")
    one, two = (sorted(map(str, rs.compute_features(random_rdb(spark, t), df, {"root": "root.id"}, "cut", config_overrides={"max_depth": 3}).drop("root.at").collect())) for t in (tables, later))
    assert one == two


def test_stream_gives_the_same_as_a_batch(spark, tmp_path):
    from rootstock.streaming.incremental import incremental_aggregates

    df = spark.createDataFrame([("a", 1.5), ("a", float("nan")), (None, 1.0), ("b", None)], "k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    out = {r.k: (r.n, r.n_values, r.total, r.low) for r in incremental_aggregates(spark, str(tmp_path / "in"), "k", "v").collect()}
    assert out == {"a": (2, 1, "1.5000", 1.5), "b": (1, 0, None, None)}


def test_row_ids_keep_the_order_and_idle_settings_warn(spark, caplog):
    target = pd.DataFrame({"user_id": [U, "nobody", None, U], "item_id": [I] * 4})
    out = rs.compute_features(visits(), target, KEYS, config_overrides={"agg_primitives": ["count"], "row_id": "row", "n_jobs": 4})
    assert [r.user_id for r in out.orderBy("row").collect()] == list(target.user_id) and "n_jobs" in caplog.text
    with pytest.raises(ValueError, match="exists"):
        rs.compute_features(visits(), target, KEYS, config_overrides={"row_id": "user_id"})


def test_streams_without_rows_and_with_several_batches(spark, tmp_path):
    from rootstock.streaming.incremental import aggregate_stream, file_stream, incremental_aggregates

    schema = "k string, v double, t timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert incremental_aggregates(spark, str(tmp_path / "none"), "k", "v").count() == 0
    for k in range(3):
        spark.createDataFrame([("a", float(k), T0), (f"b{k}", None, T0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "some"))
    out = {r.k: (r.n, r.total) for r in incremental_aggregates(spark, str(tmp_path / "some"), "k", "v").collect()}
    assert out == {"a": (3, "3.0000"), "b0": (1, None), "b1": (1, None), "b2": (1, None)}
    windowed = aggregate_stream(file_stream(spark, str(tmp_path / "some"), 1), "k", "v", "t", "1 hour")
    assert windowed.isStreaming and "window" in windowed.columns

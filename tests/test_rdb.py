"""Schema, loading, saving, inference and keys."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

import rootstock as rs
from rootstock.schema import ColumnSchema, RdbMeta, TableSchema, load_yaml, save_yaml


def shop():
    users = pd.DataFrame({"user_id": [1, 2, 3], "age": [20, 30, 40], "signup_date": pd.to_datetime(["2024-01-01"] * 3)})
    items = pd.DataFrame({"item_id": ["a", "b"], "price": [1.5, np.nan], "category": ["x", "y"]})
    seen = pd.DataFrame({"user_id": [1, 1, 2], "item_id": ["a", "b", "a"], "timestamp": pd.to_datetime(["2024-02-01", "2024-02-02", "2024-02-03"]), "rating": [5, 4, 3]})
    return {"users": users, "items": items, "seen": seen}


def made():
    return rs.create_rdb(shop(), "shop", {"users": "user_id", "items": "item_id"}, [("seen", "user_id", "users", "user_id"), ("seen", "item_id", "items", "item_id")], {"seen": "timestamp"})


def test_create_infers_types(spark):
    r = made()
    kinds = {(t.name, c.name): str(c.dtype) for t in r.metadata.tables for c in t.columns}
    assert kinds == {
        ("users", "user_id"): "primary_key", ("users", "age"): "float", ("users", "signup_date"): "datetime", ("items", "item_id"): "primary_key", ("items", "price"): "float", ("items", "category"): "category",
        ("seen", "user_id"): "foreign_key", ("seen", "item_id"): "foreign_key", ("seen", "timestamp"): "datetime", ("seen", "rating"): "float",
    }
    assert r.get_table_metadata("seen").time_column == "timestamp"
    assert [tuple(x) for x in r.get_relationships()] == [("seen", "user_id", "users", "user_id"), ("seen", "item_id", "items", "item_id")]
    assert r.get_table("items").where("price is null").count() == 1  # NaN is no value


def test_inference_precedence_and_threshold(spark):
    from rootstock.functions.inference import infer_types

    n = 15
    df = rs.rdb.as_spark(pd.DataFrame({"id": range(n), "f": [0.5] * n, "b": [True] * n, "d": pd.to_datetime(["2024-01-01"] * n), "cat": ["a", "b", None] * 5, "text": [str(k) for k in range(n)], "ten": [str(k % 10) for k in range(n)], "nine": [str(k % 9) for k in range(n)], "empty": [None] * n}))
    assert {c: str(t) for c, t in infer_types(df, "id").items()} == {"id": "primary_key", "f": "float", "b": "float", "d": "datetime", "cat": "category", "text": "text", "ten": "text", "nine": "category", "empty": "category"}
    assert infer_types(df, "id", hints={"id": "text", "text": "category"})["id"] == "primary_key"
    assert infer_types(df, "id", hints={"text": "category"})["text"] == "category"
    five = rs.rdb.as_spark(pd.DataFrame({"c": list("abcde")}))
    assert [str(infer_types(five, category_threshold=k)["c"]) for k in (3, 5, 6)] == ["text", "text", "category"]
    assert str(infer_types(spark.createDataFrame([], "x bigint"))["x"]) == "float"


def test_save_and_load_round_trip(spark, tmp_path):
    r = made()
    r.save(tmp_path / "r")
    again = rs.load_rdb(tmp_path / "r")
    assert again.metadata == r.metadata
    assert sorted(map(tuple, again.get_table("seen").collect())) == sorted(map(tuple, r.get_table("seen").collect()))


def test_load_npz_coerces_and_drops(spark, tmp_path):
    np.savez(tmp_path / "u.npz", user_id=np.array(["a", "b"]), x=np.array(["1.5", "bad"]), day=np.array(["2024-01-01", "no"]), other=np.array([1, 2]))
    meta = {"name": "n", "tables": [{"name": "u", "source": "u.npz", "format": "numpy", "columns": [{"name": "user_id", "dtype": "primary_key", "capacity": 9}, {"name": "x", "dtype": "float"}, {"name": "day", "dtype": "datetime"}]}]}
    save_yaml(meta, tmp_path / "metadata.yaml")
    r = rs.load_rdb(tmp_path)
    assert r.get_table("u").columns == ["user_id", "x", "day"]
    assert [tuple(x) for x in r.get_table("u").orderBy("user_id").collect()] == [("a", 1.5, datetime(2024, 1, 1)), ("b", None, None)]
    assert r.metadata.to_dict()["tables"][0]["columns"][0] == {"name": "user_id", "dtype": "primary_key", "capacity": 9}
    meta["tables"][0]["columns"].append({"name": "gone", "dtype": "float"})
    save_yaml(meta, tmp_path / "metadata.yaml")
    with pytest.raises(ValueError, match="gone"):
        rs.load_rdb(tmp_path)
    (tmp_path / "u.npz").unlink()
    with pytest.raises(FileNotFoundError):
        rs.load_rdb(tmp_path)
    with pytest.raises(FileNotFoundError):
        rs.load_rdb(tmp_path / "nowhere")
    assert load_yaml(tmp_path / "metadata.yaml")["name"] == "n"


def test_unknown_table_and_bad_formats(spark):
    r = made()
    for look in (r.get_table, r.get_table_metadata):
        with pytest.raises(ValueError, match="not found"):
            look("nothing")
    with pytest.raises(ValueError):
        TableSchema("t", format="csv")
    with pytest.raises(ValueError, match="link_to"):
        RdbMeta("m", [TableSchema("t", [ColumnSchema("c", "foreign_key", "nodot")])]).relationships  # noqa: B018


def test_updates_are_strict_and_leave_the_original(spark):
    r = made()
    s = r.get_table_metadata("users")
    with pytest.raises(ValueError, match="same names"):
        r.update_tables({"users": r.get_table("users")}, {})
    with pytest.raises(ValueError, match="not in its schema"):
        r.update_table("users", r.get_table("users").selectExpr("*", "1 as extra"), s)
    smaller = r.update_table("users", r.get_table("users").where("user_id = 1"), s)
    assert smaller.get_table("users").count() == 1 and r.get_table("users").count() == 3


def test_add_table(spark):
    r = made()
    more = r.add_table(pd.DataFrame({"user_id": [1], "at": pd.to_datetime(["2024-01-01"]), "x": [1.0]}), "log", "at", None, [("user_id", "users", "user_id"), ])
    assert more.table_names == [*r.table_names, "log"] and more.get_table_metadata("log").time_column == "at"
    with pytest.raises(ValueError, match="exists"):
        more.add_table(pd.DataFrame({"x": [1]}), "log")
    assert r.add_table(pd.DataFrame({"k": [1]}), "y", foreign_keys=[("k", "absent", "id")]).get_relationships()[-1].parent_table == "absent"


def test_key_types(spark):
    a, b = pd.DataFrame({"id": [1, 2]}), pd.DataFrame({"a_id": ["1", "2"]})
    r = rs.create_rdb({"a": a, "b": b}, primary_keys={"a": "id"}, foreign_keys=[("b", "a_id", "a", "id")])
    with pytest.raises(TypeError, match="a.id"):
        r.validate_key_consistency()
    c = r.canonicalize_key_types()
    c.validate_key_consistency()
    assert c.get_table("a").schema["id"].dataType.simpleString() == "string"
    bad = rs.create_rdb({"a": pd.DataFrame({"id": [1.0, 2.0]})}, primary_keys={"a": "id"})
    with pytest.raises(ValueError, match="float"):
        bad.canonicalize_key_types()
    holes = rs.create_rdb({"a": a, "b": pd.DataFrame({"a_id": pd.array([1, None], "Int64")})}, primary_keys={"a": "id"}, foreign_keys=[("b", "a_id", "a", "id")])
    assert sorted([x[0] for x in holes.canonicalize_key_types().get_table("b").collect()], key=str) == ["1", None]


def test_ddl(spark):
    ddl = made().ddl
    assert '"price" DOUBLE' in ddl["items"] and '"timestamp" TIMESTAMP' in ddl["seen"] and 'REFERENCES "users"' in ddl["seen"] and '"user_id" VARCHAR PRIMARY KEY' in ddl["users"]


def test_frames_of_the_caller_stay(spark):
    t = shop()
    before = {n: df.copy() for n, df in t.items()}
    rs.create_rdb(t, primary_keys={"users": "user_id"})
    for n, df in t.items():
        pd.testing.assert_frame_equal(df, before[n])

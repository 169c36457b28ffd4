from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

import rootstock as rs
from rootstock.schema import ColumnSchema, RdbMeta, TableSchema


def products(parent_ids, **children):
    tables = {"Product": pd.DataFrame({"product_id": pd.array(parent_ids, "Int64"), "name": pd.array([f"p{k}" for k in parent_ids], "string"), "price": pd.array([1.0] * len(parent_ids), "float64")})}
    for n, ids in children.items():
        tables[n] = pd.DataFrame({f"{n}_id": pd.array(range(len(ids)), "Int64"), "product_id": pd.array(ids, "Int64")})
    pk = {"Product": "product_id"} | {n: f"{n}_id" for n in children}
    return rs.create_rdb(tables, "p", pk, [(n, "product_id", "Product", "product_id") for n in children], None, {"Product": {"name": "text"}})


@pytest.mark.parametrize(
    ("parent", "children", "want"),
    [([1, 2, 3], {"Order": [1, 2, 3, 4, 5]}, {1, 2, 3, 4, 5}), ([1, 2, 3, 4, 5], {"Order": [1, 3, 5]}, {1, 2, 3, 4, 5}), ([1, 2], {"Order": [1, 2, 3], "Review": [2, 4, 5]}, {1, 2, 3, 4, 5}), ([], {"Order": [1, 2, 3]}, {1, 2, 3}), ([1, 2, 3], {"Order": []}, {1, 2, 3})],
)
def test_fill_missing_primary_key(spark, parent, children, want):
    out = rs.FillMissingPrimaryKey()(products(parent, **children)).get_table("Product").collect()
    assert {r.product_id for r in out} == want and len(out) == len(want)
    assert {r.name for r in out if r.product_id not in parent} <= {""} and {r.price for r in out if r.product_id not in parent} <= {None}


def test_fill_compares_keys_in_key_form_and_counts_right_under_duplicates(spark):
    tables = {"Category": pd.DataFrame({"id": [1691, 542, 542]}), "View": pd.DataFrame({"c": ["1691", "542", "999", "999.0", "nan", None]})}
    r = rs.create_rdb(tables, "v", {"Category": "id"}, [("View", "c", "Category", "id")])
    assert sorted(x.id for x in rs.FillMissingPrimaryKey()(r).get_table("Category").collect()) == ["1691", "542", "542", "999"]
    alone = rs.create_rdb({"Category": tables["Category"]}, "v", {"Category": "id"})
    assert rs.FillMissingPrimaryKey()(alone) is alone


def test_dummy_table(spark):
    r = rs.create_rdb({"t": pd.DataFrame({"fk_id": pd.array([1, 2, None, 2], "Int64")})}, foreign_keys=[("t", "fk_id", "missing", "id")])
    out = rs.HandleDummyTable()(r)
    assert sorted(x.id for x in out.get_table("missing").collect()) == [1, 2]
    assert out.get_table_metadata("missing").primary_key == "id" and rs.HandleDummyTable()(out) is out


def test_datetime_parts(spark):
    r = rs.create_rdb({"t": pd.DataFrame({"id": [1, 2, 3], "at": pd.to_datetime(["1970-01-01", "2020-01-01", None])})}, primary_keys={"t": "id"}, time_columns={"t": "at"})
    out = rs.FeaturizeDatetime(["year", "dayofweek", "epochtime"])(r)
    rows = {x.id: x for x in out.get_table("t").collect()}
    assert (rows[1].at_epochtime, rows[2].at_epochtime, rows[3].at_epochtime) == (0, 1577836800000000000, None)
    assert (rows[2].at_year, rows[2].at_dayofweek) == (2020, 2)
    gone = rs.apply_transform(r, rs.FeaturizeDatetime(["year"], retain_original=False))
    assert gone.get_table("t").columns == ["id", "at_year"] and gone.get_table_metadata("t").time_column is None
    with pytest.raises(ValueError, match="unknown"):
        rs.FeaturizeDatetime(["fortnight"])


def test_filter_column(spark):
    df = pd.DataFrame({"id": [1, 2], "same": [3.0, 3.0], "nulls": pd.array([None, None], "Float64"), "half": pd.array([1.0, None], "Float64"), "txt": ["a", "b"], "ok": [1.0, 2.0]})
    r = rs.create_rdb({"t": df}, primary_keys={"t": "id"}, type_hints={"t": {"txt": "text"}})
    assert rs.FilterColumn(["text", "primary_key"], drop_redundant=True)(r).get_table("t").columns == ["id", "half", "ok"]
    assert rs.FilterColumn()(r).get_table("t").columns == list(df.columns)
    empty = rs.FilterColumn([], True)(r.update_table("t", r.get_table("t").limit(0), r.get_table_metadata("t")))
    assert empty.get_table("t").columns == ["id"]


def test_canonicalize_types(spark):
    df = spark.createDataFrame([(1, "1.1", "10", "2023-01-01", "a", 5, 1), (2, "not_a_number", "bad_int", "not_a_date", None, 6, 1), (3, "nan", "10.0", None, "b", None, 1)], "id bigint, f string, i string, d string, c string, t bigint, extra int")
    kinds = {"id": "primary_key", "f": "float", "i": "timestamp", "d": "datetime", "c": "category", "t": "text"}
    out, schema = rs.CanonicalizeTypes()(df, TableSchema("t", [ColumnSchema(c, k) for c, k in kinds.items()]))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("1", 1.1, 10, datetime(2023, 1, 1), "a", "5"), ("2", None, None, None, None, "6"), ("3", None, 10, None, "b", None)]
    with pytest.raises(ValueError, match="nope"):
        rs.CanonicalizeTypes()(df, TableSchema("t", [ColumnSchema("nope", "float")]))


def test_pipeline_and_own_transforms(spark):
    class Double(rs.ColumnTransform):
        def applies_to(self, column):
            return column.dtype == "float"

        def __call__(self, value, column, dtype):
            return [(column, value * 2)]

    class Only(rs.TableTransform):
        def __call__(self, df, schema):
            return df.where(F.col("id") == 1), schema

    r = rs.create_rdb({"t": pd.DataFrame({"id": [1, 2], "x": [1.0, 2.0]})}, primary_keys={"t": "id"})
    assert [tuple(x) for x in rs.apply_transform_pipeline(r, [Double(), Only()]).get_table("t").collect()] == [(1, 2.0)]
    out = rs.RdbTransformPipeline([rs.RdbTransformWrapper(Double()), rs.RdbTransformWrapper(Double())])(r)
    assert sorted(x.x for x in out.get_table("t").collect()) == [4.0, 8.0]


def test_infer_schema_keeps_what_is_declared_and_drops_unnamed(spark):
    df = spark.createDataFrame([(1, "a", 0)], ["id", "c", "Unnamed: 0"])
    bare = rs.Rdb(RdbMeta("r", [TableSchema("t", [ColumnSchema("c", "text")])]), {"t": df})
    out = rs.InferSchemaTransform({"t": "id"})(bare)
    assert {c.name: str(c.dtype) for c in out.get_table_metadata("t").columns} == {"id": "primary_key", "c": "text"} and out.get_table("t").columns == ["id", "c"]

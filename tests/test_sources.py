import sqlite3
from datetime import datetime
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

from rootstock.schema import TableFormat, TableSchema
from rootstock.sources.benchmarks import BenchmarkStore, StoreAdapter, TableDictAdapter, Task, TaskSchema
from rootstock.sources.files import get_reader, get_writer, read_table, write_table
from rootstock.sources.sql import DuckDBAdapter, MySQLAdapter, PostgreSQLAdapter, SQLiteAdapter, semantic_type

DDL = [
    "create table users (user_id integer primary key, name text, age integer)",
    "create table orders (order_id integer primary key, user_id integer references users(user_id), amount double, created timestamp, order_date text)",
    "insert into users values (1, 'a', 30), (2, 'b', null)",
    "insert into orders values (10, 1, 2.5, '2024-01-01 10:00:00', '2024-01-01'), (11, 2, 3.5, '2024-01-02 10:00:00', '2024-01-02')",
]


@pytest.fixture(params=["sqlite", "duckdb"])
def adapter(request, spark, tmp_path):
    path = tmp_path / f"shop.{request.param}"
    con = sqlite3.connect(path) if request.param == "sqlite" else duckdb.connect(str(path))
    for s in DDL:
        con.execute(s)
    if request.param == "sqlite":
        con.commit()
    con.close()
    kind = SQLiteAdapter if request.param == "sqlite" else DuckDBAdapter
    return lambda **k: kind(path, **k)


def test_discovery(adapter):
    r = adapter().load()
    assert r.metadata.name == "shop" and sorted(r.table_names) == ["orders", "users"]
    assert r.get_table_metadata("orders").primary_key == "order_id" and r.get_table_metadata("orders").time_column == "created"
    assert [tuple(x) for x in r.get_relationships()] == [("orders", "user_id", "users", "user_id")]
    assert {c.name: str(c.dtype) for c in r.get_table_metadata("users").columns} == {"user_id": "primary_key", "name": "text", "age": "float"}
    assert r.get_table("orders").where("created < timestamp_ntz'2024-01-01 12:00:00'").count() == 1


def test_hints_win_and_tables_restrict(adapter):
    r = adapter(tables=["orders", "nothing"], name="x", type_hints={"orders": {"order_date": "datetime", "amount": "category"}}, time_columns={"orders": "order_date"}).load()
    assert r.table_names == ["orders"] and r.metadata.name == "x" and r.get_relationships() == []
    assert r.get_table_metadata("orders").time_column == "order_date" and str(r.get_table_metadata("orders").column_dict["amount"].dtype) == "category"
    twice = adapter(foreign_keys=[("orders", "user_id", "users", "user_id")]).load()
    assert len(twice.get_relationships()) == 1


def test_missing_files_and_servers(spark, tmp_path):
    for kind in (SQLiteAdapter, DuckDBAdapter):
        with pytest.raises(FileNotFoundError):
            kind(tmp_path / "none.db")
    my = MySQLAdapter("mysql+driver://me:p%40ss@host:3307/shop?useSSL=false")
    assert (my.url, my.options["user"], my.options["password"], my.options["useSSL"], my.home) == ("jdbc:mysql://host:3307/shop", "me", "p@ss", "false", "shop")
    pg = PostgreSQLAdapter("postgresql://host/shop", schema="sales", tables=["t"])
    assert (pg.url, pg.qualified("t"), pg.home, pg.name) == ("jdbc:postgresql://host/shop", '"sales"."t"', "sales", "postgresql_rdb")
    assert "sales" in pg.keys_sql("t") and "shop" in my.keys_sql("t")


def test_type_names():
    kinds = {"INTEGER": "float", "NUMERIC(10,2)": "float", "int unsigned": "float", "TIMESTAMP WITH TIME ZONE": "datetime", "BOOLEAN": "category", "VARCHAR(20)": "text", "INTERVAL": "text", "ENUM('a','b')": "category"}
    assert {k: str(semantic_type(k)) for k in kinds} == kinds


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0])], "x bigint, s string, v array<double>")
    for fmt, name in ((TableFormat.PARQUET, "a.parquet"), (TableFormat.NUMPY, "a.npz")):
        write_table(df.drop("s") if fmt == TableFormat.NUMPY else df, tmp_path / name, fmt)
        assert read_table(spark, tmp_path / name, fmt).first().x == 1
    np.savez(tmp_path / "p.npz", o=np.array(["a", None], object))
    with pytest.raises(ValueError, match="pickle"):
        read_table(spark, tmp_path / "p.npz", "numpy")
    assert read_table(spark, tmp_path / "p.npz", "numpy", allow_pickle=True).count() == 2
    for get in (get_reader, get_writer):
        with pytest.raises(ValueError, match="unknown"):
            get("csv")


def test_table_dict_data_sets(spark, tmp_path):
    t = lambda df, pk=None, at=None, **fk: SimpleNamespace(df=pd.DataFrame(df), pkey_col=pk, time_col=at, fkey_col_to_pkey_table=fk)
    db = SimpleNamespace(table_dict={"designs": t({"id": [1], "masking": [f"m{1}"], "study": [1]}, "id", None, study="studies"), "studies": t({"nct": [1], "limitations_and_caveats": ["x"]}, "nct"), "outcome_analyses": t({"o": [1], "p_value_raw": ["1"], "lost": [5]}, "o", None, lost="nowhere")})
    r = TableDictAdapter("rel-trial", SimpleNamespace(get_db=lambda: db), tmp_path / "out").load()
    assert r.get_table("outcome_analyses").columns == ["o", "lost"] and r.get_table("studies").columns == ["nct"]
    assert str(r.get_table_metadata("designs").column_dict["masking"].dtype) == "category" and [tuple(x) for x in r.get_relationships()] == [("designs", "study", "studies", "nct")]
    assert (tmp_path / "out" / "metadata.yaml").exists()
    races = SimpleNamespace(table_dict={"races": t({"id": [1, 2], "time": pd.to_timedelta(["01:00:00", "00:00:01.5"])}, "id")})
    assert [x.time for x in TableDictAdapter("rel-f1", races).load().get_table("races").orderBy("id").collect()] == [3600.0, 1.5]
    text = SimpleNamespace(table_dict={"races": t({"id": [1, 2], "time": ["01:00:00", "1 days 00:00:01"]}, "id")})
    assert [x.time for x in TableDictAdapter("rel-f1", text).load().get_table("races").orderBy("id").collect()] == [3600.0, 86401.0]


def test_array_data_sets(spark):
    c = lambda name, dtype, link=None: SimpleNamespace(name=name, dtype=dtype, link_to=link)
    table = lambda name, cols, at=None: SimpleNamespace(name=name, columns=cols, time_column=at)
    meta = SimpleNamespace(tables=[table("View", [c("userId", "category"), c("queryId", "foreign_key", "Query.queryId"), c("bad", "foreign_key", "nodot"), c("gone", "float")]), table("Query", [c("queryId", "primary_key")]), table("Empty", [c("x", "float")])])
    data = {"View": {"userId": np.array([123.0, np.nan]), "queryId": np.array([1, 2]), "bad": np.array([1, 2]), "extra": np.array([0, 0])}, "Query": {"queryId": np.array([1, 2])}}
    r = StoreAdapter("diginetica", SimpleNamespace(metadata=meta, tables=data)).load()
    assert r.table_names == ["View", "Query"] and sorted([x.userId for x in r.get_table("View").collect()], key=str) == ["123", None]
    assert [tuple(x) for x in r.get_relationships()] == [("View", "queryId", "Query", "queryId")]
    flags = SimpleNamespace(metadata=SimpleNamespace(tables=[table("View", [c("id", "primary_key"), c("added_to_cart", "category")])]), tables={"View": {"id": np.array([1]), "added_to_cart": np.array([1])}})
    assert str(StoreAdapter("retailrocket", flags).load().get_table_metadata("View").column_dict["added_to_cart"].dtype) == "float"


def test_store_with_tasks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id bigint, x double")
    columns = [{"name": "id", "dtype": "primary_key"}, {"name": "x", "dtype": "float"}]
    task = TaskSchema.from_dict({"name": "guess", "source": "s", "format": "parquet", "columns": columns, "evaluation_metric": "auroc", "target_column": "x", "target_table": "t", "task_type": "classification", "num_classes": 2})
    store = BenchmarkStore("b", (TableSchema.from_dict({"name": "t", "columns": columns}),), {"t": df}, (Task(task, df, df, df),))
    for fmt in TableFormat:
        store.save(tmp_path / str(fmt), fmt)
        again = BenchmarkStore.load(tmp_path / str(fmt))
        got = again.get_task("guess")
        assert again.name == "b" and got.schema.extra == {"num_classes": 2} and got.validation.first().x == 0.5 and str(got.schema.type) == "classification"
    with pytest.raises(ValueError, match="unknown task"):
        store.get_task("other")
    assert StoreAdapter("b", store).load().table_names == ["t"]


def test_reading_in_batches(adapter, spark, monkeypatch):
    from rootstock.sources import sql

    monkeypatch.setattr(sql, "ROWS_PER_BATCH", 1)
    r = adapter().load()
    assert {(x.order_id, x.user_id, x.amount, str(x.created)) for x in r.get_table("orders").collect()} == {("10", "1", 2.5, "2024-01-01 10:00:00"), ("11", "2", 3.5, "2024-01-02 10:00:00")} or {(x.order_id, x.amount) for x in r.get_table("orders").collect()} == {(10, 2.5), (11, 3.5)}
    assert "read-" in " ".join(r.get_table("orders").inputFiles())


def test_sqlite_keeps_types_by_value(spark, tmp_path):
    with sqlite3.connect(tmp_path / "t #1.db") as c:
        c.execute('create table "a ""b" (i integer primary key, mixed integer, real_ real, none_ integer, raw blob, day date)')
        c.executemany('insert into "a ""b" values (?, ?, ?, null, ?, ?)', [(1, 5, 1, b"x", "2024-01-01"), (2, "five", 2.5, b"y", "soon")])
    df = SQLiteAdapter(tmp_path / "t #1.db").read('a "b')
    assert [tuple(x) for x in df.orderBy("i").selectExpr("i", "mixed", "real_", "none_", "cast(raw as string)", "cast(day as string)").collect()] == [(1, "5", 1.0, None, "x", "2024-01-01 00:00:00"), (2, "five", 2.5, None, "y", None)]


def test_an_open_connection(spark, tmp_path):
    from rootstock.sources.sql import ConnectionAdapter

    con = duckdb.connect()
    for s in DDL:
        con.execute(s)
    r = ConnectionAdapter(con, "mine", primary_keys={"users": "user_id", "orders": "order_id"}, foreign_keys=[("orders", "user_id", "users", "user_id")]).load()
    assert r.metadata.name == "mine" and r.get_table_metadata("orders").time_column == "created" and r.get_table("orders").count() == 2
    plain = sqlite3.connect(":memory:")
    plain.execute("create table t (x text)")
    with pytest.raises(ValueError, match="give their names"):
        ConnectionAdapter(plain).load()
    assert ConnectionAdapter(plain, tables=["t"]).load().get_table("t").count() == 0


def test_split_reads_and_quoted_names(spark):
    pg = PostgreSQLAdapter("postgresql://host/shop", schema='s"x', rows_per_part=100)
    my = MySQLAdapter("mysql://host/shop", partitions={"t": ("id", 1, 5, 2)})
    assert pg.qualified("T'1") == '"s""x"."T\'1"' and my.qualified("a`b") == "`a``b`" and "'T''1'" in pg.keys_sql("T'1")
    asked = []
    answers = {"select min": [(5, 1004)], "select column_name": [("id", "integer")], "select t.": [("PRIMARY KEY", "id", None, None, "k")]}
    pg._query = lambda q: asked.append(q) or next(v for k, v in answers.items() if q.startswith(k))
    assert pg.parts("t") == ("id", 5, 1005, 10) and my.parts("t") == ("id", 1, 5, 2)
    answers["select min"] = [(None, None)]
    assert pg.parts("t") is None


def test_databases_by_name(spark, tmp_path):
    from rootstock import load_by_name

    r = rs_create(spark)
    r.save(tmp_path / "shop")
    BenchmarkStore("b", tuple(r.metadata.tables), r.tables).save(tmp_path / "bench")
    (tmp_path / "names.yaml").write_text(f"shop: shop\nbench: {tmp_path}/bench\nnone: nowhere\n")
    for name in ("shop", "bench"):
        assert load_by_name(name, tmp_path / "names.yaml", spark).get_table("u").count() == 2
    with pytest.raises(ValueError, match="catalogue"):
        load_by_name("other", tmp_path / "names.yaml", spark)
    with pytest.raises(FileNotFoundError):
        load_by_name("none", tmp_path / "names.yaml", spark)
    assert ("u", "id", "primary_key", None, None) in r.columns
    try:
        assert list(r.sqlalchemy_metadata.tables) == ["u"]
    except ImportError as e:
        assert "sqlalchemy" in str(e)


def rs_create(spark):
    from rootstock import create_rdb

    return create_rdb({"u": spark.createDataFrame([(1, 0.5), (2, 1.5)], "id bigint, x double")}, "shop", primary_keys={"u": "id"})


def test_duckdb_query_stores_whole_batches(spark, tmp_path, monkeypatch):
    """A statement a row takes minutes from 100,000 rows on."""
    import duckdb

    from rootstock.queries import features

    spark.createDataFrame([(k, f"c{k}", k / 2) for k in range(5)], "c_custkey int, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, k % 4, datetime(2024, 1, 1, k % 24), None if k == 7 else k / 4) for k in range(300)]
    spark.createDataFrame(orders, "o_orderkey int, o_custkey int, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    opened, statements = duckdb.connect, []

    class Counted:
        def __init__(self, *args, **kwargs):
            self.inner = opened(*args, **kwargs)

        def __getattr__(self, name):
            if name in ("execute", "executemany"):
                return lambda sql, args=(): (statements.extend([sql] * (len(args) if name == "executemany" else 1)), getattr(self.inner, name)(sql, args))[1]
            return getattr(self.inner, name)

    monkeypatch.setattr(duckdb, "connect", Counted)
    got = {r.o_orderkey: r.asDict() for r in features.duckdb_source(spark, str(tmp_path)).collect()}
    assert sum(s.startswith("insert") for s in statements) < 20
    assert got == {k: {"o_orderkey": k, "c_acctbal": c / 2, "n": 75, "max_price": (296 + c) / 4} for k, c, _, _ in orders}

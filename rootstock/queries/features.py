"""Feature queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootstock.api import FeatureConfig, FeaturePipeline, compute_features, plan_features
from rootstock.functions.inference import infer_types
from rootstock.functions.keys import key_form
from rootstock.functions.primitives import NUMERIC, register_primitive
from rootstock.functions.storage import checkpoint_dir
from rootstock.operators import transforms as tr
from rootstock.rdb import Rdb, create_rdb
from rootstock.schema import ColumnSchema, RdbMeta, TableFormat, TableSchema
from rootstock.sources.benchmarks import BenchmarkStore, StoreAdapter, TableDictAdapter, Task, TaskSchema
from rootstock.sources.sql import ConnectionAdapter, DuckDBAdapter, SQLiteAdapter
from rootstock.streaming.incremental import incremental_aggregates

PK, FL, CAT, TXT, DT = "primary_key", "float", "category", "text", "datetime"


def _t(name: str, columns: dict[str, str], time: str | None = None) -> TableSchema:
    """Columns by type; "parent.key" makes a foreign key."""
    return TableSchema(name, [ColumnSchema(c, "foreign_key", k) if "." in k else ColumnSchema(c, k) for c, k in columns.items()], time_column=time)


# The star schema of the test tables.
SCHEMAS = {
    s.name: s
    for s in [
        _t("region", {"r_regionkey": PK, "r_name": CAT}),
        _t("nation", {"n_nationkey": PK, "n_regionkey": "region.r_regionkey", "n_name": TXT}),
        _t("customer", {"c_custkey": PK, "c_nationkey": "nation.n_nationkey", "c_name": TXT, "c_acctbal": FL, "c_mktsegment": CAT}),
        _t("supplier", {"s_suppkey": PK, "s_nationkey": "nation.n_nationkey", "s_name": TXT, "s_acctbal": FL}),
        _t("part", {"p_partkey": PK, "p_name": TXT, "p_brand": CAT, "p_type": CAT, "p_size": FL, "p_retailprice": FL}),
        _t("orders", {"o_orderkey": PK, "o_custkey": "customer.c_custkey", "o_orderdate": DT, "o_orderstatus": CAT, "o_orderpriority": CAT, "o_totalprice": FL}, "o_orderdate"),
        _t("lineitem", {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey", "l_linenumber": FL, "l_quantity": FL, "l_returnflag": CAT, "l_linestatus": CAT, "l_shipdate": DT}, "l_shipdate"),
        _t("events", {"event_id": PK, "user_id": "user.user_id", "ts": DT, "event_type": CAT, "value": FL}, "ts"),
    ]
}


def _rdb(spark: SparkSession, sf: str, *names: str, **changed: DataFrame) -> Rdb:
    tables = {}
    for n in names:
        df = changed.get(n, spark.read.parquet(f"{sf}/{n}.parquet"))
        keys = {c.name: F.col(c.name).cast("string") for c in SCHEMAS[n].columns if c.dtype in (PK, "foreign_key")}
        tables[n] = df.select(*[keys.get(c.name, F.col(c.name)).alias(c.name) for c in SCHEMAS[n].columns])
    return Rdb(RdbMeta("star", [SCHEMAS[n] for n in names]), tables)


def _features(spark: SparkSession, sf: str, tables: list[str], target: str, keys: dict[str, str], wanted: dict[str, str], *, keep: list[str], cutoff: str | None = None, static: list[str] = (), **config) -> DataFrame:
    """Features of a target, renamed: keep are the target's own columns, wanted maps feature names to output names."""
    rdb = _rdb(spark, sf, *tables)
    if static:  # tables whose rows count as always known
        metas = [TableSchema(t.name, t.columns) if t.name in static else t for t in rdb.metadata.tables]
        rdb = Rdb(RdbMeta(rdb.metadata.name, metas), rdb.tables)
    df = spark.read.parquet(f"{sf}/{target}.parquet").select(*dict.fromkeys([*keep, *keys, *([cutoff] if cutoff else [])]))
    out = compute_features(rdb, df, keys, cutoff, FeatureConfig(**config))
    return out.select(*keep, *[F.col(f"`{f}`").alias(a) for f, a in wanted.items()])


def _bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def min_slice(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest end-to-end query: orders with what was known of their customer before."""
    return _features(spark, sf, ["customer", "orders"], "orders", {"o_custkey": "customer.c_custkey"}, {"customer.c_acctbal": "c_acctbal", "customer.COUNT(orders)": "n_orders", "customer.MAX(orders.o_totalprice)": "max_price"}, keep=["o_orderkey"], cutoff="o_orderdate", agg_primitives=["count", "max"], max_depth=2)


def direct_depth1(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["part"], "lineitem", {"l_partkey": "part.p_partkey"}, {"part.p_name": "p_name", "part.p_size": "p_size", "part.p_type": "p_type"}, keep=["l_orderkey", "l_linenumber", "l_partkey"], max_depth=1)


def direct_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["customer", "nation", "region"], "orders", {"o_custkey": "customer.c_custkey"}, {"customer.nation.n_name": "n_name", "customer.nation.region.r_name": "r_name"}, keep=["o_orderkey"], max_depth=3, agg_primitives=[])


def _agg(primitives: list[str], wanted: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _features(spark, sf, ["part", "lineitem"], "part", {"p_partkey": "part.p_partkey"}, wanted, keep=["p_partkey"], max_depth=2, agg_primitives=primitives)

    return run


_L = "part.{}(lineitem.l_quantity)"
agg_count = _agg(["count"], {"part.COUNT(lineitem)": "n"})
agg_sum = _agg(["sum"], {_L.format("SUM"): "sum_qty"})
agg_minmax = _agg(["min", "max"], {_L.format("MIN"): "min_qty", _L.format("MAX"): "max_qty"})
agg_mean_int = _agg(["mean"], {_L.format("MEAN"): "mean_qty"})
agg_std = _agg(["std", "variance"], {_L.format("STD"): "std_qty", _L.format("VARIANCE"): "var_qty"})
agg_median = _agg(["median"], {_L.format("MEDIAN"): "median_qty"})
agg_quantiles = _agg(["quantile_25", "quantile_75", "quantile_90"], {_L.format("QUANTILE_25"): "q25", _L.format("QUANTILE_75"): "q75", _L.format("QUANTILE_90"): "q90"})
agg_mode = _agg(["mode"], {"part.MODE(lineitem.l_returnflag)": "mode_flag", "part.MODE(lineitem.l_linestatus)": "mode_status"})
agg_entropy = _agg(["discrete_entropy"], {"part.DISCRETE_ENTROPY(lineitem.l_returnflag)": "entropy_flag"})
agg_nunique = _agg(["nunique"], {"part.NUNIQUE(lineitem.l_returnflag)": "n_flags", _L.format("NUNIQUE"): "n_quantities"})
agg_first_last = _agg(["first", "last"], {_L.format("FIRST"): "first_qty", _L.format("LAST"): "last_qty"})
agg_moments = _agg(["skewness"], {_L.format("SKEWNESS"): "skew_qty"})
agg_kurtosis = _agg(["kurtosis"], {_L.format("KURTOSIS"): "kurt_qty"})
agg_any_value = _agg(["any_value"], {"part.ANY_VALUE(lineitem.l_returnflag)": "any_flag", _L.format("ANY_VALUE"): "any_qty"})


def agg_product(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["nation", "supplier"], "nation", {"n_nationkey": "nation.n_nationkey"}, {"nation.PRODUCT(supplier.s_acctbal)": "product"}, keep=["n_nationkey"], max_depth=2, agg_primitives=["product"])


def agg_own_primitive(spark: SparkSession, sf: str) -> DataFrame:
    """A primitive of the user's: the span of values."""
    span = register_primitive("span", NUMERIC, NUMERIC, lambda c, t: F.max(c) - F.min(c))
    return _features(spark, sf, ["part", "lineitem"], "part", {"p_partkey": "part.p_partkey"}, {_L.format("SPAN"): "span_qty"}, keep=["p_partkey"], max_depth=2, agg_primitives=[span])


def agg_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of each label, element by element."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").cast("string").alias("label"), "embedding")
    meta = RdbMeta("e", [_t("label", {"label": PK}), _t("vector", {"label": "label.label", "embedding": FL})])
    labels = vectors.select("label").distinct()
    out = compute_features(Rdb(meta, {"label": labels, "vector": vectors}), labels, {"label": "label.label"}, config=FeatureConfig(agg_primitives=["arraymax", "arraymin", "arraymean"]))
    each = [F.posexplode(F.arrays_zip(*[F.col(f"`label.{n}(vector.embedding)`").alias(a) for n, a in (("ARRAYMAX", "high"), ("ARRAYMIN", "low"), ("ARRAYMEAN", "mean"))]))]
    return out.select("label", *each).select("label", "pos", F.col("col.high").cast("double").alias("high"), F.col("col.low").cast("double").alias("low"), F.round("col.mean", 6).alias("mean"))


def _allowed(**rules) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Names of the features that remain where tables are left out."""
        rdb = _rdb(spark, sf, "customer", "orders", "lineitem", "nation")
        found = plan_features(rdb, {"o_custkey": "customer.c_custkey"}, FeatureConfig(agg_primitives=["count"], max_depth=3, **rules))
        return spark.createDataFrame([(n,) for n in found], "feature string")

    return run


include_entities = _allowed(include_entities=["customer", "orders"])
ignore_entities = _allowed(ignore_entities=["lineitem"])


def agg_join_text(spark: SparkSession, sf: str) -> DataFrame:
    rdb = _rdb(spark, sf, "nation", "region")
    out = compute_features(rdb, spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey"), {"r_regionkey": "region.r_regionkey"}, config=FeatureConfig(agg_primitives=["join"], max_depth=2))
    return out.select("r_regionkey", F.col("`region.JOIN(nation.n_name)`").alias("names"))


def agg_of_direct(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["part", "lineitem", "supplier"], "part", {"p_partkey": "part.p_partkey"}, {"part.MAX(lineitem.supplier.s_acctbal)": "max_acctbal"}, keep=["p_partkey"], max_depth=3, agg_primitives=["max"])


def _agg_of_agg(zero: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _features(spark, sf, ["customer", "orders", "lineitem"], "customer", {"c_custkey": "customer.c_custkey"}, {"customer.MEAN(orders.COUNT(lineitem))": "mean_lines"}, keep=["c_custkey"], max_depth=3, agg_primitives=["mean", "count"], zero_nested_counts=zero)

    return run


def multi_hop(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["customer", "orders", "lineitem"], "customer", {"c_custkey": "customer.c_custkey"}, {"customer.COUNT(lineitem)": "n_lines", "customer.SUM(lineitem.l_quantity)": "sum_qty"}, keep=["c_custkey"], max_depth=2, agg_primitives=["count", "sum"], multi_hop=True)


def multi_hop_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, ["customer", "orders", "lineitem"], "orders", {"o_custkey": "customer.c_custkey"}, {"customer.COUNT(lineitem)": "n_lines"}, keep=["o_orderkey"], cutoff="o_orderdate", max_depth=2, agg_primitives=["count"], multi_hop=True, multi_hop_with_cutoff=True)


def multi_key(spark: SparkSession, sf: str) -> DataFrame:
    return _features(
        spark, sf, ["part", "supplier", "lineitem"], "lineitem", {"l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
        {"part.p_size": "p_size", "part.SUM(lineitem.l_quantity)": "part_qty", "supplier.COUNT(lineitem)": "supplier_lines"}, keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], max_depth=2, agg_primitives=["count", "sum"],
    )


def _cutoff(primitives: list[str], wanted: dict[str, str], engine: str = "range", hot_rows: int = 10_000) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _features(spark, sf, ["part", "lineitem"], "lineitem", {"l_partkey": "part.p_partkey"}, wanted, keep=["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], cutoff="l_shipdate", max_depth=2, agg_primitives=primitives, engine=engine, hot_rows=hot_rows)

    return run


_STATS = {"part.COUNT(lineitem)": "n", _L.format("SUM"): "sum_qty", _L.format("MIN"): "min_qty", _L.format("MAX"): "max_qty", _L.format("MEAN"): "mean_qty"}
cutoff_count = _cutoff(["count"], {"part.COUNT(lineitem)": "n"})
cutoff_stats = _cutoff(["count", "sum", "min", "max", "mean"], _STATS)
cutoff_window = _cutoff(["count", "sum", "min", "max", "mean"], _STATS, "window")
cutoff_auto = _cutoff(["count", "sum", "min", "max", "mean"], _STATS, "auto", 30)
cutoff_std_window = _cutoff(["std", "count"], {_L.format("STD"): "std_qty"}, "window")
cutoff_mode_window = _cutoff(["mode", "discrete_entropy"], {"part.MODE(lineitem.l_returnflag)": "mode_flag", "part.DISCRETE_ENTROPY(lineitem.l_returnflag)": "entropy_flag"}, "window")
cutoff_std = _cutoff(["std"], {_L.format("STD"): "std_qty"})
cutoff_quantile = _cutoff(["quantile_25", "median"], {_L.format("QUANTILE_25"): "q25", _L.format("MEDIAN"): "median_qty"})
_RANKS = {_L.format("QUANTILE_25"): "q25", _L.format("MEDIAN"): "median_qty"}
cutoff_quantile_window = _cutoff(["quantile_25", "median"], _RANKS, "window")
cutoff_quantile_auto = _cutoff(["quantile_25", "median"], _RANKS, "auto", 30)
_KINDS = {_L.format("NUNIQUE"): "n_quantities", "part.NUNIQUE(lineitem.l_returnflag)": "n_flags"}
cutoff_nunique = _cutoff(["nunique"], _KINDS)
cutoff_nunique_window = _cutoff(["nunique"], _KINDS, "window")
_SHAPE = {_L.format("SKEWNESS"): "skew_qty", _L.format("KURTOSIS"): "kurt_qty"}


def _rounded(query: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """Values to five places; a little is added, so that what lies half-way is rounded alike however it was summed up."""
    return lambda spark, sf: query(spark, sf).withColumns({c: F.round(F.col(c) + 3.1e-8, 5) + 0.0 for c in columns})


cutoff_moments = _rounded(_cutoff(["skewness", "kurtosis"], _SHAPE), "skew_qty", "kurt_qty")
cutoff_moments_window = _rounded(_cutoff(["skewness", "kurtosis"], _SHAPE, "window"), "skew_qty", "kurt_qty")
_PICKED = {_L.format("FIRST"): "first_qty", _L.format("LAST"): "last_qty", "part.ANY_VALUE(lineitem.l_returnflag)": "any_flag"}
cutoff_first_last = _cutoff(["first", "last", "any_value"], _PICKED)
cutoff_first_last_window = _cutoff(["first", "last", "any_value"], _PICKED, "window")


def cutoff_hot(spark: SparkSession, sf: str) -> DataFrame:
    """One part holds a third of all lines; engine auto gives it windows and selection, all others the range join."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_partkey")).cast("string"))
    rdb = Rdb(RdbMeta("hot", [SCHEMAS["part"], _t("line", {"l_partkey": "part.p_partkey", "l_quantity": FL, "l_returnflag": CAT, "l_shipdate": DT}, "l_shipdate")]), {"part": _rdb(spark, sf, "part").get_table("part"), "line": lines.select("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")})
    wanted = {"COUNT(line)": "n", "MEAN(line.l_quantity)": "mean_qty", "STD(line.l_quantity)": "std_qty", "MEDIAN(line.l_quantity)": "median_qty", "NUNIQUE(line.l_quantity)": "n_quantities", "MODE(line.l_returnflag)": "mode_flag"}
    out = compute_features(rdb, lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), {"l_partkey": "part.p_partkey"}, "l_shipdate", FeatureConfig(agg_primitives=["count", "mean", "std", "median", "nunique", "mode"], hot_rows=5000))
    return out.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("bigint").alias("l_partkey"), "l_shipdate", *[F.col(f"`part.{f}`").alias(a) for f, a in wanted.items()])


cutoff_mode = _cutoff(["mode", "discrete_entropy"], {"part.MODE(lineitem.l_returnflag)": "mode_flag", "part.DISCRETE_ENTROPY(lineitem.l_returnflag)": "entropy_flag"})


def _cutoff_depth3(**options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _features(spark, sf, ["customer", "orders", "lineitem"], "orders", {"o_custkey": "customer.c_custkey"}, {"customer.MAX(orders.COUNT(lineitem))": "max_lines", "customer.MAX(orders.SUM(lineitem.l_quantity))": "max_qty"}, keep=["o_orderkey"], cutoff="o_orderdate", max_depth=3, agg_primitives=["max", "sum", "count"], **options)


cutoff_depth3 = _cutoff_depth3()
#: Customers with more than ten orders go by versions and windows.
cutoff_depth3_auto = _cutoff_depth3(hot_rows=10)


def cutoff_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are timed: a line shipped on or before its order's date doesn't see the order."""
    return _features(spark, sf, ["orders"], "lineitem", {"l_orderkey": "orders.o_orderkey"}, {"orders.o_orderstatus": "o_orderstatus"}, keep=["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], cutoff="l_shipdate", max_depth=1)


def target_history(spark: SparkSession, sf: str) -> DataFrame:
    """Past rows of the target as a further table."""
    rdb = _rdb(spark, sf, "customer")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderdate", "o_totalprice")
    rdb = rdb.add_table(orders, "history", "o_orderdate", None, [("o_custkey", "customer", "c_custkey")], {"o_totalprice": "float"})
    target = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    out = compute_features(rdb, target, {"o_custkey": "customer.c_custkey"}, "o_orderdate", FeatureConfig(agg_primitives=["count", "max"]))
    return out.select("o_orderkey", F.col("`customer.COUNT(history)`").alias("n"), F.col("`customer.MAX(history.o_totalprice)`").alias("max_price"))


def apply_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Transforms of a column, a table and a database, applied one after another."""
    rdb = tr.apply_transform_pipeline(_rdb(spark, sf, "orders"), [tr.FeaturizeDatetime(["quarter", "dayofyear"], retain_original=False), _Constant(), tr.FilterColumn(["category"], drop_redundant=True)])
    return tr.apply_transform(rdb, tr.CanonicalizeTypes()).get_table("orders")


def epoch_of_null(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a time that may be NULL: when users were deleted."""
    users = spark.read.parquet(f"{sf}/users.parquet").select("user_id", "deleted_at")
    rdb = Rdb(RdbMeta("u", [_t("users", {"user_id": PK, "deleted_at": DT})]), {"users": users})
    out = tr.FeaturizeDatetime(["epochtime", "year"], retain_original=False)(rdb).get_table("users")
    return out.select("user_id", F.col("deleted_at_epochtime").alias("epoch"), F.col("deleted_at_year").alias("year"))


def infer_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Types, links and time columns filled in by the transform."""
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders")}
    bare = Rdb(RdbMeta("shop", [TableSchema(n, [ColumnSchema(c, TXT) for c in ()]) for n in tables]), tables)
    rdb = tr.InferSchemaTransform({"customer": "c_custkey", "orders": "o_orderkey"}, [("orders", "o_custkey", "customer", "c_custkey")], {"orders": "o_orderdate"})(bare)
    return spark.createDataFrame(rdb.columns, "table_name string, column_name string, dtype string, link_to string, time_column string")


def update_table(spark: SparkSession, sf: str) -> DataFrame:
    """One table replaced by part of its columns, then read."""
    rdb = _rdb(spark, sf, "customer", "orders")
    schema = rdb.get_table_metadata("orders")
    slim = schema.with_columns([c for c in schema.columns if c.name in ("o_orderkey", "o_custkey", "o_orderdate")])
    return rdb.update_table("orders", rdb.get_table("orders").select(*[c.name for c in slim.columns]), slim).get_table("orders")


def ddl(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE TABLE statements of a database."""
    return spark.createDataFrame(list(_rdb(spark, sf, "region", "nation").ddl.items()), "table_name string, statement string")


def _stored(spark: SparkSession, sf: str, open_file: Callable[[str], object], insert: Callable[[object, str, pa.Table], object] | None = None) -> str:
    """customer and orders in a database file; these formats are files of one machine, written for the query and read at once.

    Rows pass the driver in batches; insert(connection, table, rows) puts in a batch, row by row unless given.
    """
    path = f"{tempfile.mkdtemp(prefix='rootstock-db-')}/shop.db"
    con = open_file(path)
    one_by_one = lambda con, name, rows: con.executemany(f"insert into {name} values ({', '.join('?' * rows.num_columns)})", [tuple(r.values()) for r in rows.to_pylist()])
    for name, columns in {"customer": "c_custkey integer primary key, c_name text, c_acctbal double precision", "orders": "o_orderkey integer primary key, o_custkey integer references customer(c_custkey), o_orderdate timestamp, o_totalprice double precision"}.items():
        con.execute(f"create table {name} ({columns})")
        names = [c.split()[0] for c in columns.split(", ")]
        rows = spark.read.parquet(f"{sf}/{name}.parquet").select(*[F.col(n).cast("string") if n == "o_orderdate" else F.col(n) for n in names])
        rows.write.parquet(where := f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}")
        for batch in ds.dataset(where, format="parquet").to_batches(batch_size=100_000, batch_readahead=1, fragment_readahead=1):
            (insert or one_by_one)(con, name, pa.Table.from_batches([batch]))
    con.commit()
    con.close()
    return path


def _orders_of(rdb: Rdb) -> DataFrame:
    """Orders with their customer's balance, through discovered keys and types."""
    target = rdb.get_table("orders").select("o_orderkey", "o_custkey")
    out = compute_features(rdb, target, {"o_custkey": "customer.c_custkey"}, config=FeatureConfig(agg_primitives=["count", "max"]))
    names = {"customer.c_acctbal": "c_acctbal", "customer.COUNT(orders)": "n", "customer.MAX(orders.o_totalprice)": "max_price"}
    return out.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), *[F.col(f"`{f}`").alias(a) for f, a in names.items()])


def sqlite_source(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_of(SQLiteAdapter(_stored(spark, sf, sqlite3.connect), spark=spark).load())


def duckdb_source(spark: SparkSession, sf: str) -> DataFrame:
    import duckdb

    def opened(path: str):
        con = duckdb.connect(path)
        con.execute("begin")
        return con

    def insert(con, name: str, rows: pa.Table) -> None:
        # A statement a row takes DuckDB over half a millisecond each.
        con.register("batch", rows)
        con.execute(f"insert into {name} select * from batch")
        con.unregister("batch")

    return _orders_of(DuckDBAdapter(_stored(spark, sf, opened, insert), spark=spark).load())


def connection_source(spark: SparkSession, sf: str) -> DataFrame:
    """An open connection of the user, with keys from hints."""
    con = sqlite3.connect(_stored(spark, sf, sqlite3.connect))
    hints = {"orders": {"o_totalprice": FL, "o_orderdate": DT}, "customer": {"c_acctbal": FL}}
    return _orders_of(ConnectionAdapter(con, "shop", ["customer", "orders"], primary_keys={"customer": "c_custkey", "orders": "o_orderkey"}, foreign_keys=[("orders", "o_custkey", "customer", "c_custkey")], type_hints=hints, spark=spark).load())


def table_dict_source(spark: SparkSession, sf: str) -> DataFrame:
    """A data set that has its tables in a dictionary, with a duration to be given in seconds."""
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    part = lambda df, pk, at, **fk: SimpleNamespace(df=df, pkey_col=pk, time_col=at, fkey_col_to_pkey_table=fk)
    hours = F.concat(F.col("o_orderkey") % 50, F.lit(":30:15"))
    db = SimpleNamespace(table_dict={"customer": part(read("customer"), "c_custkey", None), "races": part(read("orders").withColumn("time", hours), "o_orderkey", "o_orderdate", o_custkey="customer")})
    rdb = TableDictAdapter("rel-f1", db, spark=spark).load()
    return rdb.get_table("races").select("o_orderkey", "o_custkey", "time")


def array_source(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark store with a task, saved, loaded and read as a database; float ids become texts."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("double")).alias("userId"), "o_totalprice")
    columns = [{"name": "o_orderkey", "dtype": PK}, {"name": "userId", "dtype": CAT}, {"name": "o_totalprice", "dtype": FL}]
    task = TaskSchema.from_dict({"name": "price", "source": "s", "format": "parquet", "columns": columns, "evaluation_metric": "rmse", "target_column": "o_totalprice", "target_table": "View", "task_type": "regression"})
    where = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    BenchmarkStore("diginetica", (TableSchema.from_dict({"name": "View", "columns": columns}),), {"View": orders}, (Task(task, orders, orders, orders),)).save(where)
    again = BenchmarkStore.load(where, spark)
    view = StoreAdapter("diginetica", again, spark=spark).load().get_table("View")
    return view.join(again.get_task("price").test.select("o_orderkey", F.col("o_totalprice").alias("label")), "o_orderkey")


def dummy_table(spark: SparkSession, sf: str) -> DataFrame:
    return tr.HandleDummyTable()(_rdb(spark, sf, "events")).get_table("user")


def fill_missing_pk(spark: SparkSession, sf: str) -> DataFrame:
    """Missing parents added; parts of size 25 or less are dropped first to make some missing."""
    rdb = _rdb(spark, sf, "part", "lineitem", part=spark.read.parquet(f"{sf}/part.parquet").where("p_size > 25"))
    return tr.FillMissingPrimaryKey()(rdb).get_table("part").select("p_partkey", "p_name", "p_size")


def featurize_datetime(spark: SparkSession, sf: str) -> DataFrame:
    rdb = _rdb(spark, sf, "orders")
    out = tr.FeaturizeDatetime(["year", "month", "day", "hour", "minute", "second", "dayofweek", "epochtime"])(rdb).get_table("orders")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderdate_")])


def filter_redundant(spark: SparkSession, sf: str) -> DataFrame:
    rdb = _rdb(spark, sf, "part")
    rdb = tr.RdbTransformWrapper(_Constant())(rdb)
    return tr.FilterColumn(["text"], drop_redundant=True)(rdb).get_table("part")


class _Constant(tr.TableTransform):
    """Adds a column that says nothing."""

    def __call__(self, df: DataFrame, schema: TableSchema) -> tuple[DataFrame, TableSchema]:
        return df.withColumn("same", F.lit(7.0)), schema.with_columns([*schema.columns, ColumnSchema("same", FL)])


def canonicalize_types(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/user_orders.parquet").select(F.col("order_id"), F.col("created_at").alias("amount_text"), F.col("order_date").alias("day"), "status", F.col("user_id").alias("ticks"))
    schema = _t("o", {"order_id": PK, "amount_text": FL, "status": CAT, "ticks": "timestamp"})
    return tr.CanonicalizeTypes()(orders, schema)[0]


def infer_schema(spark: SparkSession, sf: str) -> DataFrame:
    types = infer_types(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey")
    return spark.createDataFrame([(c, str(t)) for c, t in types.items()], "column_name string, dtype string")


def key_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/user_orders.parquet")
    return o.select("order_id", key_form(F.col("user_id"), o.schema["user_id"].dataType).alias("user_key")).distinct()


def bool_agg(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").cast("string").alias("l_partkey"), (F.col("l_returnflag") == "R").alias("returned"))
    meta = RdbMeta("b", [SCHEMAS["part"], _t("line", {"l_partkey": "part.p_partkey", "returned": FL})])
    rdb = Rdb(meta, {"part": _rdb(spark, sf, "part").get_table("part"), "line": lines})
    target = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    out = compute_features(rdb, target, {"p_partkey": "part.p_partkey"}, config=FeatureConfig(agg_primitives=["mean", "sum", "max"]))
    return out.select("p_partkey", F.col("`part.MEAN(line.returned)`").alias("mean_returned"), F.col("`part.SUM(line.returned)`").alias("sum_returned"), F.col("`part.MAX(line.returned)`").alias("any_returned"))


def pipeline_e2e(spark: SparkSession, sf: str) -> DataFrame:
    """All five usual transforms, then features with a cutoff."""
    steps = tr.RdbTransformPipeline([tr.HandleDummyTable(), tr.FillMissingPrimaryKey(), tr.FeaturizeDatetime(["year", "month", "hour"]), tr.FilterColumn(["text"]), tr.CanonicalizeTypes()])
    target = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    out = FeaturePipeline(steps, FeatureConfig(agg_primitives=["count", "max"])).compute_features(_rdb(spark, sf, "events"), target, {"user_id": "user.user_id"}, "ts")
    names = {"user.COUNT(events)": "n", "user.MAX(events.ts_month)": "max_month", "user.MAX(events.ts_hour)": "max_hour"}
    return _bigints(out.select("event_id", *[F.col(f"`{f}`").alias(a) for f, a in names.items()]), "max_month", "max_hour")


def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums per user, kept up to date by a stream over the events."""
    return incremental_aggregates(spark, f"{sf}/events.parquet", "user_id", "value")


def _round_trip(spark: SparkSession, sf: str, fmt: TableFormat, *names: str) -> Rdb:
    """A database written to the shared folder and read again."""
    where = f"{checkpoint_dir(spark)}/rdb-{uuid.uuid4().hex}"
    _rdb(spark, sf, *names).save(where, fmt)
    return Rdb.load(where, spark, allow_pickle=True)


def rdb_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet sink and source: the orders of a saved and loaded database."""
    return _round_trip(spark, sf, TableFormat.PARQUET, "customer", "orders").get_table("orders")


def rdb_save_load_npz(spark: SparkSession, sf: str) -> DataFrame:
    """NumPy sink and source, over nation only: archives are read on the driver."""
    return _round_trip(spark, sf, TableFormat.NUMPY, "nation").get_table("nation")


def create_rdb_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred types, links and time columns of a database made from plain tables."""
    rdb = create_rdb({n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("customer", "orders")}, "shop", {"customer": "c_custkey", "orders": "o_orderkey"}, [("orders", "o_custkey", "customer", "c_custkey")], {"orders": "o_orderdate"})
    rows = [(t.name, c.name, str(c.dtype), c.link_to, t.time_column) for t in rdb.metadata.tables for c in t.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, dtype string, link_to string, time_column string")


def key_types(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of two tables as strings of one type."""
    tables = {"nation": spark.read.parquet(f"{sf}/nation.parquet"), "customer": spark.read.parquet(f"{sf}/customer.parquet")}
    rdb = Rdb(RdbMeta("k", [TableSchema("nation", [ColumnSchema("n_nationkey", PK)]), TableSchema("customer", [ColumnSchema("c_custkey", PK), ColumnSchema("c_nationkey", "foreign_key", "nation.n_nationkey")])]), tables).canonicalize_key_types()
    rdb.validate_key_consistency()
    return rdb.get_table("customer").select("c_custkey", "c_nationkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "min_slice": min_slice, "direct_depth1": direct_depth1, "direct_chain": direct_chain,
    "agg_count": agg_count, "agg_sum": agg_sum, "agg_minmax": agg_minmax, "agg_mean_int": agg_mean_int, "agg_std": agg_std, "agg_median": agg_median, "agg_quantiles": agg_quantiles,
    "agg_mode": agg_mode, "agg_entropy": agg_entropy, "agg_nunique": agg_nunique, "agg_first_last": agg_first_last, "agg_moments": agg_moments, "agg_join_text": agg_join_text,
    "agg_of_direct": agg_of_direct, "agg_of_agg": _agg_of_agg(False), "agg_of_agg_zero": _agg_of_agg(True), "multi_hop": multi_hop, "multi_hop_cutoff": multi_hop_cutoff, "multi_key": multi_key,
    "cutoff_count": cutoff_count, "cutoff_stats": cutoff_stats, "cutoff_window": cutoff_window, "cutoff_std": cutoff_std, "cutoff_auto": cutoff_auto, "cutoff_std_window": cutoff_std_window, "cutoff_mode_window": cutoff_mode_window, "cutoff_quantile": cutoff_quantile, "cutoff_mode": cutoff_mode, "cutoff_depth3": cutoff_depth3, "cutoff_depth3_auto": cutoff_depth3_auto,
    "cutoff_quantile_window": cutoff_quantile_window, "cutoff_quantile_auto": cutoff_quantile_auto, "cutoff_nunique": cutoff_nunique, "cutoff_nunique_window": cutoff_nunique_window, "cutoff_moments": cutoff_moments, "cutoff_moments_window": cutoff_moments_window, "cutoff_first_last": cutoff_first_last, "cutoff_first_last_window": cutoff_first_last_window, "cutoff_hot": cutoff_hot,
    "agg_kurtosis": agg_kurtosis, "agg_any_value": agg_any_value, "agg_product": agg_product, "agg_own_primitive": agg_own_primitive, "agg_arrays": agg_arrays, "include_entities": include_entities, "ignore_entities": ignore_entities, "apply_helpers": apply_helpers, "epoch_of_null": epoch_of_null, "infer_transform": infer_transform, "update_table": update_table, "ddl": ddl,
    "sqlite_source": sqlite_source, "duckdb_source": duckdb_source, "connection_source": connection_source, "table_dict_source": table_dict_source, "array_source": array_source,
    "cutoff_forward": cutoff_forward, "target_history": target_history, "dummy_table": dummy_table, "fill_missing_pk": fill_missing_pk, "featurize_datetime": featurize_datetime,
    "filter_redundant": filter_redundant, "canonicalize_types": canonicalize_types, "infer_schema": infer_schema, "key_canonicalize": key_canonicalize, "bool_agg": bool_agg, "pipeline_e2e": pipeline_e2e,
    "incremental_stream": incremental_stream, "rdb_save_load": rdb_save_load, "rdb_save_load_npz": rdb_save_load_npz, "create_rdb_inferred": create_rdb_inferred, "key_types": key_types,
}

_BY_PART = "select p.p_partkey, {} from part p left join lineitem l on l.l_partkey = p.p_partkey group by p.p_partkey"
_CUT = "select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_shipdate, {} from lineitem t left join (select x.l_partkey, x.l_shipdate, {} from (select distinct l_partkey, l_shipdate from lineitem) x join lineitem h on h.l_partkey = x.l_partkey and h.l_shipdate < x.l_shipdate group by 1, 2) a on a.l_partkey = t.l_partkey and a.l_shipdate = t.l_shipdate"
_SHAPE_SQL = "case when sum(d * d) > 1e-9 then sqrt(count(*)) * sum(d * d * d) / pow(sum(d * d), 1.5) end as skew_qty, case when sum(d * d) > 1e-9 then count(*) * sum(d * d * d * d) / pow(sum(d * d), 2) - 3 end as kurt_qty"
_H = "sum(h.l_quantity) as sum_qty, min(h.l_quantity) as min_qty, max(h.l_quantity) as max_qty, avg(h.l_quantity) as mean_qty"
_STATS_SQL = _CUT.format("coalesce(a.n, 0) as n, a.sum_qty, a.min_qty, a.max_qty, a.mean_qty", f"count(*) as n, {_H}")
_MODE = "(select {k}, {v} as m from (select {k}, {v}, row_number() over (partition by {k} order by count(*) desc, {v}) as r from {t} where {v} is not null group by {k}, {v}) where r = 1)"
_ENTROPY = "(select {k}, -sum(n / s * log2(n / s)) + 0.0 as e from (select {k}, n * 1.0 as n, sum(n) over (partition by {k}) as s from (select {k}, {v}, count(*) as n from {t} where {v} is not null group by {k}, {v})) group by {k})"
_PAIRS = "(select x.l_partkey, x.l_shipdate, h.l_returnflag from (select distinct l_partkey, l_shipdate from lineitem) x join lineitem h on h.l_partkey = x.l_partkey and h.l_shipdate < x.l_shipdate)"
_USER = """case when user_id is null or lower(trim(user_id, e' \\t\\n\\r')) in ('', 'nan', 'none', '<na>') then null
 when regexp_matches(trim(user_id, e' \\t\\n\\r'), '^[+-]?[0-9]+([.]0*)?$') then regexp_replace(regexp_replace(trim(user_id, e' \\t\\n\\r'), '^[+]|[.]0*$', '', 'g'), '^(-?)0+([0-9])', '\\1\\2')
 else trim(user_id, e' \\t\\n\\r') end"""

ORACLES: dict[str, str] = {
    "min_slice": "select t.o_orderkey, c.c_acctbal, coalesce(a.n, 0) as n_orders, a.m as max_price from orders t left join customer c on c.c_custkey = t.o_custkey left join (select t.o_orderkey, count(*) as n, max(h.o_totalprice) as m from orders t join orders h on h.o_custkey = t.o_custkey and h.o_orderdate < t.o_orderdate group by 1) a on a.o_orderkey = t.o_orderkey",
    "direct_depth1": "select l_orderkey, l_linenumber, l_partkey, p_name, p_size, p_type from lineitem left join part on p_partkey = l_partkey",
    "direct_chain": "select o_orderkey, n_name, r_name from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey",
    "agg_count": _BY_PART.format("count(l.l_partkey) as n"),
    "agg_sum": _BY_PART.format("sum(l.l_quantity) as sum_qty"),
    "agg_minmax": _BY_PART.format("min(l.l_quantity) as min_qty, max(l.l_quantity) as max_qty"),
    "agg_mean_int": _BY_PART.format("avg(l.l_quantity) as mean_qty"),
    "agg_std": _BY_PART.format("stddev_samp(l.l_quantity) as std_qty, var_samp(l.l_quantity) as var_qty"),
    "agg_median": _BY_PART.format("median(l.l_quantity) as median_qty"),
    "agg_quantiles": _BY_PART.format("quantile_cont(l.l_quantity, 0.25) as q25, quantile_cont(l.l_quantity, 0.75) as q75, quantile_cont(l.l_quantity, 0.9) as q90"),
    "agg_mode": f"select p.p_partkey, a.m as mode_flag, b.m as mode_status from part p left join {_MODE.format(k='l_partkey', v='l_returnflag', t='lineitem')} a on a.l_partkey = p.p_partkey left join {_MODE.format(k='l_partkey', v='l_linestatus', t='lineitem')} b on b.l_partkey = p.p_partkey",
    "agg_entropy": f"select p.p_partkey, a.e as entropy_flag from part p left join {_ENTROPY.format(k='l_partkey', v='l_returnflag', t='lineitem')} a on a.l_partkey = p.p_partkey",
    "agg_nunique": "select p.p_partkey, a.f as n_flags, a.q as n_quantities from part p left join (select l_partkey, count(distinct l_returnflag) as f, count(distinct l_quantity) as q from lineitem group by 1) a on a.l_partkey = p.p_partkey",
    "agg_first_last": "select p.p_partkey, a.f as first_qty, a.l as last_qty from part p left join (select l_partkey, (min({'t': l_shipdate, 'q': l_quantity})).q as f, (max({'t': l_shipdate, 'q': l_quantity})).q as l from lineitem group by 1) a on a.l_partkey = p.p_partkey",
    "agg_join_text": "select r_regionkey, a.names from region left join (select n_regionkey, string_agg(n_name, e'\\n' order by n_name) as names from nation group by 1) a on n_regionkey = r_regionkey",
    "agg_of_direct": "select p.p_partkey, max(s.s_acctbal) as max_acctbal from part p left join lineitem l on l.l_partkey = p.p_partkey left join supplier s on s.s_suppkey = l.l_suppkey group by 1",
    "agg_of_agg": "select c.c_custkey, avg(n) as mean_lines from customer c left join orders o on o.o_custkey = c.c_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l.l_orderkey = o.o_orderkey group by 1",
    "agg_of_agg_zero": "select c.c_custkey, avg(case when o.o_orderkey is not null then coalesce(n, 0) end) as mean_lines from customer c left join orders o on o.o_custkey = c.c_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) l on l.l_orderkey = o.o_orderkey group by 1",
    "multi_hop": "select c.c_custkey, count(l.l_orderkey) as n_lines, sum(l.l_quantity) as sum_qty from customer c left join orders o on o.o_custkey = c.c_custkey left join lineitem l on l.l_orderkey = o.o_orderkey group by 1",
    "multi_hop_cutoff": "select t.o_orderkey, coalesce(a.n, 0) as n_lines from orders t left join (select t.o_orderkey, count(*) as n from orders t join orders o on o.o_custkey = t.o_custkey and o.o_orderdate < t.o_orderdate join lineitem l on l.l_orderkey = o.o_orderkey and l.l_shipdate < t.o_orderdate group by 1) a on a.o_orderkey = t.o_orderkey",
    "multi_key": "select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, p.p_size, a.q as part_qty, coalesce(b.n, 0) as supplier_lines from lineitem t left join part p on p.p_partkey = t.l_partkey left join (select l_partkey, sum(l_quantity) as q from lineitem group by 1) a on a.l_partkey = p.p_partkey left join supplier s on s.s_suppkey = t.l_suppkey left join (select l_suppkey, count(*) as n from lineitem group by 1) b on b.l_suppkey = s.s_suppkey",
    "cutoff_count": _CUT.format("coalesce(a.n, 0) as n", "count(*) as n"),
    "cutoff_stats": _STATS_SQL,
    "cutoff_window": _STATS_SQL,
    "cutoff_std": _CUT.format("a.std_qty", "stddev_samp(h.l_quantity) as std_qty"),
    "cutoff_quantile": _CUT.format("a.q25, a.median_qty", "quantile_cont(h.l_quantity, 0.25) as q25, median(h.l_quantity) as median_qty"),
    "cutoff_mode": f"select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_shipdate, a.m as mode_flag, b.e as entropy_flag from lineitem t left join {_MODE.format(k='l_partkey, l_shipdate', v='l_returnflag', t=_PAIRS)} a on a.l_partkey = t.l_partkey and a.l_shipdate = t.l_shipdate left join {_ENTROPY.format(k='l_partkey, l_shipdate', v='l_returnflag', t=_PAIRS)} b on b.l_partkey = t.l_partkey and b.l_shipdate = t.l_shipdate",
    "cutoff_depth3": "select t.o_orderkey, a.m as max_lines, a.q as max_qty from orders t left join (select o_orderkey, max(n) as m, max(q) as q from (select t.o_orderkey, o.o_orderkey as k, count(*) as n, sum(l.l_quantity) as q from orders t join orders o on o.o_custkey = t.o_custkey and o.o_orderdate < t.o_orderdate join lineitem l on l.l_orderkey = o.o_orderkey and l.l_shipdate < t.o_orderdate group by 1, 2) group by 1) a on a.o_orderkey = t.o_orderkey",
    "cutoff_forward": "select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderstatus from lineitem left join orders on o_orderkey = l_orderkey and o_orderdate < l_shipdate",
    "target_history": "select t.o_orderkey, coalesce(a.n, 0) as n, a.m as max_price from orders t left join (select t.o_orderkey, count(*) as n, max(h.o_totalprice) as m from orders t join orders h on h.o_custkey = t.o_custkey and h.o_orderdate < t.o_orderdate group by 1) a on a.o_orderkey = t.o_orderkey",
    "dummy_table": "select distinct cast(user_id as varchar) as user_id from events where user_id is not null",
    "fill_missing_pk": "select cast(p_partkey as varchar) as p_partkey, p_name, p_size from part where p_size > 25 union all select distinct cast(l_partkey as varchar), '', null from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)",
    "featurize_datetime": "select cast(o_orderkey as varchar) as o_orderkey, year(o_orderdate) as o_orderdate_year, month(o_orderdate) as o_orderdate_month, day(o_orderdate) as o_orderdate_day, hour(o_orderdate) as o_orderdate_hour, minute(o_orderdate) as o_orderdate_minute, second(o_orderdate) as o_orderdate_second, isodow(o_orderdate) - 1 as o_orderdate_dayofweek, epoch_us(o_orderdate) * 1000 as o_orderdate_epochtime from orders",
    "filter_redundant": "select cast(p_partkey as varchar) as p_partkey, p_brand, p_type, p_size, p_retailprice from part",
    "canonicalize_types": "select cast(order_id as varchar) as order_id, try_cast(trim(created_at, e' \\t') as double) as amount_text, status, cast(trunc(case when not isnan(try_cast(trim(user_id, e' \\t') as double)) then try_cast(trim(user_id, e' \\t') as double) end) as bigint) as ticks from user_orders",
    "infer_schema": " union all ".join(f"select '{c}' as column_name, '{t}' as dtype" for c, t in [("p_partkey", PK), ("p_retailprice", FL), ("p_size", FL)]) + "".join(f" union all select '{c}', case when (select count(distinct {c}) from part) < 10 then 'category' else 'text' end" for c in ("p_name", "p_brand", "p_type")),
    "key_canonicalize": f"select distinct order_id, {_USER} as user_key from user_orders",
    "bool_agg": "select p.p_partkey, avg(cast(l_returnflag = 'R' as int)) as mean_returned, cast(sum(cast(l_returnflag = 'R' as int)) as bigint) as sum_returned, max(l_returnflag = 'R') as any_returned from part p left join lineitem on l_partkey = p.p_partkey group by 1",
    "pipeline_e2e": "select t.event_id, coalesce(a.n, 0) as n, a.m as max_month, a.h as max_hour from events t left join (select t.event_id, count(*) as n, max(month(h.ts)) as m, max(hour(h.ts)) as h from events t join events h on h.user_id = t.user_id and h.ts < t.ts group by 1) a on a.event_id = t.event_id",
    "incremental_stream": "select user_id, count(*) as n, count(value) as n_values, cast(sum(cast(value as decimal(18,4))) as varchar) as total, min(value) as low, max(value) as high from events where user_id is not null group by user_id",
    "rdb_save_load": "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice from orders",
    "rdb_save_load_npz": "select cast(n_nationkey as varchar) as n_nationkey, cast(n_regionkey as varchar) as n_regionkey, n_name from nation",
    "create_rdb_inferred": " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, {k} as dtype, {link} as link_to, {at} as time_column"
        for t, c, k, link, at in [
            ("customer", "c_custkey", "'primary_key'", "null", "null"), ("customer", "c_nationkey", "'float'", "null", "null"), ("customer", "c_acctbal", "'float'", "null", "null"),
            *[("customer", c, f"case when (select count(distinct {c}) from customer) < 10 then 'category' else 'text' end", "null", "null") for c in ("c_name", "c_mktsegment")],
            ("orders", "o_orderkey", "'primary_key'", "null", "'o_orderdate'"), ("orders", "o_custkey", "'foreign_key'", "'customer.c_custkey'", "'o_orderdate'"), ("orders", "o_orderdate", "'datetime'", "null", "'o_orderdate'"), ("orders", "o_totalprice", "'float'", "null", "'o_orderdate'"),
            *[("orders", c, f"case when (select count(distinct {c}) from orders) < 10 then 'category' else 'text' end", "null", "'o_orderdate'") for c in ("o_orderstatus", "o_orderpriority")],
        ]
    ),
    "key_types": "select cast(c_custkey as varchar) as c_custkey, cast(c_nationkey as varchar) as c_nationkey from customer",
    "agg_moments": f"select p.p_partkey, a.skew_qty from part p left join (select l_partkey, {_SHAPE_SQL} from (select l_partkey, l_quantity - avg(l_quantity) over (partition by l_partkey) as d from lineitem) group by 1) a on a.l_partkey = p.p_partkey",
    "agg_kurtosis": f"select p.p_partkey, a.kurt_qty from part p left join (select l_partkey, {_SHAPE_SQL} from (select l_partkey, l_quantity - avg(l_quantity) over (partition by l_partkey) as d from lineitem) group by 1) a on a.l_partkey = p.p_partkey",
    "agg_any_value": _BY_PART.format("min(l.l_returnflag) as any_flag, min(l.l_quantity) as any_qty"),
    "agg_product": "select n.n_nationkey, product(s.s_acctbal) as product from nation n left join supplier s on s.s_nationkey = n.n_nationkey group by 1",
    "agg_own_primitive": _BY_PART.format("max(l.l_quantity) - min(l.l_quantity) as span_qty"),
    "agg_arrays": "select cast(label as varchar) as label, cast(pos - 1 as int) as pos, cast(max(x) as double) as high, cast(min(x) as double) as low, round(avg(cast(x as double)), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2",
    "include_entities": " union all ".join(f"select '{n}' as feature" for n in ["customer.c_name", "customer.c_acctbal", "customer.c_mktsegment", "customer.COUNT(orders)"]),
    "ignore_entities": " union all ".join(f"select '{n}' as feature" for n in ["customer.c_name", "customer.c_acctbal", "customer.c_mktsegment", "customer.nation.n_name", "customer.COUNT(orders)"]),
    "apply_helpers": "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, cast(quarter(o_orderdate) as double) as o_orderdate_quarter, cast(dayofyear(o_orderdate) as double) as o_orderdate_dayofyear, o_totalprice from orders",
    "epoch_of_null": "select user_id, epoch_us(deleted_at) * 1000 as epoch, year(deleted_at) as year from users",
    "update_table": "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderdate from orders",
    "ddl": """select 'region' as table_name, 'CREATE TABLE "region" (\n  "r_regionkey" VARCHAR PRIMARY KEY,\n  "r_name" VARCHAR\n)' as statement
        union all select 'nation', 'CREATE TABLE "nation" (\n  "n_nationkey" VARCHAR PRIMARY KEY,\n  "n_regionkey" VARCHAR,\n  "n_name" VARCHAR,\n  FOREIGN KEY ("n_regionkey") REFERENCES "region" ("r_regionkey")\n)'""",
    "sqlite_source": "select o.o_orderkey, c.c_acctbal, a.n, a.m as max_price from orders o left join customer c on c.c_custkey = o.o_custkey left join (select o_custkey, count(*) as n, max(o_totalprice) as m from orders group by 1) a on a.o_custkey = o.o_custkey",
    "table_dict_source": "select o_orderkey, o_custkey, cast((o_orderkey % 50) * 3600 + 1815 as double) as time from orders",
    "array_source": "select o_orderkey, case when o_custkey % 7 <> 0 then cast(o_custkey as varchar) end as userId, o_totalprice, o_totalprice as label from orders",
    "cutoff_nunique": _CUT.format("coalesce(a.n_quantities, null) as n_quantities, a.n_flags", "count(distinct h.l_quantity) as n_quantities, count(distinct h.l_returnflag) as n_flags"),
    "cutoff_moments": f"select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_shipdate, round(a.skew_qty + 3.1e-8, 5) + 0.0 as skew_qty, round(a.kurt_qty + 3.1e-8, 5) + 0.0 as kurt_qty from lineitem t left join (select l_partkey, l_shipdate, {_SHAPE_SQL} from (select x.l_partkey, x.l_shipdate, h.l_quantity - avg(h.l_quantity) over (partition by x.l_partkey, x.l_shipdate) as d from (select distinct l_partkey, l_shipdate from lineitem) x join lineitem h on h.l_partkey = x.l_partkey and h.l_shipdate < x.l_shipdate) group by 1, 2) a on a.l_partkey = t.l_partkey and a.l_shipdate = t.l_shipdate",
    "cutoff_first_last": _CUT.format("a.f as first_qty, a.l as last_qty, a.y as any_flag", "(min({'t': h.l_shipdate, 'q': h.l_quantity})).q as f, (max({'t': h.l_shipdate, 'q': h.l_quantity})).q as l, min(h.l_returnflag) as y"),
    "cutoff_hot": """with line as (select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then 1 else l_partkey end as l_partkey, l_shipdate, l_quantity, l_returnflag from lineitem),
        pairs as (select x.l_partkey, x.l_shipdate, h.l_quantity, h.l_returnflag from (select distinct l_partkey, l_shipdate from line) x join line h on h.l_partkey = x.l_partkey and h.l_shipdate < x.l_shipdate),
        a as (select l_partkey, l_shipdate, count(*) as n, avg(l_quantity) as mean_qty, stddev_samp(l_quantity) as std_qty, median(l_quantity) as median_qty, count(distinct l_quantity) as n_quantities from pairs group by 1, 2),
        b as (select l_partkey, l_shipdate, l_returnflag as mode_flag from (select l_partkey, l_shipdate, l_returnflag, row_number() over (partition by l_partkey, l_shipdate order by count(*) desc, l_returnflag) as r from pairs group by 1, 2, 3) where r = 1)
        select t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_shipdate, coalesce(a.n, 0) as n, a.mean_qty, a.std_qty, a.median_qty, a.n_quantities, b.mode_flag from line t left join a using (l_partkey, l_shipdate) left join b using (l_partkey, l_shipdate)""",
}
ORACLES |= {n: ORACLES[n.rsplit("_", 1)[0]] for n in ("cutoff_depth3_auto", "cutoff_quantile_window", "cutoff_quantile_auto", "cutoff_nunique_window", "cutoff_moments_window", "cutoff_first_last_window")}
ORACLES |= {"duckdb_source": ORACLES["sqlite_source"], "connection_source": ORACLES["sqlite_source"], "infer_transform": ORACLES["create_rdb_inferred"]}
ORACLES |= {"cutoff_auto": ORACLES["cutoff_stats"], "cutoff_std_window": ORACLES["cutoff_std"], "cutoff_mode_window": ORACLES["cutoff_mode"]}

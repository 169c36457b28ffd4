"""SQL databases as sources: SQLite and DuckDB files and open connections through Python clients, servers through JDBC.

What a Python client reads passes the driver in batches of `ROWS_PER_BATCH` rows; tables of more than one batch are
written to the shared folder as they are read, so the driver never holds a whole table.
"""

from __future__ import annotations

import logging
import re
import sqlite3
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootstock.functions.storage import checkpoint_dir
from rootstock.rdb import Rdb, create_rdb
from rootstock.schema import ColumnType

log = logging.getLogger(__name__)
ROWS_PER_BATCH = 200_000
ForeignKey = tuple[str, str, str, str]


def staged(spark: SparkSession, batches: Iterator[pa.Table]) -> DataFrame:
    """Batches of one schema as a DataFrame: the only one as it is, several by way of the shared folder."""
    first = next(batches)
    second = next(batches, None)
    if second is None:
        return spark.createDataFrame(first)
    where = f"{checkpoint_dir(spark)}/read-{uuid.uuid4().hex}"
    for b in chain((first, second), batches):
        spark.createDataFrame(b).write.mode("append").parquet(where)
    return spark.read.parquet(where)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass
class Discovered:
    """What a database tells about one table."""

    types: dict[str, ColumnType] = field(default_factory=dict)
    primary_key: str | None = None
    #: (column, parent table, parent column); single-column keys only
    foreign_keys: list[tuple[str, str, str]] = field(default_factory=list)


# SQL type names by semantic type. Others are text. INTERVAL is text, not a number.
_SQL_TYPES = {
    ColumnType.DATETIME: {"DATE", "DATETIME", "TIMESTAMP", "TIMESTAMPTZ", "TIMESTAMP_NS", "TIMESTAMP_MS", "TIMESTAMP_S", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITHOUT TIME ZONE"},
    ColumnType.FLOAT: {
        "TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT", "UHUGEINT", "INT2", "INT4", "INT8", "SERIAL", "BIGSERIAL",
        "FLOAT", "FLOAT4", "FLOAT8", "REAL", "DOUBLE", "DOUBLE PRECISION", "NUMERIC", "DECIMAL",
    },
    ColumnType.CATEGORY: {"BOOLEAN", "BOOL", "ENUM"},
}


def semantic_type(sql_type: str) -> ColumnType:
    """Semantic type of an SQL type name, without its length or precision."""
    bare = re.sub(r"\s*\(.*?\)", "", sql_type).strip().upper().removesuffix(" UNSIGNED")
    return next((t for t, names in _SQL_TYPES.items() if bare in names), ColumnType.TEXT)


class SqlAdapter(ABC):
    """Reads tables, discovers keys and types, and lets the user's hints win.

    The time column of a table is its first datetime column unless given.  `tables` restricts what is
    read; names that don't exist give a warning.  Of a key of several columns, the first counts as primary key; links of several columns are left out.  Links to tables that aren't read are kept only where all tables are.
    """

    def __init__(
        self,
        name: str,
        tables: Iterable[str] | None = None,
        primary_keys: Mapping[str, str] | None = None,
        foreign_keys: Iterable[ForeignKey] | None = None,
        time_columns: Mapping[str, str] | None = None,
        type_hints: Mapping[str, Mapping[str, str]] | None = None,
        spark: SparkSession | None = None,
    ):
        self.name, self.wanted = name, None if tables is None else list(tables)
        self.primary_keys, self.foreign_keys = dict(primary_keys or {}), list(foreign_keys or [])
        self.time_columns, self.type_hints = dict(time_columns or {}), {t: dict(h) for t, h in (type_hints or {}).items()}
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    @abstractmethod
    def table_names(self) -> list[str]: ...

    @abstractmethod
    def discover(self, table: str) -> Discovered: ...

    @abstractmethod
    def read(self, table: str) -> DataFrame: ...

    def load(self) -> Rdb:
        there = self.table_names()
        if self.wanted is not None and (missing := [t for t in self.wanted if t not in there]):
            log.warning("tables %s are not in the database", missing)
        names = [t for t in there if self.wanted is None or t in self.wanted]
        found = {t: self.discover(t) for t in names}
        primary = {t: d.primary_key for t, d in found.items() if d.primary_key} | {t: k for t, k in self.primary_keys.items() if t in names}
        times, hints = {}, {}
        links = dict.fromkeys((t, c, p, k) for t, d in found.items() for c, p, k in d.foreign_keys if p in names or self.wanted is None)
        links |= dict.fromkeys(tuple(x) for x in self.foreign_keys if x[0] in names)
        linked = {(t, c) for t, c, _, _ in links}
        for t, d in found.items():
            if first := next((c for c, k in d.types.items() if k == ColumnType.DATETIME), None):
                times[t] = first
            hints[t] = {c: k for c, k in d.types.items() if c != primary.get(t) and (t, c) not in linked} | self.type_hints.get(t, {})
        times |= {t: c for t, c in self.time_columns.items() if t in names}
        return create_rdb({t: self.read(t) for t in names}, self.name, primary, list(links), times, hints)


class _Rows:
    """Batches of a DB-API cursor's rows. A column's type must hold in all batches, so it is given beforehand."""

    @staticmethod
    def batches(cursor: Any, types: Mapping[str, pa.DataType]) -> Iterator[pa.Table]:
        names = [d[0] for d in cursor.description]
        schema = pa.schema([(n, types.get(n, pa.string())) for n in names])
        some = False
        while rows := cursor.fetchmany(ROWS_PER_BATCH):
            some = True
            yield pa.table([_column([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        if not some:
            yield schema.empty_table()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind):
        times = pd.to_datetime(pd.Series(values, dtype=object), errors="coerce", format="mixed", utc=True).dt.tz_localize(None)
        return pa.Array.from_pandas(times.astype("datetime64[us]"), type=kind)
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], kind)
    if pa.types.is_floating(kind):
        numbers = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce")
        return pa.Array.from_pandas(numbers.astype("float64"), type=kind)
    return pa.array(values, kind)


class SQLiteAdapter(SqlAdapter):
    """A SQLite file, read on the driver in batches. A column has the type that all its values have, as SQLite keeps types by value."""

    def __init__(self, database_path: str | Path, tables: Iterable[str] | None = None, name: str | None = None, **hints):
        self.path = Path(database_path)
        if not self.path.exists():
            raise FileNotFoundError(f"SQLite database not found: {self.path}")
        super().__init__(name or self.path.stem, tables, **hints)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"{self.path.resolve().as_uri()}?mode=ro", uri=True)

    def _rows(self, sql: str, *args) -> list[tuple]:
        with self._open() as c:
            return c.execute(sql, args).fetchall()

    def table_names(self) -> list[str]:
        return [r[0] for r in self._rows("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by rowid")]

    def discover(self, table: str) -> Discovered:
        columns = self._rows("select name, type, pk from pragma_table_info(?)", table)
        keys = sorted((pk, n) for n, _, pk in columns if pk)
        links = self._rows('select id, seq, "from", "table", "to" from pragma_foreign_key_list(?) order by id, seq', table)
        single = [x for x in links if sum(y[0] == x[0] for y in links) == 1]
        to = lambda parent, column: column or next((n for _, n in sorted((pk, n) for n, pk in self._rows("select name, pk from pragma_table_info(?)", parent) if pk)), None)
        return Discovered({n: semantic_type(t) for n, t, _ in columns}, keys[0][1] if keys else None, [(c, p, to(p, k)) for _, _, c, p, k in single])

    def _types(self, table: str) -> dict[str, pa.DataType]:
        """From one scan: whole numbers, numbers, bytes, else text; declared datetimes as times."""
        columns = self._rows("select name, type from pragma_table_info(?)", table)
        every = lambda n, kinds: f"coalesce(min(typeof({quoted(n)}) in ({kinds}, 'null')), 1) * (count({quoted(n)}) > 0)"
        told = self._rows("select " + ", ".join(every(n, k) for n, _ in columns for k in ("'integer'", "'integer', 'real'", "'blob'")) + f" from {quoted(table)}")[0]
        out = {}
        for i, (n, declared) in enumerate(columns):
            whole, number, raw = told[3 * i : 3 * i + 3]
            time = semantic_type(declared) == ColumnType.DATETIME
            out[n] = pa.timestamp("us") if time else pa.int64() if whole else pa.float64() if number else pa.binary() if raw else pa.string()
        return out

    def read(self, table: str) -> DataFrame:
        with self._open() as c:
            df = staged(self.spark, _Rows.batches(c.execute(f"select * from {quoted(table)}"), self._types(table)))
        return _without_zone(df)


def _without_zone(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


class ConnectionAdapter(SqlAdapter):
    """Any open DB-API connection of the user: tables and types from its information schema, or from what it returns where it has none.

    Keys come from the hints, and so do types where there is no information schema: what isn't hinted is text.  `tables` must be given where there is no information schema.
    """

    def __init__(self, connection: Any, name: str = "rdb", tables: Iterable[str] | None = None, **hints):
        self.connection = connection
        super().__init__(name, tables, **hints)

    def _query(self, sql: str) -> list[tuple] | None:
        cursor = self.connection.cursor()
        try:
            cursor.execute(sql)
            return cursor.fetchall()
        except Exception as e:
            log.info("no information schema: %s", e)
            return None

    def table_names(self) -> list[str]:
        found = self._query("select table_name from information_schema.tables where table_type = 'BASE TABLE' and table_schema not in ('information_schema', 'pg_catalog') order by table_name")
        if found is None and self.wanted is None:
            raise ValueError("the connection doesn't list its tables: give their names")
        return self.wanted if found is None else [r[0] for r in found]

    def discover(self, table: str) -> Discovered:
        found = self._query(f"select column_name, data_type from information_schema.columns where table_name = {literal(table)} order by ordinal_position")
        return Discovered({n: semantic_type(t) for n, t in found or []})

    def read(self, table: str) -> DataFrame:
        declared = self.discover(table).types | {c: ColumnType(k) for c, k in self.type_hints.get(table, {}).items()}
        cursor = self.connection.cursor()
        cursor.execute(f"select * from {quoted(table)}")
        kinds = {ColumnType.DATETIME: pa.timestamp("us"), ColumnType.FLOAT: pa.float64()}
        return _without_zone(staged(self.spark, _Rows.batches(cursor, {n: kinds.get(k, pa.string()) for n, k in declared.items()})))


class DuckDBAdapter(SqlAdapter):
    """A DuckDB file, read as Arrow on the driver in batches."""

    def __init__(self, database_path: str | Path, tables: Iterable[str] | None = None, name: str | None = None, **hints):
        import duckdb

        self.path = Path(database_path)
        if not self.path.exists():
            raise FileNotFoundError(f"DuckDB database not found: {self.path}")
        self._connect = lambda: duckdb.connect(str(self.path), read_only=True)
        super().__init__(name or self.path.stem, tables, **hints)

    def _rows(self, sql: str, args: list | None = None) -> list[tuple]:
        c = self._connect()
        try:
            return c.execute(sql, args or []).fetchall()
        finally:
            c.close()

    def table_names(self) -> list[str]:
        return [r[0] for r in self._rows("select table_name from information_schema.tables where table_schema = 'main' and table_type = 'BASE TABLE' order by table_name")]

    def discover(self, table: str) -> Discovered:
        columns = self._rows("select column_name, data_type from information_schema.columns where table_schema = 'main' and table_name = ? order by ordinal_position", [table])
        keys = self._rows("select constraint_type, constraint_column_names, referenced_table, referenced_column_names from duckdb_constraints() where schema_name = 'main' and table_name = ?", [table])
        primary = next((names[0] for kind, names, _, _ in keys if kind == "PRIMARY KEY"), None)
        links = [(a[0], parent, b[0]) for kind, a, parent, b in keys if kind == "FOREIGN KEY" and len(a) == 1]
        return Discovered({n: semantic_type(t) for n, t in columns}, primary, links)

    def read(self, table: str) -> DataFrame:
        c = self._connect()
        try:
            found = c.execute(f"select * from {quoted(table)}")
            reader = found.to_arrow_reader(ROWS_PER_BATCH) if hasattr(found, "to_arrow_reader") else found.fetch_record_batch(ROWS_PER_BATCH)
            batches = (pa.Table.from_batches([b]) for b in reader if b.num_rows)
            first = next(batches, reader.schema.empty_table())
            df = staged(self.spark, chain([first], batches))
        finally:
            c.close()
        return _without_zone(df)


class JdbcAdapter(SqlAdapter):
    """A database server through JDBC; the user adds the driver's jar.

    Keys come from information-schema queries, read through the same connection; types from the schema that
    JDBC reports.  Reads are split by the primary key where it is a number: into parts of about `rows_per_part` values between
    its least and greatest.  `partitions` (table -> (numeric column, lower, upper, count)) sets this outright.
    """

    #: What a subclass fixes.
    protocol, driver, scheme, mark = "", "", "", '"'

    def __init__(self, connection_string: str, tables: Iterable[str] | None = None, name: str | None = None, schema: str | None = None, partitions: Mapping[str, tuple[str, int, int, int]] | None = None, rows_per_part: int = 1_000_000, fetch_size: int = 10_000, **hints):
        self.rows_per_part, self.fetch_size = rows_per_part, fetch_size
        self.url, self.options = self.jdbc_url(connection_string)
        self.database = unquote(urlsplit(connection_string.removeprefix("jdbc:")).path.lstrip("/"))
        self.schema, self.partitions = schema, dict(partitions or {})
        super().__init__(name or f"{self.scheme}_rdb", tables, **hints)

    @classmethod
    def jdbc_url(cls, text: str) -> tuple[str, dict[str, str]]:
        """(JDBC URL without credentials, connection options) of scheme[+driver]://user:password@host:port/database."""
        parts = urlsplit(text.removeprefix("jdbc:"))
        options = {"driver": cls.driver} | dict(parse_qsl(parts.query))
        if parts.username:
            options["user"] = unquote(parts.username)
        if parts.password:
            options["password"] = unquote(parts.password)
        host = (parts.hostname or "localhost") + (f":{parts.port}" if parts.port else "")
        return f"jdbc:{cls.protocol}://{host}{parts.path}", options

    def _query(self, sql: str) -> list[tuple]:
        return [tuple(r) for r in self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load().collect()]

    @property
    @abstractmethod
    def home(self) -> str:
        """The schema that tables are listed in, as information_schema names it."""

    def qualified(self, table: str) -> str:
        return ".".join(self.quote(x) for x in ([self.schema] if self.schema else []) + [table])

    def quote(self, name: str) -> str:
        return self.mark + name.replace(self.mark, 2 * self.mark) + self.mark

    def table_names(self) -> list[str]:
        return [r[0] for r in self._query(f"select table_name from information_schema.tables where table_schema = {literal(self.home)} and table_type = 'BASE TABLE' order by table_name")]

    def discover(self, table: str) -> Discovered:
        columns = self._query(f"select column_name, data_type from information_schema.columns where table_schema = {literal(self.home)} and table_name = {literal(table)} order by ordinal_position")
        keys = self._query(self.keys_sql(table))
        primary = next((c for kind, c, *_ in keys if kind == "PRIMARY KEY"), None)
        links = [k for k in keys if k[0] == "FOREIGN KEY"]
        single = [(c, p, k) for _, c, p, k, name in links if sum(x[4] == name for x in links) == 1]
        return Discovered({n: semantic_type(t) for n, t in columns}, primary, single)

    @abstractmethod
    def keys_sql(self, table: str) -> str:
        """Rows (constraint type, column, parent table, parent column, constraint name) in key order."""

    def parts(self, table: str) -> tuple[str, int, int, int] | None:
        """(column, lower, upper, count) of a split read, or None where one part is enough or the key is no number."""
        if table in self.partitions:
            return self.partitions[table]
        found = self.discover(table)
        key = self.primary_keys.get(table) or found.primary_key
        if not key or found.types.get(key) != ColumnType.FLOAT:
            return None
        low, high = self._query(f"select min({self.quote(key)}), max({self.quote(key)}) from {self.qualified(table)}")[0]
        if low is None or (n := -(-(int(high) - int(low) + 1) // self.rows_per_part)) < 2:
            return None
        return key, int(low), int(high) + 1, min(n, 10_000)

    def read(self, table: str) -> DataFrame:
        r = self.spark.read.format("jdbc").options(url=self.url, dbtable=self.qualified(table), fetchsize=self.fetch_size, **self.options)
        if found := self.parts(table):
            column, low, high, n = found
            r = r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
        return r.load()


class MySQLAdapter(JdbcAdapter):
    protocol, driver, scheme, mark = "mysql", "com.mysql.cj.jdbc.Driver", "mysql", "`"

    @property
    def home(self) -> str:
        return self.schema or self.database

    def keys_sql(self, table: str) -> str:
        return f"""select t.constraint_type, k.column_name, k.referenced_table_name, k.referenced_column_name, k.constraint_name
            from information_schema.key_column_usage k join information_schema.table_constraints t
            on t.constraint_schema = k.constraint_schema and t.constraint_name = k.constraint_name and t.table_schema = k.table_schema and t.table_name = k.table_name
            where k.table_schema = {literal(self.home)} and k.table_name = {literal(table)} order by k.constraint_name, k.ordinal_position"""


class PostgreSQLAdapter(JdbcAdapter):
    protocol, driver, scheme, mark = "postgresql", "org.postgresql.Driver", "postgresql", '"'

    @property
    def home(self) -> str:
        return self.schema or "public"

    def keys_sql(self, table: str) -> str:
        return f"""select t.constraint_type, k.column_name, u.table_name, u.column_name, k.constraint_name
            from information_schema.key_column_usage k join information_schema.table_constraints t
            on t.constraint_schema = k.constraint_schema and t.constraint_name = k.constraint_name and t.table_schema = k.table_schema and t.table_name = k.table_name
            left join information_schema.constraint_column_usage u on u.constraint_schema = k.constraint_schema and u.constraint_name = k.constraint_name
            where k.table_schema = {literal(self.home)} and k.table_name = {literal(table)} order by k.constraint_name, k.ordinal_position"""

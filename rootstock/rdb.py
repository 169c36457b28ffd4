"""The relational database: named lazy DataFrames with a semantic schema. Immutable; every change gives a new one."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.inference import CATEGORY_THRESHOLD, infer_types, instant, number
from rootstock.functions.keys import key_text
from rootstock.schema import ColumnSchema, ColumnType, RdbMeta, Relationship, TableFormat, TableSchema
from rootstock.sources.files import exists, read_bytes, read_table, write_bytes, write_table

log = logging.getLogger(__name__)
ForeignKey = tuple[str, str, str, str]


def as_spark(df: DataFrame | pd.DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A Spark DataFrame; pandas frames go through Arrow, where NaN of nullable columns becomes NULL. The caller's frame stays as it is."""
    if not isinstance(df, pd.DataFrame):
        return df
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    plain = df.reset_index(drop=True)
    mixed = {}
    for c in plain.columns:
        if plain[c].dtype == object:
            held = plain[c].dropna()
            if len({type(x) for x in held}) > 1 and all(isinstance(x, (str, int, float, bool)) for x in held):
                mixed[c] = plain[c].map(lambda x: None if pd.isna(x) else str(x))
            elif not len(held):
                mixed[c] = pd.Series([None] * len(plain), dtype="string")
    plain = plain.assign(**mixed) if mixed else plain
    import pyarrow as pa

    out = spark.createDataFrame(pa.Table.from_pandas(plain, preserve_index=False))
    floats = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    void = [f.name for f in out.schema.fields if isinstance(f.dataType, T.NullType)]
    times = [f.name for f in out.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return out.withColumns(
        {c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats} | {c: F.lit(None).cast("double") for c in void} | {c: F.col(f"`{c}`").cast("timestamp_ntz") for c in times}
    )


@dataclass(frozen=True)
class Rdb:
    """Tables by name and their schemas."""

    metadata: RdbMeta
    tables: Mapping[str, DataFrame]

    # --- reading and writing

    @classmethod
    def load(cls, path: str | Path, spark: SparkSession | None = None, allow_pickle: bool = False) -> Rdb:
        """Reads metadata.yaml and each table's declared columns; float and datetime columns are coerced, bad values become NULL."""
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        if not exists(spark, f"{path}/metadata.yaml"):
            raise FileNotFoundError(f"{path}/metadata.yaml does not exist")
        meta = RdbMeta.from_dict(yaml.safe_load(read_bytes(spark, f"{path}/metadata.yaml")))
        tables = {}
        for t in meta.tables:
            where = f"{path}/{t.source}"
            if not exists(spark, where):
                raise FileNotFoundError(f"data of table {t.name} not found: {where}")
            df = read_table(spark, where, t.format, allow_pickle)
            if missing := [c.name for c in t.columns if c.name not in df.columns]:
                raise ValueError(f"columns {missing} of table {t.name} not found in {where}")
            tables[t.name] = _coerced(df, t)
        return cls(meta, tables)

    def save(self, path: str | Path, fmt: TableFormat = TableFormat.PARQUET) -> None:
        """Writes one file or folder per table and metadata.yaml whose sources name these."""
        suffix, written = "npz" if fmt == TableFormat.NUMPY else "parquet", []
        for t in self.metadata.tables:
            write_table(self.tables[t.name], f"{path}/{t.name}.{suffix}", fmt)
            written.append(replace(t, source=f"{t.name}.{suffix}", format=fmt))
        text = yaml.safe_dump(RdbMeta(self.metadata.name, written).to_dict(), sort_keys=False)
        write_bytes(next(iter(self.tables.values())).sparkSession, f"{path}/metadata.yaml", text.encode())

    # --- looking up

    @property
    def table_names(self) -> list[str]:
        return [t.name for t in self.metadata.tables]

    def get_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"Table {name} not found: there are {self.table_names}")
        return self.tables[name]

    get_table_dataframe = get_table

    def get_table_metadata(self, name: str) -> TableSchema:
        return self.metadata.get_table_schema(name)

    def get_relationships(self) -> list[Relationship]:
        return self.metadata.relationships

    @property
    def ddl(self) -> dict[str, str]:
        """CREATE TABLE per table: float -> DOUBLE, datetime -> TIMESTAMP, else VARCHAR; keys as constraints. An FK to an undeclared parent is kept as a comment."""
        kinds = {ColumnType.FLOAT: "DOUBLE", ColumnType.DATETIME: "TIMESTAMP"}
        out = {}
        for t in self.metadata.tables:
            lines = [f'  "{c.name}" {kinds.get(c.dtype, "VARCHAR")}' + " PRIMARY KEY" * (c.name == t.primary_key) for c in t.columns]
            notes = []
            for c in t.foreign_keys:
                parent, column = c.link
                line = f'FOREIGN KEY ("{c.name}") REFERENCES "{parent}" ("{column}")'
                (lines.append(f"  {line}") if parent in self.table_names else notes.append(f"-- {line}"))
            out[t.name] = f'CREATE TABLE "{t.name}" (\n' + ",\n".join(lines) + "\n)" + "".join(f"\n{n}" for n in notes)
        return out

    @property
    def sqlalchemy_metadata(self):
        """The same as a MetaData object of SQLAlchemy, where that is installed."""
        try:
            import sqlalchemy as sa
        except ImportError as e:
            raise ImportError("sqlalchemy isn't installed: use `ddl` or `columns`") from e
        kinds, meta = {ColumnType.FLOAT: sa.Float, ColumnType.DATETIME: sa.DateTime}, sa.MetaData()
        for t in self.metadata.tables:
            links = {c.name: sa.ForeignKey(c.link_to) for c in t.foreign_keys if c.link[0] in self.table_names}
            sa.Table(t.name, meta, *[sa.Column(c.name, kinds.get(c.dtype, sa.String)(), *[links[c.name]] * (c.name in links), primary_key=c.name == t.primary_key) for c in t.columns])
        return meta

    @property
    def columns(self) -> list[tuple[str, str, str, str | None, str | None]]:
        """(table, column, type, link, time column of the table) of every declared column."""
        return [(t.name, c.name, str(c.dtype), c.link_to, t.time_column) for t in self.metadata.tables for c in t.columns]

    # --- changing

    def update_tables(self, tables: Mapping[str, DataFrame | pd.DataFrame], metadata: Mapping[str, TableSchema]) -> Rdb:
        """New tables and replacements. Both mappings need the same names; every data column must be declared."""
        if set(tables) != set(metadata):
            raise ValueError(f"tables {sorted(tables)} and schemas {sorted(metadata)} must have the same names")
        data, schemas = dict(self.tables), {t.name: t for t in self.metadata.tables}
        for name, df in tables.items():
            df = as_spark(df)
            if metadata[name].name != name:
                raise ValueError(f"the schema given for {name} is that of {metadata[name].name}")
            if extra := [c for c in df.columns if c not in metadata[name].column_dict]:
                raise ValueError(f"columns {extra} of table {name} are not in its schema")
            data[name], schemas[name] = df, metadata[name]
        return Rdb(RdbMeta(self.metadata.name, list(schemas.values())), data)

    def update_table(self, name: str, df: DataFrame | pd.DataFrame, schema: TableSchema) -> Rdb:
        return self.update_tables({name: df}, {name: schema})

    def add_table(
        self,
        df: DataFrame | pd.DataFrame,
        name: str,
        time_column: str | None = None,
        primary_key: str | None = None,
        foreign_keys: Iterable[tuple[str, str, str]] | None = None,
        column_types: Mapping[str, str] | None = None,
    ) -> Rdb:
        """A further table, types inferred. foreign_keys: (column, parent table, parent column); the parent need not exist."""
        if name in self.table_names:
            raise ValueError(f"Table {name} already exists")
        df = as_spark(df)
        links = {c: f"{p}.{k}" for c, p, k in foreign_keys or []}
        schema = infer_schema(df, TableSchema(name), primary_key, links, time_column, column_types)
        return self.update_tables({name: df.select(*[f"`{c.name}`" for c in schema.columns])}, {name: schema})

    # --- keys

    def validate_key_consistency(self) -> None:
        """All key columns that meet in a parent must be stored alike, the parent's included."""
        groups: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
        for child, column, parent, pk in self.get_relationships():
            groups[parent, pk].append((child, column))
        for (parent, pk), members in groups.items():
            if parent in self.tables and pk in self.tables[parent].columns:
                members = [(parent, pk), *members]
            kinds = {f"{t}.{c}": self.tables[t].schema[c].dataType.simpleString() for t, c in members if t in self.tables and c in self.tables[t].columns}
            if len(set(kinds.values())) > 1:
                raise TypeError(f"keys that refer to {parent}.{pk} have different types: {kinds}")

    def canonicalize_key_types(self) -> Rdb:
        """All keys as strings; NULL stays NULL; a float key is an error."""
        tables = {}
        for t in self.metadata.tables:
            df = self.tables[t.name]
            casts = {}
            for c in t.columns:
                if c.dtype in (ColumnType.PRIMARY_KEY, ColumnType.FOREIGN_KEY) and c.name in df.columns and not isinstance(df.schema[c.name].dataType, T.StringType):
                    try:
                        casts[c.name] = key_text(F.col(f"`{c.name}`"), df.schema[c.name].dataType)
                    except ValueError as e:
                        raise ValueError(f"{t.name}.{c.name}: {e}") from None
            tables[t.name] = df.withColumns(casts) if casts else df
        return Rdb(self.metadata, tables)


def _coerced(df: DataFrame, t: TableSchema) -> DataFrame:
    """Declared columns in their order, float and datetime ones coerced."""
    out = []
    for c in t.columns:
        col, kind = F.col(f"`{c.name}`"), df.schema[c.name].dataType
        col = number(col, kind) if c.dtype == ColumnType.FLOAT else instant(col, kind) if c.dtype == ColumnType.DATETIME else col
        out.append(col.alias(c.name))
    return df.select(*out)


def infer_schema(
    df: DataFrame,
    known: TableSchema,
    primary_key: str | None = None,
    links: Mapping[str, str] | None = None,
    time_column: str | None = None,
    hints: Mapping[str, str] | None = None,
    category_threshold: int = CATEGORY_THRESHOLD,
) -> TableSchema:
    """The table's schema, with what `known` declares kept. Columns named like "Unnamed: 0" are left out."""
    declared = known.column_dict
    primary_key = primary_key or known.primary_key
    time_column = time_column or known.time_column
    links = {c.name: c.link_to for c in known.foreign_keys if c.link_to} | dict(links or {})
    for role, c in [("primary key", primary_key), ("time column", time_column), *[("foreign key", x) for x in links]]:
        if c and c not in df.columns:
            raise ValueError(f"{role} {c} is not a column of table {known.name}")
    hints = {c.name: c.dtype for c in known.columns if c.dtype} | dict(hints or {})
    kept = df.select(*[f"`{c}`" for c in df.columns if "Unnamed" not in c])
    types = infer_types(kept, primary_key, links, time_column, hints, category_threshold)
    if primary_key is None and not links:
        log.warning("table %s has no keys: it takes part in no feature", known.name)
    columns = [ColumnSchema(c, t, links.get(c) if t == ColumnType.FOREIGN_KEY else None, declared[c].extra if c in declared else {}) for c, t in types.items()]
    return replace(known, columns=tuple(columns), time_column=time_column)


def create_rdb(
    tables: Mapping[str, DataFrame | pd.DataFrame],
    name: str = "rdb",
    primary_keys: Mapping[str, str] | None = None,
    foreign_keys: Iterable[ForeignKey] | None = None,
    time_columns: Mapping[str, str] | None = None,
    type_hints: Mapping[str, Mapping[str, str]] | None = None,
    category_threshold: int = CATEGORY_THRESHOLD,
) -> Rdb:
    """An Rdb from Spark or pandas frames. Keys and time columns are given, all other types inferred unless hinted."""
    frames = {n: as_spark(df) for n, df in tables.items()}
    links: dict[str, dict[str, str]] = defaultdict(dict)
    for child, column, parent, pk in foreign_keys or []:
        if child not in frames:
            raise ValueError(f"foreign key of unknown table {child}")
        links[child][column] = f"{parent}.{pk}"
    for given, what in ((primary_keys, "primary key"), (time_columns, "time column"), (type_hints, "type hints")):
        if unknown := set(given or {}) - set(frames):
            raise ValueError(f"{what} given for unknown tables {sorted(unknown)}")
    schemas = {
        n: infer_schema(df, TableSchema(n), (primary_keys or {}).get(n), links[n], (time_columns or {}).get(n), (type_hints or {}).get(n), category_threshold)
        for n, df in frames.items()
    }
    data = {n: df.select(*[f"`{c.name}`" for c in schemas[n].columns]) for n, df in frames.items()}
    data = {n: _floats_clean(df, schemas[n]) for n, df in data.items()}
    return Rdb(RdbMeta(name, list(schemas.values())), data)


def _floats_clean(df: DataFrame, t: TableSchema) -> DataFrame:
    """NaN is no value: NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and t.column_dict[f.name].dtype == ColumnType.FLOAT]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df


def load_rdb(path: str | Path, spark: SparkSession | None = None) -> Rdb:
    return Rdb.load(path, spark)

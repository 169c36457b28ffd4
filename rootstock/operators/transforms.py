"""Transforms of whole databases, of tables and of columns. All are pure functions on lazy DataFrames."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.inference import CATEGORY_THRESHOLD, instant, integer, number
from rootstock.functions.keys import key_form
from rootstock.rdb import Rdb, infer_schema
from rootstock.schema import ColumnSchema, ColumnType, RdbMeta, TableSchema

log = logging.getLogger(__name__)


class RdbTransform(ABC):
    """rdb -> rdb."""

    @abstractmethod
    def __call__(self, rdb: Rdb) -> Rdb: ...


class TableTransform(ABC):
    """(df, schema) -> (df, schema)."""

    @abstractmethod
    def __call__(self, df: DataFrame, schema: TableSchema) -> tuple[DataFrame, TableSchema]: ...


class ColumnTransform(ABC):
    """One column -> the columns that go in its place, with their schemas. All columns of a table end in one select."""

    @abstractmethod
    def applies_to(self, column: ColumnSchema) -> bool: ...

    @abstractmethod
    def __call__(self, value: Column, column: ColumnSchema, dtype: T.DataType) -> list[tuple[ColumnSchema, Column]]: ...


class RdbTransformPipeline(RdbTransform):
    """One transform after the other."""

    def __init__(self, transforms: Sequence[RdbTransform]):
        self.transforms = list(transforms)

    def __call__(self, rdb: Rdb) -> Rdb:
        return reduce(lambda r, t: t(r), self.transforms, rdb)


class RdbTransformWrapper(RdbTransform):
    """Lifts a table or column transform to every table."""

    def __init__(self, inner: TableTransform | ColumnTransform):
        self.inner = inner

    def __call__(self, rdb: Rdb) -> Rdb:
        tables, schemas = {}, {}
        for t in rdb.metadata.tables:
            df = rdb.get_table(t.name)
            apply = self._columns if isinstance(self.inner, ColumnTransform) else self.inner
            tables[t.name], schemas[t.name] = apply(df, t)
        return rdb.update_tables(tables, schemas)

    def _columns(self, df: DataFrame, schema: TableSchema) -> tuple[DataFrame, TableSchema]:
        out: list[tuple[ColumnSchema, Column]] = []
        for c in schema.columns:
            value = F.col(f"`{c.name}`")
            out += self.inner(value, c, df.schema[c.name].dataType) if self.inner.applies_to(c) else [(c, value)]
        names = [c.name for c, _ in out]
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"columns {sorted(twice)} of table {schema.name} would be made twice")
        time = schema.time_column if schema.time_column in names else None
        return df.select(*[v.alias(c.name) for c, v in out]), replace(schema, columns=tuple(c for c, _ in out), time_column=time)


def apply_transform(rdb: Rdb, transform: RdbTransform | TableTransform | ColumnTransform) -> Rdb:
    return (transform if isinstance(transform, RdbTransform) else RdbTransformWrapper(transform))(rdb)


def apply_transform_pipeline(rdb: Rdb, transforms: Iterable[RdbTransform | TableTransform | ColumnTransform]) -> Rdb:
    return reduce(apply_transform, transforms, rdb)


# Parts of a datetime. epochtime counts nanoseconds since 1970; weeks start on Monday with 0. NULL gives NULL.
_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "dayofweek": F.weekday,
    "dayofyear": F.dayofyear,
    "quarter": F.quarter,
    "epochtime": lambda c: F.unix_micros(c.cast("timestamp")) * 1000,
}


class FeaturizeDatetime(ColumnTransform, RdbTransform):
    """Adds {column}_{part} as float columns for each datetime column; drops the column unless retain_original."""

    def __init__(self, features: Sequence[str] = ("year", "month", "day", "hour"), retain_original: bool = True):
        if unknown := set(features) - set(_PARTS):
            raise ValueError(f"unknown parts {sorted(unknown)}: there are {sorted(_PARTS)}")
        self.features, self.retain_original = list(features), retain_original

    def applies_to(self, column: ColumnSchema) -> bool:
        return column.dtype == ColumnType.DATETIME

    def __call__(self, value, column: ColumnSchema | None = None, dtype: T.DataType | None = None):
        if isinstance(value, Rdb):
            return RdbTransformWrapper(self)(value)
        t = instant(value, dtype)
        kept = [(column, value)] if self.retain_original else []
        return kept + [(ColumnSchema(f"{column.name}_{p}", ColumnType.FLOAT), _PARTS[p](t)) for p in self.features]


class FilterColumn(TableTransform, RdbTransform):
    """Drops columns of given types and, on demand, columns with at most one distinct value (NULL counts as one). Keys stay."""

    def __init__(self, drop_dtypes: Sequence[str] = (), drop_redundant: bool = False):
        self.drop_dtypes, self.drop_redundant = {ColumnType(d) for d in drop_dtypes}, drop_redundant

    def __call__(self, df, schema: TableSchema | None = None):
        if isinstance(df, Rdb):
            return RdbTransformWrapper(self)(df)
        keys = (ColumnType.PRIMARY_KEY, ColumnType.FOREIGN_KEY)
        kept = [c for c in schema.columns if c.dtype in keys or c.dtype not in self.drop_dtypes]
        open_columns = [c.name for c in kept if c.dtype not in keys] if self.drop_redundant else []
        if open_columns:
            # Least, greatest and a NULL tell one value from several: constant state per column, one job for the table.
            aggs = []
            for i, c in enumerate(open_columns):
                v = F.col(f"`{c}`")
                v = F.to_json(F.struct(v)) if isinstance(df.schema[c].dataType, (T.MapType, T.StructType, T.ArrayType)) else v
                aggs += [F.coalesce(F.min(v) != F.max(v), F.lit(False)).alias(f"d{i}"), F.coalesce(F.max(v.isNull()), F.lit(False)).alias(f"n{i}"), F.count(v).alias(f"c{i}")]
            row = df.agg(*aggs).first()
            redundant = {c for i, c in enumerate(open_columns) if not row[f"d{i}"] and not (row[f"n{i}"] and row[f"c{i}"])}
            kept = [c for c in kept if c.name not in redundant]
        names = [c.name for c in kept]
        time = schema.time_column if schema.time_column in names else None
        return df.select(*[f"`{n}`" for n in names]), replace(schema, columns=tuple(kept), time_column=time)


class HandleDummyTable(RdbTransform):
    """For each foreign key whose parent table is absent, makes that table of all distinct keys that refer to it."""

    def __call__(self, rdb: Rdb) -> Rdb:
        wanted: dict[str, dict[str, list[tuple[str, str]]]] = defaultdict(lambda: defaultdict(list))
        for child, column, parent, pk in rdb.get_relationships():
            if parent not in rdb.table_names:
                wanted[parent][pk].append((child, column))
        tables, schemas = {}, {}
        for parent, columns in wanted.items():
            pk = next(iter(columns))
            refs = columns[pk]
            kinds = {rdb.get_table(t).schema[c].dataType.simpleString() for t, c in refs}
            cast = (lambda c: c) if len(kinds) == 1 else (lambda c: c.cast("string"))
            keys = reduce(DataFrame.unionByName, [rdb.get_table(t).select(cast(F.col(f"`{c}`")).alias(pk)) for t, c in refs])
            tables[parent] = keys.where(F.col(f"`{pk}`").isNotNull()).distinct()
            schemas[parent] = TableSchema(parent, [ColumnSchema(pk, ColumnType.PRIMARY_KEY)])
        return rdb.update_tables(tables, schemas) if tables else rdb


class FillMissingPrimaryKey(RdbTransform):
    """Adds to each parent a row for every key that children refer to and it lacks.

    Keys are compared in key form (1691, "1691" and "1691.0" are one); new keys are written in it, as the
    parent's type if that can hold them, and existing rows stay.  Other columns: text and category "", timestamp 0,
    others NULL.
    """

    def __call__(self, rdb: Rdb) -> Rdb:
        refs: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for child, column, parent, pk in rdb.get_relationships():
            if parent in rdb.table_names and rdb.get_table_metadata(parent).primary_key == pk:
                refs[parent].append((child, column))
        if not refs:
            return rdb
        tables, schemas = {}, {}
        for parent, children in refs.items():
            schema, df = rdb.get_table_metadata(parent), rdb.get_table(parent)
            pk, kind = schema.primary_key, df.schema[schema.primary_key].dataType
            form = lambda t, c: key_form(F.col(f"`{c}`"), rdb.get_table(t).schema[c].dataType)
            used = reduce(DataFrame.unionByName, [rdb.get_table(t).select(form(t, c).alias("k")) for t, c in children]).where("k is not null").distinct()
            missing = used.join(df.select(form(parent, pk).alias("k")).where("k is not null"), "k", "left_anti")
            others = {rdb.get_table(t).schema[c].dataType.simpleString() for t, c in children}
            text = isinstance(kind, T.StringType) or others != {kind.simpleString()}
            filled = [self._fill(c, df.schema[c.name].dataType if c.name != pk else kind, pk, text) for c in schema.columns if c.name in df.columns]
            base = df.withColumn(pk, F.col(f"`{pk}`").cast("string")) if text else df
            tables[parent] = base.unionByName(missing.select(*filled), allowMissingColumns=True)
            schemas[parent] = schema
        return rdb.update_tables(tables, schemas)

    @staticmethod
    def _fill(c: ColumnSchema, kind: T.DataType, pk: str, text: bool) -> Column:
        if c.name == pk:
            return (F.col("k") if text else F.col("k").try_cast(kind)).alias(pk)
        if c.dtype in (ColumnType.TEXT, ColumnType.CATEGORY) and isinstance(kind, T.StringType):
            return F.lit("").alias(c.name)
        if c.dtype == ColumnType.TIMESTAMP:
            return F.lit(0).cast(kind).alias(c.name)
        return F.lit(None).cast(kind).alias(c.name)


class CanonicalizeTypes(TableTransform, RdbTransform):
    """Declared columns in their order, each cast to its type's storage; bad values become NULL; a missing column is an error."""

    def __call__(self, df, schema: TableSchema | None = None):
        if isinstance(df, Rdb):
            return RdbTransformWrapper(self)(df)
        if missing := [c.name for c in schema.columns if c.name not in df.columns]:
            raise ValueError(f"columns {missing} of table {schema.name} not found in its data")
        casts = {ColumnType.FLOAT: number, ColumnType.DATETIME: instant, ColumnType.TIMESTAMP: integer}
        out = []
        for c in schema.columns:
            v, kind = F.col(f"`{c.name}`"), df.schema[c.name].dataType
            out.append((casts[c.dtype](v, kind) if c.dtype in casts else v.cast("string")).alias(c.name))
        return df.select(*out), schema


class InferSchemaTransform(RdbTransform):
    """Fills in missing types, links and time columns of all tables; declared ones stay."""

    def __init__(
        self,
        primary_keys: Mapping[str, str] | None = None,
        foreign_keys: Iterable[tuple[str, str, str, str]] | None = None,
        time_columns: Mapping[str, str] | None = None,
        type_hints: Mapping[str, Mapping[str, str]] | None = None,
        category_threshold: int = CATEGORY_THRESHOLD,
    ):
        self.primary_keys, self.time_columns, self.type_hints = primary_keys or {}, time_columns or {}, type_hints or {}
        self.foreign_keys, self.category_threshold = list(foreign_keys or []), category_threshold

    def __call__(self, rdb: Rdb) -> Rdb:
        schemas, tables = [], {}
        for t in rdb.metadata.tables:
            links = {c: f"{p}.{k}" for child, c, p, k in self.foreign_keys if child == t.name}
            df = rdb.get_table(t.name)
            s = infer_schema(df, t, self.primary_keys.get(t.name), links, self.time_columns.get(t.name), self.type_hints.get(t.name), self.category_threshold)
            schemas.append(s)
            tables[t.name] = df.select(*[f"`{c.name}`" for c in s.columns])
        return Rdb(RdbMeta(rdb.metadata.name, schemas), tables)

"""Semantic types of columns, from declarations and data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.schema import ColumnType

CATEGORY_THRESHOLD = 10


def infer_types(
    df: DataFrame,
    primary_key: str | None = None,
    foreign_keys: Mapping[str, str] | None = None,
    time_column: str | None = None,
    hints: Mapping[str, str] | None = None,
    category_threshold: int = CATEGORY_THRESHOLD,
) -> dict[str, ColumnType]:
    """Type of every column: primary key, foreign key, hint, time column, then by storage.

    Dates and timestamps are datetime; numbers and booleans float; a string column with fewer than
    `category_threshold` distinct values (NULL isn't one) is a category, any other column text.  All open string
    columns of a table are counted in one job, which keeps at most `category_threshold` values per column.
    """
    hints, foreign_keys = hints or {}, foreign_keys or {}
    types: dict[str, ColumnType] = {}
    open_columns = []
    for f in df.schema.fields:
        if f.name == primary_key:
            types[f.name] = ColumnType.PRIMARY_KEY
        elif f.name in foreign_keys:
            types[f.name] = ColumnType.FOREIGN_KEY
        elif f.name in hints:
            types[f.name] = ColumnType(hints[f.name])
        elif f.name == time_column or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            types[f.name] = ColumnType.DATETIME
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)) or isinstance(f.dataType, T.NullType):
            types[f.name] = ColumnType.FLOAT
        elif isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)):
            open_columns.append(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            types[f.name] = ColumnType.FLOAT
        else:
            types[f.name] = ColumnType.TEXT
    few = few_distinct(df, open_columns, category_threshold)
    types |= {c: ColumnType.CATEGORY if few[c] else ColumnType.TEXT for c in open_columns}
    return {c: types[c] for c in df.columns}


def few_distinct(df: DataFrame, columns: list[str], limit: int) -> dict[str, bool]:
    """Whether each string column has fewer than `limit` distinct non-NULL values; exact, one job.

    Each partition sends at most `limit` values per column: the columns are unpivoted and distinct values
    of (column, value) are counted, so no task holds one column's values.
    """
    if not columns:
        return {}
    if len(df.columns) and df.isStreaming:
        raise ValueError("types of a stream can't be inferred: declare them")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p"))
    counts = dict(pairs.where("p.v is not null").select("p.i", "p.v").distinct().groupBy("i").count().collect())
    return {c: counts.get(i, 0) < limit for i, c in enumerate(columns)}


def number(c: Column, dtype: T.DataType) -> Column:
    """A float column's values: unparseable text and NaN become NULL, booleans 0 and 1; arrays stay."""
    if isinstance(dtype, T.ArrayType):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    d = c.try_cast("double") if isinstance(dtype, T.StringType) else c.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def instant(c: Column, dtype: T.DataType) -> Column:
    """A datetime column's values; unparseable text becomes NULL."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return c.try_cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def integer(c: Column, dtype: T.DataType) -> Column:
    """A timestamp column's values: whole seconds or whatever the source counts; text such as "10.0" is cut to 10."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    text = c.cast("string")
    whole = text.try_cast("bigint")
    return F.coalesce(whole, F.floor(F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))).try_cast("bigint"))

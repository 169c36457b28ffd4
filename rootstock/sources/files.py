"""Parquet and NumPy archives, on any file system that Spark's Hadoop client reaches."""

from __future__ import annotations

import io
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rootstock.schema import TableFormat


def _file(spark: SparkSession, path: str | Path):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str | Path) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read_bytes(spark: SparkSession, path: str | Path) -> bytes:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str | Path, data: bytes) -> None:
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_parquet(spark: SparkSession, path: str | Path, allow_pickle: bool = False) -> DataFrame:
    return spark.read.parquet(str(path))


def read_npz(spark: SparkSession, path: str | Path, allow_pickle: bool = False) -> DataFrame:
    """One array per column, read on the driver: an archive is one compressed file that can't be split. Pickled objects only on request."""
    from rootstock.rdb import as_spark

    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=allow_pickle) as z:
        columns = {k: z[k] for k in z.files}
    return as_spark(pd.DataFrame({k: list(v) if v.ndim > 1 else v for k, v in columns.items()}), spark)


READERS: dict[str, Callable[..., DataFrame]] = {TableFormat.PARQUET: read_parquet, TableFormat.NUMPY: read_npz}


def get_reader(fmt: str) -> Callable[..., DataFrame]:
    if fmt not in READERS:
        raise ValueError(f"unknown table format {fmt!r}: there are {sorted(map(str, READERS))}")
    return READERS[fmt]


def read_table(spark: SparkSession, path: str | Path, fmt: str, allow_pickle: bool = False) -> DataFrame:
    return get_reader(fmt)(spark, path, allow_pickle)


def write_parquet(df: DataFrame, path: str | Path) -> None:
    df.write.mode("overwrite").parquet(str(path))


def write_npz(df: DataFrame, path: str | Path) -> None:
    """For small tables: all rows come to the driver."""
    pdf = df.toPandas()
    data = io.BytesIO()
    np.savez_compressed(data, **{c: np.array(pdf[c].to_list()) if len(pdf) and isinstance(pdf[c].iloc[0], (list, np.ndarray)) else pdf[c].to_numpy() for c in pdf.columns})
    write_bytes(df.sparkSession, path, data.getvalue())


WRITERS: dict[str, Callable[[DataFrame, str | Path], None]] = {TableFormat.PARQUET: write_parquet, TableFormat.NUMPY: write_npz}


def get_writer(fmt: str) -> Callable[[DataFrame, str | Path], None]:
    if fmt not in WRITERS:
        raise ValueError(f"unknown table format {fmt!r}: there are {sorted(map(str, WRITERS))}")
    return WRITERS[fmt]


def write_table(df: DataFrame, path: str | Path, fmt: str) -> None:
    get_writer(fmt)(df, path)

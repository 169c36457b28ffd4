"""Databases by name: a YAML file that maps names to folders on any file system. Nothing is downloaded."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from rootstock.rdb import Rdb
from rootstock.sources.benchmarks import BenchmarkStore, StoreAdapter
from rootstock.sources.files import exists, read_bytes


def load_by_name(name: str, catalogue: str | Path, spark: SparkSession | None = None, allow_pickle: bool = False) -> Rdb:
    """The database or benchmark store that the catalogue has under this name; relative folders start at the catalogue's own."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    known = yaml.safe_load(read_bytes(spark, catalogue)) or {}
    if name not in known:
        raise ValueError(f"{name} isn't in the catalogue: there are {sorted(known)}")
    home = str(catalogue).rpartition("/")[0]
    where = known[name] if "://" in known[name] or known[name].startswith("/") or not home else f"{home}/{known[name]}"
    if not exists(spark, f"{where}/metadata.yaml"):
        raise FileNotFoundError(f"{where}/metadata.yaml does not exist")
    if "dataset_name" in yaml.safe_load(read_bytes(spark, f"{where}/metadata.yaml")):
        return StoreAdapter(name, BenchmarkStore.load(where, spark, allow_pickle), spark=spark).load()
    return Rdb.load(where, spark, allow_pickle)

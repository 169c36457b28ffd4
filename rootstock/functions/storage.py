"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set, which on a cluster is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="rootstock-")
    sc.setCheckpointDir(where)
    return where


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: it survives lost executors and gives every reader the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

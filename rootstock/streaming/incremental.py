"""Features kept up to date by Structured Streaming.

A stateful stream adds each micro-batch's partial aggregates to the state per key.  Rows later than the
watermark, where one is set, are left out by Spark; without one, nothing is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.storage import checkpoint_dir
from rootstock.sources.files import is_file


def aggregate_stream(stream: DataFrame, key: str, value: str, time: str | None = None, window: str | None = None, late: str | None = None) -> DataFrame:
    """Running n, n_values, total, low and high per key, and per event-time window where one is given.

    total is exact: values are added as decimals of four places.  NULL keys are left out, NULL and NaN values not counted.
    """
    v = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None))
    rows = stream.where(F.col(f"`{key}`").isNotNull())
    by = [F.col(f"`{key}`")]
    if window:
        rows = rows.withWatermark(time, late or "0 seconds")
        by.append(F.window(F.col(f"`{time}`"), window).alias("window"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.sum(v.cast("decimal(18,4)")).cast("string").alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a Parquet file's or folder's files. NTZ times are read as instants of the session's zone, which watermarks need."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in spark.read.parquet(path).schema.fields])
    reader = spark.readStream.schema(spark.read.parquet(path).schema if not files_per_batch else schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file(spark, path) else reader.parquet(path)


def incremental_aggregates(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Runs the stream over what is there now and gives the state as a table.

    The result and the stream's own checkpoint lie in the folder that executors share; each batch writes only the keys that it touched, and the
    last state of each key is the result.  A source without rows gives a table without rows.
    """
    where = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # Only keys that the batch touched come, each with its new state.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/number={number}")

    stream = aggregate_stream(file_stream(spark, path), key, value)
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(-1)).write.parquet(f"{where}/out/number=-1")
    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{where}/out").drop("number")
    names = [c for c in out.columns if c not in (key, "batch")]
    return out.groupBy(f"`{key}`").agg(F.max_by(F.struct(*names), "batch").alias("s")).select(f"`{key}`", "s.*")

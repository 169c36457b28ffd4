"""Attributes as known at event time: a point-in-time look-up that survives hot entities.

A version may be used at time t if every one of its `known` times lies strictly before t, that is
if their greatest does.  Among those the one with the greatest (known..., tie...) wins.  "Greatest
so far" is a running maximum, so history can be cut anywhere along time: each piece only needs
the maximum of everything before it.

Plan:
1. Versions are reduced to the best one per (entity, instant), with partial aggregation.
2. Entities with more than `rows_per_shard` rows are counted.  Only if there are any, their rows are
   counted per time bucket and buckets are put together to shards of about `rows_per_shard` rows.
3. The best version of each shard is carried into the following ones as their first row.
4. One window per (entity, shard, salt) merges versions, carry-in and probes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootstock.functions.skew import measured, small


def as_known_at(
    probes: DataFrame,
    versions: DataFrame,
    *,
    key: str,
    time: str,
    known: Sequence[str],
    tie: Sequence[str] = (),
    attributes: Sequence[str] = (),
    version_key: str | None = None,
    rows_per_shard: int = 500_000,
    bucket: str = "hour",
    prefix: str = "as_known_",
) -> DataFrame:
    """`probes` with the columns known..., tie... and attributes... of the version in force, each named prefix + name.

    Defined cases: a probe without key or time, or without an earlier version, gets NULLs; versions
    without key or without one of the `known` times are never in force; repeated versions count once;
    versions equal in all of known and tie are decided by the greatest attributes; repeated probes
    are all kept; empty inputs give empty or all-NULL results.  Columns of `probes` keep their names,
    also when `versions` has the same names; a clash with a prefixed name is an error.
    """
    names = list(dict.fromkeys([*known, *tie, *attributes]))
    clash = {c.lower() for c in probes.columns} & {(prefix + n).lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist in the probes: choose another prefix")
    vk = version_key or key
    ref = lambda n: F.col(f"`{n}`")
    kind = probes.schema[key].dataType
    when = versions.schema[known[0]].dataType
    latest = F.greatest(*[ref(n) for n in known]) if len(known) > 1 else ref(known[0])
    dated = versions.where(" and ".join(f"`{n}` is not null" for n in [vk, *known]))
    best = F.struct(*[ref(n).alias(f"v{i}") for i, n in enumerate(names)])
    v = dated.select(ref(vk).cast(kind).alias("k"), latest.alias("t"), best.alias("v")).groupBy("k", "t").agg(F.max("v").alias("v"))
    p = probes.select(ref(key).alias("k"), ref(time).cast(when).alias("t"), F.struct(*[ref(c).alias(f"p{i}") for i, c in enumerate(probes.columns)]).alias("p"))
    alone, p = p.where("k is null or t is null"), p.where("k is not null and t is not null")

    shards = _shards(p, v, rows_per_shard, bucket)
    nothing = F.lit(None)
    if shards is None:
        zero = [F.lit(0).alias("shard"), F.lit(0).alias("salt")]
        v, p, carry = v.select("*", *zero), p.select("*", *zero), None
    else:
        v, p, carry = _sharded(p, v, shards, bucket)
    rows = v.select("k", "shard", "salt", "t", F.lit(2).alias("o"), "v", nothing.cast(p.schema["p"].dataType).alias("p"))
    rows = rows.unionByName(p.select("k", "shard", "salt", "t", F.lit(1).alias("o"), nothing.cast(v.schema["v"].dataType).alias("v"), "p"))
    if carry is not None:
        rows = rows.unionByName(carry.select("k", "shard", "salt", nothing.cast(when).alias("t"), F.lit(0).alias("o"), "v", nothing.cast(p.schema["p"].dataType).alias("p")))
    w = Window.partitionBy("k", "shard", "salt").orderBy(F.col("t").asc_nulls_first(), "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.withColumn("v", F.max("v").over(w)).where("o = 1").select("p", "v")
    merged = merged.unionByName(alone.select("p", nothing.cast(v.schema["v"].dataType).alias("v")))
    return merged.select(*[F.col(f"p.p{i}").alias(c) for i, c in enumerate(probes.columns)], *[F.col(f"v.v{i}").alias(prefix + n) for i, n in enumerate(names)])


def _bucket(bucket: str) -> Column:
    return F.date_trunc(bucket, F.col("t")).cast("timestamp")


def _shards(p: DataFrame, v: DataFrame, limit: int, bucket: str) -> tuple[DataFrame, bool] | None:
    """(k, b, shard, salts) for the buckets of hot entities and whether it may be broadcast; None if no entity is hot."""
    both = v.select("k", "t", F.lit(0).alias("probe")).unionByName(p.select("k", "t", F.lit(1).alias("probe")))
    hot = both.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("k")
    found, size = measured(hot)
    if not found:
        return None
    side = F.broadcast(hot) if small(found, size) else hot
    hours = both.join(side, "k", "left_semi").groupBy("k", _bucket(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("probe").alias("np"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cut = hours.withColumn("shard", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / limit).cast("int"))
    salts = F.ceil(F.sum("np").over(Window.partitionBy("k", "shard")) / (2 * limit)).cast("int")
    cut = cut.select("k", "b", "shard", F.greatest(F.lit(1), salts).alias("salts"))
    return cut, small(*measured(cut))


def _sharded(p: DataFrame, v: DataFrame, found: tuple[DataFrame, bool], bucket: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    shards, fits = found
    side = F.broadcast(shards) if fits else shards

    def put(df: DataFrame) -> DataFrame:
        return df.withColumn("b", _bucket(bucket)).join(side, ["k", "b"], "left").withColumns({"shard": F.coalesce("shard", F.lit(0)), "salts": F.coalesce("salts", F.lit(1))}).drop("b")

    pieces = shards.groupBy("k", "shard").agg(F.max("salts").alias("salts"))
    own = put(v).join(F.broadcast(shards.select("k").distinct()) if fits else shards.select("k").distinct(), "k", "left_semi")
    own = own.groupBy("k", "shard").agg(F.max("v").alias("v"))
    before = Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.join(own, ["k", "shard"], "left").withColumn("v", F.max("v").over(before)).where("v is not null")
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salt = F.pmod(F.xxhash64("p"), F.col("salts")).cast("int")
    return spread(put(v)), put(p).withColumn("salt", salt).drop("salts"), spread(carry)

"""Per-key results without imbalance: eager aggregation through joins.

Both inputs are pre-aggregated by the join key to compact states (row count and, per measure, count,
sum, minimum and maximum).  The states, one row per key and side, are joined; the aggregates of the
would-be join follow by algebra: every left row meets n_right rows, so counts multiply and sums are
scaled.  The joined rows themselves are never made, so a key that holds a third of all rows costs
one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY = {"n": 0, "cnt": 0}


def compact(df: DataFrame, keys: dict[str, Column], measures: dict[str, Column], side: str) -> DataFrame:
    """One row per key: {side}_n and, per measure m, {side}_cnt_m, {side}_sum_m, {side}_min_m, {side}_max_m.

    NULLs aren't counted; NaN counts as NULL.  Rows whose key is NULL form the group NULL.
    """
    clean = df.select(*[c.alias(f"__k_{k}") for k, c in keys.items()], *[c.alias(f"__m_{m}") for m, c in measures.items()])
    aggs = [F.count(F.lit(1)).alias(f"{side}_n")]
    for m in measures:
        c = F.col(f"`__m_{m}`")
        if clean.schema[f"__m_{m}"].dataType.typeName() in ("double", "float"):
            c = F.nanvl(c, F.lit(None))
        aggs += [F.count(c).alias(f"{side}_cnt_{m}"), F.sum(c).alias(f"{side}_sum_{m}"), F.min(c).alias(f"{side}_min_{m}"), F.max(c).alias(f"{side}_max_{m}")]
    return clean.groupBy(*[F.col(f"`__k_{k}`").alias(k) for k in keys]).agg(*aggs)


def eager_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """Joins two results of `compact` by key.  NULL keys meet no key, as in SQL, and stay apart; counts of a missing side are 0.

    Adds pairs: the number of rows that the join of the original tables would have.
    """
    joined = left.join(right, keys, how)
    zero = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in joined.columns if c not in keys and c.split("_")[1] in _EMPTY}
    sides = [next(c for c in df.columns if c.endswith("_n") and c not in keys) for df in (left, right)]
    return joined.withColumns(zero).withColumn("pairs", F.col(sides[0]) * F.col(sides[1]))


def over_join(side: str, other: str, measure: str) -> Column:
    """Sum of the measure over the rows of the join: each row of `side` is repeated by the other side's count."""
    return F.col(f"{side}_sum_{measure}") * F.col(f"{other}_n")


def roll_up(states: DataFrame, by: list[str | Column], aggregates: dict[str, Column]) -> DataFrame:
    """Second aggregation, over the joined states."""
    return states.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def heavy_keys(states: DataFrame, key: str, sides: dict[str, tuple[str, DataFrame]], share: float) -> DataFrame:
    """(table_name, key): keys whose count is at least `share` of a table's rows, for all sides in one pass over the joined states.

    sides: table name -> (count column, frame of one row and column with the table's number of rows).
    """
    heavy = [F.when(F.col(count) >= F.lit(share) * total.scalar(), F.lit(name)) for name, (count, total) in sides.items()]
    each = states.where(F.col(key).isNotNull()).select(F.explode(F.array(*heavy)).alias("table_name"), key)
    return each.where("table_name is not null")

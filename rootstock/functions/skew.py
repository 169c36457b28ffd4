"""Joins against a side whose size has been counted, and salted joins beyond the bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its rows were counted and its bytes measured, and both stay within these.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes that a broadcast of df takes about: 16 a row, 16 a column and the length of texts. One job."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    row = F.lit(16 + 16 * len(df.columns)).cast("bigint")
    for c in texts:
        row = row + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first())


def small(rows: int, size: int, most_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= most_rows and size <= BROADCAST_BYTES


def join_counted(big: DataFrame, small: DataFrame, on: list[str], small_rows: int, how: str = "left", max_rows: int = BROADCAST_ROWS, hot: float = 0.002, small_bytes: int = 0) -> DataFrame:
    """Join `big` to `small`, which is unique on `on` and has `small_rows` rows of `small_bytes` bytes (counted by the caller).

    Up to `max_rows` and BROADCAST_BYTES the small side is broadcast and `big` isn't shuffled.  Beyond that, keys that
    hold more than the share `hot` of `big` are found by a partial aggregation; at most 1/hot keys
    can be so large, so their rows of `small` are broadcast and the others are joined by a shuffle.
    NULL keys match nothing and, in a left join, never travel.
    """
    if small_rows <= max_rows and small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    known = big.dropna(subset=on)
    total = known.groupBy().agg(F.count(F.lit(1)).alias("__all"))
    heavy = known.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    heavy = heavy.where(F.col("__n") > hot * total.scalar()).select(*on, F.lit(True).alias("__heavy"))
    tagged = known.join(F.broadcast(heavy), on, "left")
    light = tagged.where(F.col("__heavy").isNull()).drop("__heavy").join(small, on, how)
    few = small.join(F.broadcast(heavy.drop("__heavy")), on, "left_semi")
    out = light.unionByName(tagged.where(F.col("__heavy")).drop("__heavy").join(F.broadcast(few), on, how))
    if how in ("left", "left_outer"):
        nothing = big.where(" or ".join(f"`{c}` is null" for c in on))
        out = out.unionByName(nothing, allowMissingColumns=True)
    return out

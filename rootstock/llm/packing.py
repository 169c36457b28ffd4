"""Filling containers of a fixed capacity with items, best-two-fit.

A container is filled greedily with the largest items that fit.  If space is left, its smallest item is
taken out and the gap that this leaves is searched for two unpacked items that fill it more tightly than
that item did; if there are such, they go in its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Pool:
    """Unpacked items by size; a bit mask of the sizes there are finds the largest one below a bound."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(capacity + 2))
        self.items = [order[bounds[s] : bounds[s + 1]].tolist() for s in range(capacity + 1)]
        self.mask = sum(1 << s for s in range(1, capacity + 1) if self.items[s])

    def largest(self, bound: int) -> int:
        """Largest size from 1 to bound, or 0."""
        return max(0, (self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1)

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            self.mask &= ~(1 << size)
        return item

    def put(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.mask |= 1 << size


def _two(pool: _Pool, gap: int, more_than: int) -> tuple[int, int] | None:
    """Sizes of two unpacked items with the greatest sum that is at most gap and above more_than."""
    best, found = more_than, None
    a = pool.largest(gap - 1)
    while a and 2 * a > best:
        b = min(gap - a, a)
        if b == a and len(pool.items[a]) < 2:
            b -= 1
        b = pool.largest(b) if b > 0 else 0
        if b and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
        a = pool.largest(a - 1) if a > 1 else 0
    return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, from 0; sizes lie between 1 and capacity."""
    out = np.full(len(sizes), -1, np.int64)
    pool, number = _Pool(sizes, capacity), 0
    while pool.mask:
        gap, held = capacity, []
        while gap and (s := pool.largest(gap)):
            held.append((s, pool.take(s)))
            gap -= s
        if gap:
            small, item = held[-1]
            if pair := _two(pool, gap + small, small):
                held.pop()
                held += [(s, pool.take(s)) for s in pair]
                pool.put(small, item)
        for _, item in held:
            out[item] = number
        number += 1
    return out


def pack(items: DataFrame, size: str, capacity: int, items_per_group: int = 20_000, n_items: int | None = None) -> DataFrame:
    """One row per piece: the columns of `items`, piece, first, length and container.

    An item larger than `capacity` is cut into pieces of that size and a rest; `first` is where a piece begins and
    `length` its size.  Items are dealt evenly to groups of about `items_per_group`, which are packed
    apart, so each leaves at most its last container partly filled by chance; containers are
    numbered group * 2^32 + number.  `n_items` saves counting rows that are costly to make.  Items of size 0 or NULL take no space: one row with length 0 and
    container NULL.  Repeated rows are items of their own.  Negative sizes are an error.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    if clash := {"piece", "first", "length", "container"} & set(items.columns):
        raise ValueError(f"columns {sorted(clash)} exist in the items")
    groups = max(1, -(-(items.count() if n_items is None else n_items) // items_per_group))
    s = F.col(f"`{size}`")
    whole = F.struct(*[F.col(f"`{c}`") for c in items.columns])
    n = F.coalesce(s, F.lit(0)).cast("bigint")
    checked = F.when(n < 0, F.raise_error(F.lit("negative size")).cast("bigint")).otherwise(n)
    # Dealt by row number within the input partition: even, whatever the rows hold, and the same when a task runs again.
    dealt = items.select(whole.alias("item"), checked.alias("n"), F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7919, F.lit(groups)).cast("int").alias("g"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / capacity).cast("bigint")))
    cut = dealt.withColumn("piece", F.explode(pieces)).withColumn("first", F.col("piece") * capacity).withColumn("length", F.least(F.col("n") - F.col("first"), F.lit(capacity).cast("bigint")))
    parts = cut.select("g", "item", F.col("piece").cast("int").alias("piece"), "first", "length")
    schema = T.StructType([*parts.drop("g").schema.fields, T.StructField("container", T.LongType())])

    def fill(t: pa.Table) -> pa.Table:
        length = t["length"].to_numpy()
        some = length > 0
        at = np.full(len(length), -1, np.int64)
        at[some] = best_two_fit(length[some], capacity)
        group = int(t["g"][0].as_py())
        return t.drop_columns(["g"]).append_column("container", pa.array(np.where(some, (group << 32) + at, 0), pa.int64(), mask=~some))

    out = parts.groupBy("g").applyInArrow(fill, schema)
    return out.select(*[F.col(f"item.`{c}`").alias(c) for c in items.columns], "piece", "first", "length", "container")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and share of the capacity used."""
    held = packed.where("container is not null").groupBy("container").agg(F.sum("length").alias("n"))
    return held.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("used"), F.max("n").alias("fullest"))

"""Percentiles per group, exact, from states that add up.

State: one row per (group, value) with its count.  States of partitions, days or any other subsets of
the rows are combined by adding counts, so the combined percentiles are those of all rows: the error
bound is zero.  Percentiles come from one distributed sort of the state by (group, value).  Only the first and the last
group of a sorted partition can go on in another one: their counts per partition give each group's offset in each of its
partitions.  A second pass over the sorted partitions locates the target positions, and neighbouring order statistics are
interpolated linearly.  No group is held in one place: it may fill any number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.storage import keep

ROWS_PER_PARTITION = 1_000_000


def percentile_state(df: DataFrame, groups: dict[str, Column], value: Column) -> DataFrame:
    """(groups..., value, n).  NULL and NaN values hold no number: they count in n under the value NULL.  -0.0 is 0.0.  Rows without group (NULL or NaN) are left out."""
    v = value.cast("double")
    v = F.when(F.isnan(v), F.lit(None)).when(v == 0, F.lit(0.0)).otherwise(v)
    rows = df.select(*[c.alias(g) for g, c in groups.items()], v.alias("value")).dropna(subset=list(groups))
    return rows.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(*states: DataFrame) -> DataFrame:
    """The state of all rows, from states of disjoint subsets."""
    groups = [c for c in states[0].columns if c not in ("value", "n")]
    return reduce(DataFrame.unionByName, states).groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def roll_up(state: DataFrame, *dropped: str) -> DataFrame:
    """The state of coarser groups, such as of all periods together: the columns `dropped` are left out."""
    groups = [c for c in state.columns if c not in ("value", "n", *dropped)]
    return state.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


class _Sorted:
    """A sorted partition: where its groups begin, and running counts of its numbers."""

    def __init__(self, batches: Iterator[pa.RecordBatch], groups: int):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        self.table, self.rows = t, t.num_rows
        keys = [t.column(i).chunk(0) for i in range(groups)]
        new = np.zeros(max(0, self.rows - 1), bool)
        for k in keys:
            differ = pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            if pa.types.is_floating(k.type):
                both = pc.and_(pc.is_nan(k[1:]), pc.is_nan(k[:-1])).to_numpy(zero_copy_only=False)
                differ &= ~both
            new |= differ
        self.begins = np.r_[0, np.flatnonzero(new) + 1]
        value, n = t.column("value").chunk(0), t.column("n").chunk(0).to_numpy(zero_copy_only=False).astype(np.int64)
        none = pc.is_null(value).to_numpy(zero_copy_only=False)
        self.values = value.to_numpy(zero_copy_only=False)
        self.upto = np.cumsum(np.where(none, 0, n))
        self.held = np.add.reduceat(np.where(none, 0, n), self.begins)
        self.missing = np.add.reduceat(np.where(none, n, 0), self.begins)

    def statistics(self, position: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions within the groups, of which `before` numbers lie in earlier partitions, and whether they lie here."""
        local = position - before
        here = (local >= 0) & (local < self.held)
        base = np.r_[0, self.upto][self.begins]
        at = np.searchsorted(self.upto, base + np.where(here, local, 0), side="right")
        return self.values[np.minimum(at, self.rows - 1)], here


def percentiles(state: DataFrame, probabilities: dict[str, float], partitions: int | None = None, rows: int | None = None) -> DataFrame:
    """(groups..., n, n_missing, one double per name): linear interpolation between neighbouring order statistics.

    Position of p among n values is p * (n - 1), as in SQL's percentile_cont.  A group without
    numbers has n 0 and NULLs.  The state must hold each (group, value) once, as `percentile_state`
    and `combine` make it.  Infinite values sort at the ends; of two neighbours of which the lower one is infinite, it is the
    result.  `rows`, an upper bound of the state's rows, sets the number of partitions without counting it; `partitions` sets it outright.
    An empty state gives no rows.
    """
    groups = [c for c in state.columns if c not in ("value", "n")]
    if clash := {"n", "n_missing", "__pid", "__i", "__all", "__before", "__edge", *(f"__s{i}" for i in range(2 * len(probabilities)))} & {*groups, *probabilities} or set(probabilities) & set(groups):
        raise ValueError(f"group columns {sorted(clash)} clash with the result's")
    if partitions is None:
        if rows is None:
            state = keep(state)
            rows = state.count()
        partitions = max(1, -(-rows // ROWS_PER_PARTITION))
    order = [*groups, "value"]
    placed = state.select(*groups, "value", "n").repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    # Kept once: the bounds of a range partitioning are sampled, and both passes below must see the same ones.
    placed = keep(placed)
    spans = _spans(placed, groups)
    shares = list(probabilities.values())
    kinds = [state.schema[g] for g in groups]
    counts = [T.StructField(c, T.LongType()) for c in ("n", "n_missing")]
    found = T.StructType([*kinds, *counts, T.StructField("__edge", T.BooleanType()), *[T.StructField(f"__s{i}", T.DoubleType()) for i in range(2 * len(shares))]])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        p = _Sorted(iter(held), len(groups))
        m = len(p.begins)
        before, total, missing, edge = np.zeros(m, np.int64), p.held.copy(), p.missing.copy(), np.zeros(m, bool)
        for i, b, a in spans.get(int(p.table["__pid"][0].as_py()), ()):
            before[i], total[i], edge[i] = b, a, True
        statistics = []
        for share in shares:
            t = share * (total - 1)
            for position in (np.floor(t), np.ceil(t)):
                value, here = p.statistics(position.astype(np.int64), before)
                statistics.append(pa.array(value.astype(float), pa.float64(), mask=~(here & (total > 0)), from_pandas=False))
        names = p.table.select(range(len(groups))).take(pa.array(p.begins)).combine_chunks()
        columns = [*[c.chunk(0) for c in names.columns], pa.array(np.where(edge, p.held, total)), pa.array(missing), pa.array(edge), *statistics]
        yield pa.RecordBatch.from_arrays(columns, names=found.names)

    each = placed.mapInArrow(locate, found)
    # Groups of one partition are done; the parts of the few others are put together.
    spread = each.where("__edge").groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), *[F.max(f"__s{i}").alias(f"__s{i}") for i in range(2 * len(shares))])
    each = each.where("not __edge").drop("__edge").unionByName(spread) if spans else each.drop("__edge")
    names = {}
    for i, (name, p) in enumerate(probabilities.items()):
        low, high, t = F.col(f"__s{2 * i}"), F.col(f"__s{2 * i + 1}"), p * (F.col("n") - 1)
        endless = F.abs(low) == F.lit(float("inf"))
        names[name] = F.when((low == high) | endless, low).otherwise(low + (high - low) * (t - F.floor(t)))
    return each.select(*groups, "n", "n_missing", *[c.alias(n) for n, c in names.items()])


def _spans(placed: DataFrame, groups: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """By partition: (number of the group in it, numbers before, numbers in all) of the groups that go over several partitions.

    Only a partition's first and last group can, so there are at most two a partition.
    """
    schema = T.StructType([*[placed.schema[g] for g in groups], T.StructField("__pid", T.IntegerType()), T.StructField("__i", T.IntegerType()), T.StructField("held", T.LongType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        p = _Sorted(iter(held), len(groups))
        at = sorted({0, len(p.begins) - 1})
        names = p.table.select(range(len(groups))).take(pa.array(p.begins[at])).combine_chunks()
        pid = int(p.table["__pid"][0].as_py())
        yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in names.columns], pa.array([pid] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(p.held[at])], names=schema.names)

    w = Window.partitionBy(*groups)
    met = placed.mapInArrow(ends, schema).select("__pid", "__i", "held", F.sum("held").over(w).alias("__all"), (F.sum("held").over(w.orderBy("__pid")) - F.col("held")).alias("__before"), F.count(F.lit(1)).over(w).alias("parts"))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in met.where("parts > 1").collect():
        out.setdefault(r["__pid"], []).append((r["__i"], r["__before"], r["__all"]))
    return out


def grouped_percentiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """State and percentiles in one go."""
    return percentiles(percentile_state(df, {g: F.col(f"`{g}`") for g in groups}, F.col(f"`{value}`")), probabilities)

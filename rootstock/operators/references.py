"""References to records that do not exist, told from a schema of links.

A Bloom filter of all parents' keys proves most references without a parent; only references that the
filter lets through are joined exactly with the parents' keys and lifetimes.  Each referring table is
scanned once, whatever the number of its links.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootstock.functions import bloom
from rootstock.functions.keys import key_form
from rootstock.functions.skew import BROADCAST_ROWS, join_counted, measured


@dataclass(frozen=True)
class Link:
    """A column that refers to a parent table's key."""

    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Child:
    """What the check needs of a referring table: its rows' id and, where rows have one, their time."""

    df: DataFrame
    row_id: str
    time: Column | None = None


@dataclass(frozen=True)
class Parent:
    """A parent table; `born` and `died` bound the lives of its rows, NULL for no bound."""

    df: DataFrame
    born: str | None = None
    died: str | None = None


def links_of(schema: DataFrame) -> list[Link]:
    """Links of a schema table (table_name, column_name, link_to); it describes columns, so it is small: more than 100,000 are refused."""
    rows = schema.where("link_to is not null").select("table_name", "column_name", "link_to").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 links")
    return sorted((Link(r[0], r[1], *r[2].rsplit(".", 1)) for r in rows), key=lambda k: (k.table, k.column, k.parent))


def orphans(links: Sequence[Link], children: dict[str, Child], parents: dict[str, Parent], broadcast_rows: int = BROADCAST_ROWS, filter_bits: int = bloom.MAX_BITS) -> DataFrame:
    """(table_name, column_name, row_id, time, kind), one row per referring row whose reference doesn't hold.

    kind is missing (no such parent), late (the parent is born at or after the row's time) or deleted
    (it died at or before it); late goes before deleted.  Without a row time only missing applies.
    Keys are compared in key form; no key is no reference.  A key that several parent rows hold lives
    from their first birth to their last death.  Links to tables that aren't delivered are skipped;
    repeated rows come out once per row.  The filter has ten bits or more a key; beyond `filter_bits` it is
    met by a join instead of being broadcast.
    """
    used = [k for k in links if k.parent in parents and k.table in children]
    if not used:
        raise ValueError("no link leads to a delivered table")
    targets = list(dict.fromkeys((k.parent, k.parent_column) for k in used))
    lives = reduce(DataFrame.unionByName, [_lives(parents[p], c).withColumn("p", F.lit(i)) for i, (p, c) in enumerate(targets)])
    n, size = measured(reduce(DataFrame.unionByName, [parents[p].df.select(F.col(f"`{c}`").cast("string").alias("key"), *[F.lit(0).alias(f"c{i}") for i in range(4)]) for p, c in targets]))
    held_keys = bloom.build(lives, ["p", "key"], n, filter_bits)
    rows = reduce(DataFrame.unionByName, [_references(children[t], t, [k for k in used if k.table == t], targets) for t in dict.fromkeys(k.table for k in used)])
    # A key that the filter refutes becomes NULL: it needs no join, and without a broadcast it doesn't travel.
    told = held_keys.mark(rows, ["p", "key"], "held")
    told = told.withColumn("key", F.when(F.col("held"), F.col("key"))).drop("held")
    checked = join_counted(told, lives, ["p", "key"], n, "left", broadcast_rows, small_bytes=size)
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("born") >= F.col("time"), "late").when(F.col("died") <= F.col("time"), "deleted")
    return checked.select("table_name", "column_name", "row_id", "time", kind.alias("kind")).where("kind is not null")


def _references(child: Child, name: str, links: list[Link], targets: list[tuple[str, str]]) -> DataFrame:
    """(table_name, column_name, row_id, time, p, key): all references of a table from one scan; p is the parent's number."""
    time = F.lit(None).cast("timestamp_ntz") if child.time is None else child.time
    each = [F.struct(F.lit(k.column).alias("column_name"), F.lit(targets.index((k.parent, k.parent_column))).alias("p"), key_form(F.col(f"`{k.column}`"), child.df.schema[k.column].dataType).alias("key")) for k in links]
    rows = child.df.select(F.lit(name).alias("table_name"), F.col(f"`{child.row_id}`").cast("bigint").alias("row_id"), time.cast("timestamp_ntz").alias("time"), F.explode(F.array(*each)).alias("r"))
    return rows.select("table_name", "r.column_name", "row_id", "time", "r.p", "r.key").where("key is not null")


def _lives(parent: Parent, column: str) -> DataFrame:
    """(key, born, died, found), one row per key."""
    none = F.lit(None).cast("timestamp_ntz")
    born = F.col(f"`{parent.born}`").cast("timestamp_ntz") if parent.born else none
    died = F.col(f"`{parent.died}`").cast("timestamp_ntz") if parent.died else none
    rows = parent.df.select(key_form(F.col(f"`{column}`"), parent.df.schema[column].dataType).alias("key"), born.alias("born"), died.alias("died")).where("key is not null")
    always = lambda c: F.max(F.col(c).isNull())
    lives = rows.groupBy("key").agg(F.when(~always("born"), F.min("born")).alias("born"), F.when(~always("died"), F.max("died")).alias("died"))
    return lives.withColumn("found", F.lit(True))


def report(found: DataFrame, period: str = "month") -> DataFrame:
    """Counts per table, column, period of the row's time (NULL without one) and kind."""
    return found.groupBy("table_name", "column_name", F.date_trunc(period, "time").cast("date").alias("period"), "kind").agg(F.count(F.lit(1)).alias("n_rows"))

"""From feature trees to one lazy DataFrame.

Features are computed for a frame of rows of one table.  All features that take the same edge are
computed by one join or one aggregation along it, so a plan has as many joins as the trie of all
paths has edges, whatever the number of features.

With cutoffs, every frame carries the cutoff (`CUT`) and a table with a time column only shows rows
strictly before it.  Aggregates then are computed once per distinct (key, cutoff).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import count
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.primitives import histogram_aggregate
from rootstock.functions.skew import measured, small
from rootstock.functions.storage import keep
from rootstock.plans.nodes import Aggregate, Direct, Edge, Feature, Identity, counts
from rootstock.rdb import Rdb

CUT = "__cut"
#: Aggregates per grouping; more are split over several groupings, so that generated code stays compilable.
AGGREGATES_AT_ONCE = 200
#: Parts that a full time bucket, or the values of a key, are split into.
SPLITS = 64
#: Quantiles of keys with at most so many children come from a running list of values.
LISTED = 256
#: Primitives that give one of the values that they see.
PICKS = ("min", "max", "first", "last", "any_value", "mode")


@dataclass
class Compiler:
    rdb: Rdb
    strategy: Literal["auto", "range", "window"] = "auto"
    zero_nested_counts: bool = False
    multi_hop_with_cutoff: bool = False
    bucket: str = "day"
    #: A bucket of one key with more instants than this is split.
    bucket_rows: int = 200_000
    #: With strategy auto, keys with more children than this are computed by windows.
    hot_rows: int = 10_000
    _known: dict = field(default_factory=dict)
    _ids: count = field(default_factory=count)

    # --- rows of a table

    def _columns(self, table: str) -> dict[str, str]:
        return {c: f"c{i}" for i, c in enumerate(self.rdb.get_table(table).columns)}

    def _rows(self, table: str) -> DataFrame:
        """The table under internal column names, its booleans as they are."""
        return self.rdb.get_table(table).select(*[F.col(f"`{c}`").alias(a) for c, a in self._columns(table).items()])

    def _time(self, table: str) -> str | None:
        t = self.rdb.get_table_metadata(table).time_column
        return t and self._columns(table)[t]

    def _seen(self, table: str) -> Column | None:
        time = self._time(table)
        return F.col(time) < F.col(CUT) if time else None

    # --- entry

    def for_keys(self, keys: DataFrame, table: str, features: Sequence[Feature], cut: bool) -> tuple[DataFrame, list[str]]:
        """keys: (k[, CUT]), distinct. Gives keys plus one column per feature; hidden or missing rows give NULLs."""
        pk = self._columns(table)[self.rdb.get_table_metadata(table).primary_key]
        rows = self._rows(table)
        on = F.col("k") == F.col(pk)
        if cut and (seen := self._seen(table)) is not None:
            on = on & seen
        found = keys.join(rows, on, "left")
        out, names = self.features(found, table, features, cut)
        return out.select(*keys.columns, *names), names

    def features(self, rows: DataFrame, table: str, features: Sequence[Feature], cut: bool) -> tuple[DataFrame, list[str]]:
        """rows: columns of the table under internal names, and whatever else. Gives rows with a column per feature.

        Counts are NULL where nothing was found; the caller fills in 0 where the rules say so.
        """
        names: dict[Feature, str] = {}
        for f in features:
            if isinstance(f, Identity):
                names[f] = self._columns(table)[f.column]
        for edge in dict.fromkeys(f.edge for f in features if isinstance(f, Direct)):
            mine = list(dict.fromkeys(f for f in features if isinstance(f, Direct) and f.edge == edge))
            rows = self._look_up(rows, edge, mine, names, cut)
        for edges in dict.fromkeys(f.edges for f in features if isinstance(f, Aggregate)):
            mine = list(dict.fromkeys(f for f in features if isinstance(f, Aggregate) and f.edges == edges))
            rows = self._roll_up(rows, table, edges, mine, names, cut)
        return rows, [names[f] for f in features]

    def _new(self) -> str:
        return f"f{next(self._ids)}"

    # --- up

    def _look_up(self, rows: DataFrame, edge: Edge, mine: list[Direct], names: dict[Feature, str], cut: bool) -> DataFrame:
        fk = self._columns(edge.child)[edge.column]
        key, again = self._new(), self._new()
        bases = [f.base for f in mine]
        if all(isinstance(b, Identity) for b in bases):
            # Nothing is computed at the parent: one join with its rows.
            columns = self._columns(edge.parent)
            wanted = dict.fromkeys([columns[edge.key], *([self._time(edge.parent)] if self._time(edge.parent) else []), *[columns[b.column] for b in bases]])
            alias = {c: self._new() for c in wanted}
            parent = self._rows(edge.parent).select(*[F.col(c).alias(a) for c, a in alias.items()])
            on = F.col(fk) == F.col(alias[columns[edge.key]])
            if cut and (time := self._time(edge.parent)):
                on = on & (F.col(alias[time]) < F.col(CUT))
            for f in mine:
                names[f] = alias[columns[f.base.column]]
            return rows.join(parent, on, "left")
        keys = rows.select(F.col(fk).alias("k"), *([CUT] if cut else [])).where("k is not null").distinct()
        found, out = self.for_keys(keys, edge.parent, bases, cut)
        alias = [self._new() for _ in out]
        found = found.select(F.col("k").alias(key), *([F.col(CUT).alias(again)] if cut else []), *[F.col(o).alias(a) for o, a in zip(out, alias, strict=True)])
        names |= dict(zip(mine, alias, strict=True))
        on = F.col(fk) == F.col(key)
        return rows.join(found, on & (F.col(CUT) == F.col(again)) if cut else on, "left").drop(key, again)

    # --- down

    def _roll_up(self, rows: DataFrame, table: str, edges: tuple[Edge, ...], mine: list[Aggregate], names: dict[Feature, str], cut: bool) -> DataFrame:
        pk = self._columns(table)[edges[0].key]
        key, again = self._new(), self._new()
        if cut and len(edges) > 1 and not self.multi_hop_with_cutoff:
            raise ValueError("multi-hop aggregates with cutoffs need multi_hop_with_cutoff")
        keys = None
        if cut:
            keys = rows.select(F.col(pk).alias("k"), CUT).where(f"k is not null and {CUT} is not null").distinct()
        linear, stepped = [], []
        if cut and self.strategy != "range" and len(edges) == 1 and self._time(edges[0].child):
            linear = [f for f in mine if (f.base is None or isinstance(f.base, Identity)) and (f.primitive.window or f.primitive.kind == "histogram" or f.primitive.share is not None)]
            stepped = [f for f in mine if _steps(f.base) and (f.primitive.window or f.primitive.kind == "histogram")]
        hot = self._hot(edges[0]) if (linear or stepped) and self.strategy == "auto" else None
        if self.strategy == "auto" and hot is None:
            linear, stepped = [], []
        fast = linear + stepped
        rest = [f for f in mine if f not in fast]
        parts = [self._grouped(keys, edges, rest, cut)] if rest else []
        if fast and hot is None:
            parts += self._fast(keys, edges[0], linear, stepped)
        elif fast:
            few, other = self._grouped(keys.join(hot, "k", "left_anti"), edges, fast, cut)
            for many, alias in self._fast(keys.join(hot, "k", "left_semi"), edges[0], linear, stepped):
                parts.append((few.select("k", CUT, *[F.col(other[f]).alias(n) for f, n in alias.items()]).unionByName(many.select("k", CUT, *alias.values())), alias))
        for table_of, alias in parts:
            names |= alias
            table_of = table_of.withColumnRenamed("k", key)
            on = F.col(pk) == F.col(key)
            if cut:
                table_of = table_of.withColumnRenamed(CUT, again)
                on = on & (F.col(CUT) == F.col(again))
            rows = rows.join(table_of, on, "left").drop(key, again)
        return rows

    def _grouped(self, keys: DataFrame | None, edges: tuple[Edge, ...], mine: list[Aggregate], cut: bool) -> tuple[DataFrame, dict[Feature, str]]:
        """(k[, CUT], aggregates) for the keys that have children."""
        leaf = edges[-1].child
        child = self._children(keys, edges, cut)
        bases = list(dict.fromkeys(f.base for f in mine if f.base is not None))
        child, out = self.features(child, leaf, bases, cut)
        source = dict(zip(bases, out, strict=True))
        if self.zero_nested_counts:
            zero = {source[b]: F.coalesce(F.col(source[b]), F.lit(0)) for b in bases if counts(b)}
            child = child.withColumns(zero) if zero else child
        by = ["k", CUT] if cut else ["k"]
        time = F.col(self._time(leaf)) if self._time(leaf) else F.lit(None).cast("timestamp_ntz")
        alias = {f: self._new() for f in mine}
        plain, tables = [], []
        for f in mine:
            if f.primitive.kind == "rows":
                plain.append(F.count(F.lit(1)).alias(alias[f]))
            elif f.primitive.kind == "column":
                c = F.col(source[f.base])
                if f.primitive.numeric_cast and isinstance(child.schema[source[f.base]].dataType, T.BooleanType):
                    c = c.cast("int")
                plain.append(f.primitive.build(c, time).alias(alias[f]))
        # Under cutoffs a group is one key's history, so its values may be counted in one buffer and all goes in one grouping.
        modes = [f for f in mine if f.primitive.name == "mode"] if cut else []
        plain += [F.mode(F.col(source[f.base]), True).alias(alias[f]) for f in modes]
        for i in range(0, len(plain), AGGREGATES_AT_ONCE):
            tables.append(child.groupBy(*by).agg(*plain[i : i + AGGREGATES_AT_ONCE]))
        for b in dict.fromkeys(f.base for f in mine if f.primitive.kind == "elements"):
            own = [f for f in mine if f.base == b and f.primitive.kind == "elements"]
            placed = child.select(*by, F.posexplode(source[b]).alias("at", "x")).groupBy(*by, "at").agg(*[f.primitive.build(F.col("x"), time).alias(alias[f]) for f in own])
            gathered = [_field(F.array_sort(F.collect_list(F.struct("at", alias[f]))), alias[f]).alias(alias[f]) for f in own]
            tables.append(placed.groupBy(*by).agg(*gathered))
        counted: dict[str, list[Feature]] = {}
        for b in dict.fromkeys(f.base for f in mine if f.primitive.kind == "histogram" and f not in modes):
            counted.setdefault(child.schema[source[b]].dataType.simpleString(), []).append(b)
        for same in counted.values():
            # The values of all columns of one type are counted together.
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(source[b]).alias("v")) for i, b in enumerate(same)])).alias("x")
            histogram = child.select(*by, each).select(*by, "x.i", "x.v").where("v is not null").groupBy(*by, "i", "v").agg(F.count(F.lit(1)).alias("n"))
            own = [(F.col("i") == i, f) for i, b in enumerate(same) for f in mine if f.base == b and f.primitive.kind == "histogram" and f not in modes]
            tables.append(histogram.groupBy(*by).agg(*[histogram_aggregate(f.primitive.name, F.when(c, F.col("v")), F.when(c, F.col("n"))).alias(alias[f]) for c, f in own]))
        out_table = tables[0]
        for t in tables[1:]:
            out_table = out_table.join(t, by, "full")
        return out_table, alias

    def _children(self, keys: DataFrame | None, edges: tuple[Edge, ...], cut: bool) -> DataFrame:
        """Rows of the last table along the edges, with the first table's key as k (and its cutoff)."""
        if cut:
            frame = keys
            for e in edges:
                fk = self._columns(e.child)[e.column]
                on = F.col("k2" if e is not edges[0] else "k") == F.col(fk)
                if (seen := self._seen(e.child)) is not None:
                    on = on & seen
                frame = frame.join(self._rows(e.child), on, "inner")
                if e is not edges[-1]:
                    frame = frame.select("k", CUT, F.col(self._columns(e.child)[edges[edges.index(e) + 1].key]).alias("k2"))
            return frame.drop("k2")
        last = edges[-1]
        frame = self._rows(last.child).withColumn("k", F.col(self._columns(last.child)[last.column]))
        for e in reversed(edges[:-1]):
            columns = self._columns(e.child)
            down = edges[edges.index(e) + 1]
            middle = self._rows(e.child).select(F.col(columns[down.key]).alias("m"), F.col(columns[e.column]).alias("k3"))
            frame = frame.join(middle, F.col("k") == F.col("m"), "inner").drop("k", "m").withColumnRenamed("k3", "k")
        return frame.where("k is not null")

    # --- running aggregates

    def _hot(self, edge: Edge) -> DataFrame | None:
        return self._more(edge, self.hot_rows)

    def _more(self, edge: Edge, most: int) -> DataFrame | None:
        """Keys with more than `most` children, or None if there are none: one counting job per edge and number."""
        if (edge, most) not in self._known:
            counts_of = self._rows(edge.child).groupBy(F.col(self._columns(edge.child)[edge.column]).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            more = counts_of.where(F.col("k").isNotNull() & (F.col("n") > most)).select("k")
            found, size = measured(more)
            self._known[edge, most] = None if not found else F.broadcast(more) if small(found, size) else more
        return self._known[edge, most]

    def _by_length(self, rows: DataFrame, probes: DataFrame, edge: Edge, most: int, short: Callable, long: Callable) -> DataFrame:
        """What short gives for keys with at most `most` children, and long for all others."""
        if self.strategy == "auto" and most <= self.hot_rows:
            return long(rows, probes)
        if (more := self._more(edge, most)) is None:
            return short(rows, probes)
        few, many = (lambda df: df.join(more, "k", "left_anti")), (lambda df: df.join(more, "k", "left_semi"))
        return short(few(rows), few(probes)).unionByName(long(many(rows), many(probes)))

    def _fast(self, keys: DataFrame, edge: Edge, linear: list[Aggregate], stepped: list[Aggregate]) -> list[tuple[DataFrame, dict[Feature, str]]]:
        return ([self._linear(keys, edge, linear)] if linear else []) + ([self._stepped(keys, edge, stepped)] if stepped else [])

    def _linear(self, keys: DataFrame, edge: Edge, mine: list[Aggregate]) -> tuple[DataFrame, dict[Feature, str]]:
        """Aggregates before each cutoff in work that grows with rows and cutoffs, not with their product."""
        columns = self._columns(edge.child)
        time = columns[self.rdb.get_table_metadata(edge.child).time_column]
        child = self._rows(edge.child)
        bases = {b: f"v{i}" for i, b in enumerate(dict.fromkeys(f.base.column for f in mine if f.base is not None))}
        as_int = lambda b: isinstance(child.schema[columns[b]].dataType, T.BooleanType)
        rows = child.select(F.col(columns[edge.column]).alias("k"), F.col(time).alias("t"), *[(F.col(columns[b]).cast("int") if as_int(b) else F.col(columns[b])).alias(v) for b, v in bases.items()]).where("k is not null and t is not null")
        asked = lambda df: df.join(keys.select("k").distinct(), "k", "left_semi")
        probes = keys.select("k", F.col(CUT).alias("t"))
        alias = {f: self._new() for f in mine}
        # With strategy auto, the keys are few of the children's.
        some = asked(rows) if self.strategy == "auto" else rows
        running = [f for f in mine if f.primitive.window]
        tables = [self._running(asked(rows), probes, {f: bases.get(f.base.column) if f.base else None for f in running}, alias)] if running else []
        if counted := {f: bases[f.base.column] for f in mine if f.primitive.kind == "histogram"}:
            long = lambda r, p: self._histograms(asked(r), p, counted, alias)
            tables.append(self._by_length(some, probes, edge, self.bucket_rows, lambda r, p: self._short_histograms(r, p, counted, alias), long))
        if shares := {f: bases[f.base.column] for f in mine if f.primitive.share is not None}:
            long = lambda r, p: self._quantiles(asked(r), p, shares, alias)
            tables.append(self._by_length(some, probes, edge, min(LISTED, self.bucket_rows), lambda r, p: self._short_quantiles(r, p, shares, alias), long))
        out = self._side_by_side(tables)
        # Booleans were counted as 0 and 1; what picks one of them gives a boolean again.
        back = [F.col(alias[f]).cast("boolean").alias(alias[f]) if f.base is not None and as_int(f.base.column) and f.primitive.name in PICKS else F.col(alias[f]) for f in mine]
        return out.select("k", F.col("t").alias(CUT), *back), alias

    def _bucketed(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """rows (by..., t) with b: their time bucket, which splits where one key has more than `bucket_rows` in it."""
        rows = rows.withColumn("b", F.date_trunc(self.bucket, "t").cast("timestamp_ntz"))
        full = rows.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.bucket_rows).drop("n")
        found, size = measured(full)
        if not found:
            return rows.withColumn("b", F.struct("b", F.lit(0).alias("part")))
        fits = (lambda df: F.broadcast(df)) if small(found, size + 8 * SPLITS * found) else (lambda df: df)
        at = F.unix_micros(F.col("t").cast("timestamp"))
        shares = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
        bounds = rows.join(fits(full), [*by, "b"], "left_semi").groupBy(*by, "b").agg(F.percentile_approx(at, shares, F.lit(20 * SPLITS)).alias("bounds"))
        part = F.coalesce(F.size(F.filter("bounds", lambda x: x < at)), F.lit(0))
        return rows.join(fits(bounds), [*by, "b"], "left").withColumn("b", F.struct("b", F.when(F.col("bounds").isNull(), 0).otherwise(part).alias("part"))).drop("bounds")

    def _before(self, rows: DataFrame, probes: DataFrame, by: list[str], parts: dict[str, Column], again: dict[str, Callable]) -> DataFrame:
        """(by..., t, <part>...): per probe the parts over all earlier rows; no row where there are none.

        rows are combined per instant and put in time buckets, as probes are.  A bucket's earlier rows come as combined
        aggregates, so each window only runs over one bucket of one key.
        """
        met = rows.groupBy(*by, "t").agg(*[e.alias(n) for n, e in parts.items()]).withColumn("probe", F.lit(False))
        both = self._bucketed(met.unionByName(probes.select(*by, "t").withColumn("probe", F.lit(True)), allowMissingColumns=True), by)
        buckets = both.groupBy(*by, "b").agg(*[again[n](F.col(n)).alias(n) for n in parts])
        earlier = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = buckets.select(*by, "b", *[again[n](F.col(n)).over(earlier).alias(f"e_{n}") for n in parts])
        # A probe comes before the row of its own instant: strictly earlier.
        before = Window.partitionBy(*by, "b").orderBy("t", F.col("probe").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = both.select(*by, "b", "t", "probe", *[again[n](F.col(n)).over(before).alias(f"i_{n}") for n in parts]).where("probe")
        joined = inside.join(carried, [*by, "b"])
        total = [_combined(again[n], F.col(f"e_{n}"), F.col(f"i_{n}")).alias(n) for n in parts]
        return joined.select(*by, "t", *total).where(f"{next(iter(parts))} is not null")

    def _upto(self, rows: DataFrame, by: list[str], n: str) -> DataFrame:
        """rows, one per by and t, with `upto`: the running sum of n up to and with the row."""
        both = self._bucketed(rows, by)
        earlier = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*by, "b").agg(F.sum(n).alias("held")).select(*by, "b", F.sum("held").over(earlier).alias("carried"))
        inside = Window.partitionBy(*by, "b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("upto", F.sum(n).over(inside)).join(carried, [*by, "b"]).withColumn("upto", F.coalesce("carried", F.lit(0)) + F.col("upto")).drop("b", "carried")

    def _met(self, rows: DataFrame, probes: DataFrame, ranked: list[str]) -> DataFrame:
        """rows and probes of short keys, all of a key in one partition; r_<c> is how often a row's value of c has come so far, with the row."""
        both = rows.withColumn("probe", F.lit(False)).unionByName(probes.select("k", "t", F.lit(True).alias("probe")), allowMissingColumns=True).repartition("k")
        return both.withColumns({f"r_{c}": F.row_number().over(Window.partitionBy("k", c).orderBy("t")) for c in ranked})

    def _short_histograms(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str], alias: dict[Feature, str]) -> DataFrame:
        """What `_histograms` gives, by a window per column and one over each key. A column that nobody selects costs nothing."""
        columns = list(dict.fromkeys(mine.values()))
        both = self._met(rows.select("k", "t", *columns), probes, columns)
        # A probe comes before the row of its own instant: strictly earlier.
        before = Window.partitionBy("k").orderBy("t", F.col("probe").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        weight = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
        parts = {}
        for c in columns:
            r, there = F.col(f"r_{c}").cast("double"), F.col(c).isNotNull()
            parts |= {f"n_{c}": F.count(c), f"kinds_{c}": F.sum(F.when(there & (r == 1), 1)), f"spread_{c}": F.sum(F.when(there, weight(r) - weight(r - 1))), f"top_{c}": F.min(F.when(there, F.struct((-r).alias("r"), F.col(c).alias("v"))))}
        met = both.select("k", "t", "probe", *[e.over(before).alias(n) for n, e in parts.items()]).where("probe")

        def value(name: str, c: str) -> Column:
            n, kinds = F.col(f"n_{c}").cast("double"), F.col(f"kinds_{c}")
            if name == "mode":
                return F.col(f"top_{c}.v")
            return F.when(kinds == 1, F.lit(0.0)).when(n > 0, F.log2(n) - F.col(f"spread_{c}") / n) if name == "discrete_entropy" else kinds

        return met.select("k", "t", *[value(f.primitive.name, c).alias(alias[f]) for f, c in mine.items()])

    def _short_quantiles(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str], alias: dict[Feature, str]) -> DataFrame:
        """What `_selected` gives, from the sorted list of a key's values so far."""
        columns = list(dict.fromkeys(mine.values()))
        both = self._met(rows.select("k", "t", *[F.col(c).cast("double").alias(c) for c in columns]), probes, [])
        before = Window.partitionBy("k").orderBy("t", F.col("probe").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = both.select("k", "t", "probe", *[F.collect_list(c).over(before).alias(c) for c in columns]).where("probe")
        # NaN comes after all numbers.
        met = met.select("k", "t", *[F.sort_array(c).alias(c) for c in columns])

        def value(c: str, q: float) -> Column:
            at = F.lit(q) * (F.size(c) - 1)
            low, high = F.get(c, F.floor(at).cast("int")), F.get(c, F.ceil(at).cast("int"))
            return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

        return met.select("k", "t", *[value(c, f.primitive.share).alias(alias[f]) for f, c in mine.items()])

    def _histograms(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str], alias: dict[Feature, str]) -> DataFrame:
        counted: dict[str, dict[Aggregate, str]] = {}
        for f, c in mine.items():
            counted.setdefault(rows.schema[c].dataType.simpleString(), {})[f] = c
        return self._side_by_side([self._running_histograms(rows, probes, same, alias) for same in counted.values()])

    def _quantiles(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str], alias: dict[Feature, str]) -> DataFrame:
        wanted = {c: {alias[f]: f.primitive.share for f, own in mine.items() if own == c} for c in dict.fromkeys(mine.values())}
        return self._side_by_side([self._selected(rows.select("k", "t", F.col(c).cast("double").alias("v")), probes, w) for c, w in wanted.items()])

    def _side_by_side(self, tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for table in tables[1:]:
            out = out.join(table, ["k", "t"], "full")
        return out

    def _running_histograms(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str], alias: dict[Feature, str]) -> DataFrame:
        """Mode, entropy and distinct counts of columns of one type, from the number of times that a value has come so far.

        As counts only grow, the mode is the value of the greatest count so far; a value's coming again changes the sum of n log n by what its own count tells.
        """
        columns = list(dict.fromkeys(mine.values()))
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("x")
        came = rows.select("k", "t", each).select("k", "t", "x.i", "x.v").where("v is not null").groupBy("k", "i", "v", "t").agg(F.count(F.lit(1)).alias("n"))
        came = self._upto(came, ["k", "i", "v"], "n")
        r, n = F.col("upto").cast("double"), F.col("n")
        weight = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
        parts = {"n": F.sum("n"), "kinds": F.sum(F.when(F.col("upto") == n, 1).otherwise(0)), "spread": F.sum(weight(r) - weight(r - n)), "top": F.min(F.struct((-F.col("upto")).alias("r"), F.col("v")))}
        again = {"n": F.sum, "kinds": F.sum, "spread": F.sum, "top": F.min}
        wide = probes.select("k", "t", F.explode(F.array(*[F.lit(i) for i in range(len(columns))])).alias("i"))
        met = self._before(came, wide, ["k", "i"], parts, again)
        total = F.col("n").cast("double")
        entropy = F.when(F.col("kinds") == 1, F.lit(0.0)).otherwise(F.log2(total) - F.col("spread") / total)
        values = {"mode": F.col("top.v"), "discrete_entropy": entropy, "nunique": F.col("kinds"), "num_unique": F.col("kinds")}
        picked = [F.max(F.when(F.col("i") == columns.index(c), values[f.primitive.name])).alias(alias[f]) for f, c in mine.items()]
        return met.groupBy("k", "t").agg(*picked)

    def _running(self, rows: DataFrame, probes: DataFrame, mine: dict[Aggregate, str | None], alias: dict[Feature, str]) -> DataFrame:
        """Aggregates of all children before each cutoff, by windows instead of a join that repeats history."""
        rows, parts, again, give = self._formulas(rows, mine)
        met = self._before(rows, probes, ["k"], parts, again)
        return met.select("k", "t", *[give[f].alias(alias[f]) for f in mine])

    def _formulas(self, rows: DataFrame, mine: dict[Aggregate, str | None]) -> tuple[DataFrame, dict[str, Column], dict[str, Callable], dict[Aggregate, Column]]:
        """(rows, parts, how parts are combined, results of combined parts): aggregates taken apart into what adds up. rows have k and t."""
        spread = {v for f, v in mine.items() if f.primitive.name in ("std", "variance", "skewness", "kurtosis")}
        if spread:
            # Powers are summed around the key's mean, so that little is lost where values are far from 0.
            middle = rows.groupBy("k").agg(*[F.avg(v).alias(f"m_{v}") for v in spread])
            rows = rows.join(middle, "k").withColumns({f"o_{v}": F.col(v) - F.col(f"m_{v}") for v in spread})
        power = lambda v, n: F.sum(F.pow(F.col(f"o_{v}"), n))
        dated = lambda v: F.struct("t", F.col(v).alias("v"))
        make = {
            "s": (lambda v: F.sum(v), F.sum), "c": (lambda v: F.count(v), F.sum), "lo": (lambda v: F.min(v), F.min), "hi": (lambda v: F.max(v), F.max), "p": (lambda v: F.product(v), F.product),
            "d": (lambda v: F.sum(f"o_{v}"), F.sum), "q": (lambda v: power(v, 2), F.sum), "u": (lambda v: power(v, 3), F.sum), "w": (lambda v: power(v, 4), F.sum), "f": (lambda v: F.min(dated(v)), F.min), "l": (lambda v: F.max(dated(v)), F.max),
        }
        terms = {
            "mean": "sc", "sum": "s", "min": ("lo",), "max": ("hi",), "any_value": ("lo",), "std": "dqc", "variance": "dqc", "skewness": ("d", "q", "u", "c", "lo", "hi"), "kurtosis": ("d", "q", "u", "w", "c", "lo", "hi"), "product": "p", "first": "f", "last": "l",
        }
        needed = dict.fromkeys((t, v) for f, v in mine.items() if v is not None for t in terms[f.primitive.name])
        parts = {"n": F.count(F.lit(1))} | {f"{t}_{v}": make[t][0](v) for t, v in needed}
        again = {"n": F.sum} | {f"{t}_{v}": make[t][1] for t, v in needed}

        def moments(v: str) -> tuple[Column, Column, Column, Column]:
            """Number and central sums of the second, third and fourth power."""
            n, d, q = F.col(f"c_{v}").cast("double"), F.col(f"d_{v}"), F.col(f"q_{v}")
            m = d / n
            u = F.col(f"u_{v}") if ("u", v) in needed else F.lit(0.0)
            w = F.col(f"w_{v}") if ("w", v) in needed else F.lit(0.0)
            return n, F.greatest(F.lit(0.0), q - n * m * m), u - 3 * m * q + 2 * n * m * m * m, w - 4 * m * u + 6 * m * m * q - 3 * n * m * m * m * m

        def variance(v: str) -> Column:
            n, m2, _, _ = moments(v)
            return F.when(n > 1, m2 / (n - 1))

        varied = lambda v: F.col(f"lo_{v}") < F.col(f"hi_{v}")
        give = {
            "count": lambda v: F.col("n"), "mean": lambda v: F.when(F.col(f"c_{v}") > 0, F.col(f"s_{v}") / F.col(f"c_{v}")), "sum": lambda v: F.col(f"s_{v}"), "min": lambda v: F.col(f"lo_{v}"), "max": lambda v: F.col(f"hi_{v}"), "any_value": lambda v: F.col(f"lo_{v}"),
            "std": lambda v: F.sqrt(variance(v)), "variance": variance, "product": lambda v: F.col(f"p_{v}"), "first": lambda v: F.col(f"f_{v}.v"), "last": lambda v: F.col(f"l_{v}.v"),
            "skewness": lambda v: F.when(varied(v), F.sqrt(moments(v)[0]) * moments(v)[2] / F.pow(moments(v)[1], 1.5)),
            "kurtosis": lambda v: F.when(varied(v), moments(v)[0] * moments(v)[3] / F.pow(moments(v)[1], 2) - 3),
        }
        return rows, parts, again, {f: give[f.primitive.name](v) for f, v in mine.items()}

    def _stepped(self, keys: DataFrame, edge: Edge, mine: list[Aggregate]) -> tuple[DataFrame, dict[Feature, str]]:
        """Aggregates before each cutoff of what is itself an aggregate, and so changes with time.

        A child's features change only where it or one of its own children appears, so it has as many versions as it has these, each of which
        holds for a range of its key's cutoffs in order.  A range is covered by few nodes of a binary tree over the cutoffs; versions
        are combined per node, and a cutoff combines the nodes above it.  Work grows with rows and cutoffs, times the tree's height.
        """
        columns, time = self._columns(edge.child), self._time(edge.child)
        pk, fk, moment = columns[self.rdb.get_table_metadata(edge.child).primary_key], columns[edge.column], F.expr("interval 1 microsecond")
        ranked = keep(self._upto(keys.select("k", F.col(CUT).alias("t"), F.lit(1).alias("one")), ["k"], "one").select("k", "t", (F.col("upto") - 1).alias("r")))
        height = int(ranked.agg(F.coalesce(F.max("r"), F.lit(0))).first()[0]).bit_length()
        rows = self._rows(edge.child).where(f"{fk} is not null and {pk} is not null and {time} is not null")
        rows = rows.join(keys.select("k").distinct(), F.col(fk) == F.col("k"), "left_semi")
        born = rows.select(F.col(pk).alias("o"), F.col(time).alias("t"))
        versions = born
        for e in dict.fromkeys(f.base.edges[0] for f in mine):
            if at := self._time(e.child):
                below = self._rows(e.child).select(F.col(self._columns(e.child)[e.column]).alias("o"), F.col(at).alias("at")).dropna()
                versions = versions.unionByName(born.join(below, "o").select("o", F.greatest("t", "at").alias("t")))
        held = self._bucketed(versions.distinct(), ["o"])
        first = held.groupBy("o", "b").agg(F.min("t").alias("first")).select("o", "b", F.lead("first").over(Window.partitionBy("o").orderBy("b")).alias("next"))
        inside = F.lead("t").over(Window.partitionBy("o", "b").orderBy("t"))
        held = held.withColumn("until", inside).join(first, ["o", "b"]).select("o", (F.col("t") + moment).alias(CUT), (F.coalesce("until", "next") + moment).alias("__until"))
        frame = held.join(rows, F.col("o") == F.col(pk)).drop("o")
        bases = list(dict.fromkeys(f.base for f in mine))
        frame, out = self.features(frame, edge.child, bases, True)
        names = {b: f"v{i}" for i, b in enumerate(bases)}
        kinds = {b: frame.schema[c].dataType for b, c in zip(bases, out, strict=True)}
        as_int = lambda b: isinstance(kinds[b], T.BooleanType)
        value = {b: F.coalesce(F.col(c), F.lit(0)) if self.zero_nested_counts and counts(b) else F.col(c).cast("int") if as_int(b) else F.col(c) for b, c in zip(bases, out, strict=True)}
        steps = keep(frame.select(F.col(fk).alias("k"), F.col(time).alias("t"), F.col(CUT).alias("since"), F.col("__until").alias("until"), *[value[b].alias(n) for b, n in names.items()]))
        marks = steps.select("k", F.col("since").alias("t")).unionByName(steps.where("until is not null").select("k", F.col("until").alias("t"))).distinct()
        number = keep(self._before(ranked.select("k", "t"), marks, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum}))
        low, high = number.select("k", F.col("t").alias("since"), F.col("n").alias("low")), number.select("k", F.col("t").alias("until"), F.col("n").alias("high"))
        steps = steps.join(low, ["k", "since"], "left").join(high, ["k", "until"], "left")
        steps = steps.withColumns({"low": F.coalesce("low", F.lit(0)), "high": F.when(F.col("until").isNull(), F.lit(1 << height)).otherwise(F.coalesce("high", F.lit(0)))}).where("low < high")
        cover = []
        for j in range(height + 1):
            left, right = F.shiftright(F.col("low") + ((1 << j) - 1), j), F.shiftright(F.col("high"), j)
            node = lambda i, j=j: F.struct(F.lit(j).alias("j"), i.cast("bigint").alias("i"))
            cover += [F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1))]
        steps = steps.withColumn("node", F.explode(F.filter(F.array(*cover), lambda x: x.isNotNull()))).select("k", "t", "node", *names.values())
        above = F.array(*[F.struct(F.lit(j).alias("j"), F.shiftright("r", j).alias("i")) for j in range(height + 1)])
        asked = ranked.select("k", "t", F.explode(above).alias("node"))
        alias, tables = {f: self._new() for f in mine}, []
        if running := {f: names[f.base] for f in mine if f.primitive.window}:
            rows_of, parts, again, give = self._formulas(steps, running)
            nodes = rows_of.groupBy("k", "node").agg(*[e.alias(n) for n, e in parts.items()])
            met = asked.join(nodes, ["k", "node"]).groupBy("k", "t").agg(*[again[n](F.col(n)).alias(n) for n in parts])
            tables.append(met.select("k", "t", *[give[f].alias(alias[f]) for f in running]))
        counted: dict[str, list[Aggregate]] = {}
        for f in mine:
            if f.primitive.kind == "histogram":
                counted.setdefault(steps.schema[names[f.base]].dataType.simpleString(), []).append(f)
        for same in counted.values():
            held_by = list(dict.fromkeys(names[f.base] for f in same))
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(held_by)])).alias("x")
            nodes = steps.select("k", "node", each).select("k", "node", "x.c", "x.v").where("v is not null").groupBy("k", "node", "c", "v").agg(F.count(F.lit(1)).alias("n"))
            met = asked.join(nodes, ["k", "node"]).groupBy("k", "t", "c", "v").agg(F.sum("n").alias("n"))
            mine_of = [(F.col("c") == held_by.index(names[f.base]), f) for f in same]
            tables.append(met.groupBy("k", "t").agg(*[histogram_aggregate(f.primitive.name, F.when(c, F.col("v")), F.when(c, F.col("n"))).alias(alias[f]) for c, f in mine_of]))
        out_table = tables[0]
        for t in tables[1:]:
            out_table = out_table.join(t, ["k", "t"], "full")
        back = [F.col(alias[f]).cast("boolean").alias(alias[f]) if as_int(f.base) and f.primitive.name in PICKS else F.col(alias[f]) for f in mine]
        return out_table.select("k", F.col("t").alias(CUT), *back), alias


    def _selected(self, rows: DataFrame, probes: DataFrame, wanted: dict[str, float]) -> DataFrame:
        """Quantiles of v before each cutoff, interpolated linearly, by selecting ranks.

        A key's values are parted by about `SPLITS` bounds; the running count of each part tells in which one a cutoff's rank lies, and
        that part is parted again, until it has few rows or one value.  Each round passes over the rows once and looks at
        the parts of a key per cutoff, whatever the length of history.
        """
        rows = rows.where("v is not null")
        number = F.sum((~F.isnan("v")).cast("bigint"))
        n = self._before(rows, probes, ["k"], {"n": F.count(F.lit(1)), "numbers": number}, {"n": F.sum, "numbers": F.sum})
        rows = rows.where("not isnan(v)")
        ranks = []
        for a, q in wanted.items():
            at = F.lit(q) * (F.col("n") - 1)
            ranks += [F.struct(F.lit(f"{a}_{side}").alias("a"), f(at).cast("bigint").alias("r")) for side, f in (("lo", F.floor), ("hi", F.ceil))]
        sought = keep(n.select("k", "t", "n", "numbers", F.explode(F.array(*ranks)).alias("x")).select("k", "t", "n", "numbers", "x.a", "x.r"))
        # NaN comes after all numbers.
        targets = sought.where("r < numbers").select("k", "t", "r").distinct().select(F.struct("k", "t", "r").alias("id"), F.col("k").cast("string").alias("g"), "t", "r")
        rows, found = rows.select(F.col("k").cast("string").alias("g"), "t", "v"), []
        for _ in range(64):
            sizes = keep(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high")))
            targets = targets.join(sizes, "g")
            found.append(targets.where("low = high").select("id", F.col("low").alias("v")))
            few = targets.where(f"low < high and size <= {SPLITS}").select("id", "g", "t", "r")
            ordered = Window.partitionBy("id").orderBy("v")
            met = few.join(rows.withColumnRenamed("t", "at"), "g").where("at < t")
            found.append(met.withColumn("number", F.row_number().over(ordered) - 1).where("number = r").select("id", "v"))
            many = sizes.where(f"low < high and size > {SPLITS}").select("g")
            left, size = measured(many)
            if not left:
                break
            fits = (lambda df: F.broadcast(df)) if small(left, size + 8 * SPLITS * left) else (lambda df: df)  # noqa: B023
            rows = rows.join(fits(many), "g", "left_semi")
            shares = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
            bounds = rows.groupBy("g").agg(F.array_distinct(F.percentile_approx("v", shares, F.lit(20 * SPLITS))).alias("bounds"))
            # A value that is a bound is a part of its own, so every round makes parts smaller or of one value.
            part = 2 * F.size(F.filter("bounds", lambda x: x < F.col("v"))) + F.array_contains("bounds", F.col("v")).cast("int")
            rows = keep(rows.join(fits(bounds), "g").select("g", "t", "v", part.alias("c")))
            targets = keep(targets.where(f"low < high and size > {SPLITS}").select("id", "g", "t", "r"))
            parts = rows.groupBy("g").agg(F.collect_set("c").alias("cs"))
            asked = targets.select("g", "t").distinct().join(fits(parts), "g").select("g", "t", F.explode("cs").alias("c"))
            counts_of = self._before(rows, asked, ["g", "c"], {"n": F.count(F.lit(1))}, {"n": F.sum})
            upto = Window.partitionBy("g", "t").orderBy("c")
            counts_of = counts_of.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
            placed = targets.join(counts_of, ["g", "t"]).where("before <= r and r < upto")
            inner = F.concat_ws("/", "g", F.col("c").cast("string"))
            targets = placed.select("id", inner.alias("g"), "t", (F.col("r") - F.col("before")).alias("r"))
            rows = rows.select(inner.alias("g"), "t", "v")
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        met = sought.join(every.select("id.k", "id.t", "id.r", "v"), ["k", "t", "r"], "left").withColumn("v", F.when(F.col("r") >= F.col("numbers"), F.lit(float("nan"))).otherwise(F.col("v")))
        sides = [F.max(F.when(F.col("a") == f"{a}_{side}", F.col("v"))).alias(f"{a}_{side}") for a in wanted for side in ("lo", "hi")]
        out = met.groupBy("k", "t").agg(F.max("n").alias("n"), *sides)
        share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
        low, high = lambda a: F.col(f"{a}_lo"), lambda a: F.col(f"{a}_hi")
        return out.select("k", "t", *[F.when(low(a) == high(a), low(a)).otherwise(low(a) + (high(a) - low(a)) * share(q)).alias(a) for a, q in wanted.items()])


def _steps(base: Feature | None) -> bool:
    """Whether a feature is an aggregate of columns of a child's own children, so that it changes only where one of these appears."""
    return isinstance(base, Aggregate) and len(base.edges) == 1 and (base.base is None or isinstance(base.base, Identity))


def _field(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def _combined(how: Callable, a: Column, b: Column) -> Column:
    """One aggregate of two, either of which may be NULL."""
    both = {F.sum: a + b, F.product: a * b}.get(how)
    if both is None:
        both = F.when((a <= b) if how is F.min else (a >= b), a).otherwise(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)

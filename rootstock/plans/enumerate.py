"""Enumeration of features: pure planning over the schema, no Spark job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from rootstock.functions.primitives import ANY, ARRAY, CATEGORY, NUMERIC, TEXT, Primitive
from rootstock.plans.nodes import Aggregate, Direct, Edge, Feature, Identity, leaf
from rootstock.schema import ColumnSchema, ColumnType, RdbMeta

KEY, TIME, OTHER = "key", "datetime", "other"


def tag_of(c: ColumnSchema, arrays: frozenset[str] = frozenset()) -> str:
    """What primitives may see in a column."""
    if c.dtype == ColumnType.FLOAT:
        return ARRAY if c.name in arrays else NUMERIC
    return {ColumnType.CATEGORY: CATEGORY, ColumnType.TEXT: TEXT, ColumnType.DATETIME: TIME, ColumnType.TIMESTAMP: OTHER}.get(c.dtype, KEY)


@dataclass(frozen=True)
class Rules:
    """How far and where enumeration goes."""

    primitives: Sequence[Primitive]
    multi_hop: bool = False
    include: frozenset[str] | None = None
    ignore: frozenset[str] = frozenset()

    def open(self, table: str) -> bool:
        return table not in self.ignore and (self.include is None or table in self.include)


class Enumerator:
    """All features of a table up to a depth: columns, look-ups, then aggregates, each table at most once on a path."""

    def __init__(self, meta: RdbMeta, rules: Rules, arrays: dict[str, frozenset[str]] | None = None):
        self.meta, self.rules, self.arrays = meta, rules, arrays or {}
        known = {t.name for t in meta.tables}
        self.edges = [Edge(*r) for r in meta.relationships if r.child_table != r.parent_table and r.parent_table in known]

    def features(self, table: str, depth: int, path: frozenset[str] = frozenset()) -> list[Feature]:
        schema = self.meta.get_table_schema(table)
        keys = {schema.primary_key, *(c.name for c in schema.foreign_keys)}
        arrays = self.arrays.get(table, frozenset())
        out: list[Feature] = [Identity(table, c.name, tag_of(c, arrays), c.name in keys) for c in schema.columns]
        if depth < 1:
            return out
        path = path | {table}
        ups = [e for e in self.edges if e.child == table and e.parent not in path and self.rules.open(e.parent)]
        for e in ups:
            label = e.parent if sum(x.parent == e.parent for x in ups) == 1 else f"{e.parent}[{e.column}]"
            out += [Direct(e, f, label) for f in self.features(e.parent, depth - 1, path)]
        downs = [(e,) for e in self.edges if e.parent == table and e.child not in path and self.rules.open(e.child)]
        if self.rules.multi_hop:
            downs += self._deeper(downs, path)
        for edges in downs:
            child = edges[-1].child
            same = [x for x in downs if x[-1].child == child]
            label = child if len(same) == 1 else f"{child}[{'/'.join(e.column for e in reversed(edges))}]"
            out += self._aggregates(edges, label, depth, path | {e.child for e in edges[:-1]})
        return out

    def _deeper(self, first: list[tuple[Edge, ...]], path: frozenset[str]) -> list[tuple[Edge, ...]]:
        """Chains of two and more downward edges."""
        out, chains = [], first
        while chains:
            longer = []
            for c in chains:
                seen = path | {e.child for e in c}
                longer += [(*c, e) for e in self.edges if e.parent == c[-1].child and e.child not in seen and self.rules.open(e.child)]
            out += longer
            chains = longer
        return out

    def _aggregates(self, edges: tuple[Edge, ...], label: str, depth: int, path: frozenset[str]) -> list[Feature]:
        bases = [f for f in self.features(edges[-1].child, depth - 1, path) if not ((x := leaf(f)) is not None and x.is_key)]
        timed = self.meta.get_table_schema(edges[-1].child).time_column is not None
        out: list[Feature] = []
        for p in self.rules.primitives:
            if ANY in p.takes:
                out.append(Aggregate(edges, p, None, label))
            elif timed or not p.needs_time:
                out += [Aggregate(edges, p, f, label) for f in bases if f.tag in p.takes]
        return out


def target_features(meta: RdbMeta, mappings: dict[str, str], depth: int, rules: Rules, max_features: int = -1, arrays: dict[str, frozenset[str]] | None = None) -> dict[str, tuple[str, Feature]]:
    """Output name -> (target column, feature of the mapped table), in a fixed order. Keys themselves aren't features."""
    found: dict[str, tuple[str, Feature]] = {}
    tables = [m.rpartition(".")[0] for m in mappings.values()]
    if depth < 1:
        return found
    maker = Enumerator(meta, rules, arrays)
    for (column, _), table in zip(mappings.items(), tables, strict=True):
        if not rules.open(table):
            continue
        label = table if tables.count(table) == 1 else f"{table}[{column}]"
        for f in maker.features(table, depth - 1, frozenset()):
            if (x := leaf(f)) is not None and x.is_key:
                continue
            name = f"{label}.{f.name}"
            if name in found:
                raise ValueError(f"two features are named {name}")
            found[name] = (column, f)
    return dict(list(found.items())[:max_features]) if max_features >= 0 else found

"""Feature trees. A feature is a column, a look-up of a parent's feature or an aggregate of children's features."""

from __future__ import annotations

from dataclasses import dataclass

from rootstock.functions.primitives import ANY, Primitive


@dataclass(frozen=True)
class Edge:
    """A foreign key `child.column -> parent.key`, walked up (look-up) or down (aggregation)."""

    child: str
    column: str
    parent: str
    key: str


@dataclass(frozen=True)
class Identity:
    table: str
    column: str
    tag: str
    is_key: bool = False

    @property
    def name(self) -> str:
        return self.column


@dataclass(frozen=True)
class Direct:
    """The parent's feature, seen from the child. `label` is the parent's name, qualified where two keys lead to it."""

    edge: Edge
    base: Feature
    label: str

    @property
    def name(self) -> str:
        return f"{self.label}.{self.base.name}"

    @property
    def tag(self) -> str:
        return self.base.tag


@dataclass(frozen=True)
class Aggregate:
    """A primitive over the children along `edges`, the last of which starts at the leaf; base None counts rows."""

    edges: tuple[Edge, ...]
    primitive: Primitive
    base: Feature | None
    label: str

    @property
    def name(self) -> str:
        inner = self.label if self.base is None else f"{self.label}.{self.base.name}"
        return f"{self.primitive.name.upper()}({inner})"

    @property
    def tag(self) -> str:
        if self.primitive.gives != "category" or self.base is None:
            return self.primitive.gives
        return self.base.tag if ANY not in self.primitive.takes else self.primitive.gives


Feature = Identity | Direct | Aggregate


def leaf(f: Feature) -> Identity | None:
    """The column at the bottom; None for a count."""
    while not isinstance(f, Identity):
        if f.base is None:
            return None
        f = f.base
    return f


def counts(f: Feature) -> bool:
    """Whether the nearest aggregation is a count, so that nothing found means 0."""
    while isinstance(f, Direct):
        f = f.base
    return isinstance(f, Aggregate) and f.primitive.kind == "rows"

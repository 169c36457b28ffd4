"""Semantic schema of a relational database: column types, tables, links, and their YAML form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from enum import StrEnum
from pathlib import Path
from typing import Any

import yaml


class ColumnType(StrEnum):
    """What a column means, apart from how it is stored."""

    FLOAT = "float"
    CATEGORY = "category"
    DATETIME = "datetime"
    TEXT = "text"
    TIMESTAMP = "timestamp"
    FOREIGN_KEY = "foreign_key"
    PRIMARY_KEY = "primary_key"


class TableFormat(StrEnum):
    PARQUET = "parquet"
    NUMPY = "numpy"


# Names that the engine uses itself.
RESERVED = frozenset({"__target__", "__target_index__", "__index__", "__time_for_cutoff__", "__cutoff_time__"})


@dataclass(frozen=True)
class Relationship:
    """A foreign key and the primary key that it points to. Unpacks like the 4-tuple of names."""

    child_table: str
    child_column: str
    parent_table: str
    parent_column: str

    def __iter__(self):
        return iter((self.child_table, self.child_column, self.parent_table, self.parent_column))


@dataclass(frozen=True)
class ColumnSchema:
    """A column; `extra` keeps further declared fields such as capacity, in_size or num_categories."""

    name: str
    dtype: ColumnType | None = None
    link_to: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.dtype is not None:
            object.__setattr__(self, "dtype", ColumnType(self.dtype))

    @property
    def link(self) -> tuple[str, str] | None:
        """(table, column) of link_to; the last dot separates them."""
        if not self.link_to:
            return None
        table, dot, column = self.link_to.rpartition(".")
        if not (table and dot and column):
            raise ValueError(f"link_to of column {self.name} must be table.column, not {self.link_to!r}")
        return table, column

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ColumnSchema:
        return cls(d["name"], d.get("dtype"), d.get("link_to"), {k: v for k, v in d.items() if k not in ("name", "dtype", "link_to")})

    def to_dict(self) -> dict[str, Any]:
        d = {"name": self.name, "dtype": self.dtype and str(self.dtype), "link_to": self.link_to}
        return {k: v for k, v in d.items() if v is not None} | self.extra


@dataclass(frozen=True)
class TableSchema:
    """A table's columns, its time column and where its data lie."""

    name: str
    columns: tuple[ColumnSchema, ...] = ()
    source: str = ""
    format: TableFormat = TableFormat.PARQUET
    time_column: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "format", TableFormat(self.format))
        if not self.source:
            object.__setattr__(self, "source", f"{self.name}.parquet")

    @property
    def column_dict(self) -> dict[str, ColumnSchema]:
        return {c.name: c for c in self.columns}

    @property
    def primary_key(self) -> str | None:
        return next((c.name for c in self.columns if c.dtype == ColumnType.PRIMARY_KEY), None)

    @property
    def foreign_keys(self) -> tuple[ColumnSchema, ...]:
        return tuple(c for c in self.columns if c.dtype == ColumnType.FOREIGN_KEY)

    def with_columns(self, columns: Iterable[ColumnSchema]) -> TableSchema:
        return replace(self, columns=tuple(columns))

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> TableSchema:
        return cls(d["name"], [ColumnSchema.from_dict(c) for c in d.get("columns", [])], d.get("source", ""), d.get("format", "parquet"), d.get("time_column"))

    def to_dict(self) -> dict[str, Any]:
        d = {"name": self.name, "source": self.source, "format": str(self.format), "columns": [c.to_dict() for c in self.columns]}
        return d | ({"time_column": self.time_column} if self.time_column else {})


@dataclass(frozen=True)
class RdbMeta:
    """Names and schemas of all tables."""

    name: str
    tables: tuple[TableSchema, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "tables", tuple(self.tables))
        names = [t.name for t in self.tables]
        if len(names) != len(set(names)):
            raise ValueError(f"table names repeat: {sorted(names)}")

    @property
    def relationships(self) -> list[Relationship]:
        return [Relationship(t.name, c.name, *c.link) for t in self.tables for c in t.foreign_keys if c.link]

    def get_table_schema(self, name: str) -> TableSchema:
        for t in self.tables:
            if t.name == name:
                return t
        raise ValueError(f"Table {name} not found: there are {[t.name for t in self.tables]}")

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> RdbMeta:
        return cls(d["name"], [TableSchema.from_dict(t) for t in d.get("tables", [])])

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "tables": [t.to_dict() for t in self.tables]}

    @classmethod
    def load(cls, path: str | Path) -> RdbMeta:
        return cls.from_dict(load_yaml(path))

    def save(self, path: str | Path) -> None:
        save_yaml(self.to_dict(), path)


def load_yaml(path: str | Path) -> Any:
    with Path(path).open() as f:
        return yaml.safe_load(f)


def save_yaml(value: Any, path: str | Path) -> None:
    with Path(path).open("w") as f:
        yaml.safe_dump(value, f, sort_keys=False)

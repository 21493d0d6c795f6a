"""A database: frames by name, and the keys that their files do not say.

Columns and types are those of the frames' own ``StructType``.  ``Keys`` adds which
columns tell a table's rows apart, which lead to rows of other tables, and which
column is the time of a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


class SchemaError(ValueError):
    """A table, column or key that is unknown, repeated or does not fit."""


@dataclass(frozen=True)
class Link:
    """``columns`` of each row of ``child`` name a row of ``parent`` by its ``key``; no key stands for the parent's id."""

    child: str
    columns: tuple[str, ...]
    parent: str
    key: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return "_".join(self.columns)


@dataclass(frozen=True)
class Keys:
    ids: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    links: tuple[Link, ...] = ()
    times: Mapping[str, str] = field(default_factory=dict)

    def within(self, tables: Iterable[str]) -> Keys:
        """Only what concerns these tables."""
        kept = set(tables)
        pick = lambda m: {t: v for t, v in m.items() if t in kept}
        return Keys(pick(self.ids), tuple(x for x in self.links if {x.child, x.parent} <= kept), pick(self.times))


class Database:
    """Frames with their keys; ``nodes`` names the column of node ids in tables whose own id is no single number."""

    def __init__(self, frames: Mapping[str, DataFrame], keys: Keys = Keys(), nodes: Mapping[str, str] | None = None):
        self.frames, self.nodes = dict(frames), dict(nodes or {})
        links = tuple(x if x.key else replace(x, key=tuple(keys.ids.get(x.parent, ()))) for x in keys.links)
        self.ids, self.links, self.times = {t: tuple(k) for t, k in keys.ids.items()}, links, dict(keys.times)
        used = [*self.ids.items(), *((t, (c,)) for t, c in self.times.items()), *((x.child, x.columns) for x in links), *((x.parent, x.key) for x in links)]
        for table, columns in used:
            self.need(table, *columns)
            if not columns or len(set(columns)) < len(columns):
                raise SchemaError(f"{table}: a key needs columns, each once, not {columns}")
        for x, times in Counter(links).items():
            if times > 1 or len(x.columns) != len(x.key):
                raise SchemaError(f"{x.child}.{x.name} -> {x.parent}: declared twice, or of other length than {x.key}")

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.frames:
            raise SchemaError(f"unknown table {table}; there are {sorted(self.frames)}")
        return self.frames[table]

    @property
    def keys(self) -> Keys:
        return Keys(self.ids, self.links, self.times)

    def need(self, table: str, *columns: str) -> None:
        if missing := [c for c in columns if c not in self[table].columns]:
            raise SchemaError(f"{table} has no columns {missing}")

    def id_of(self, table: str) -> str:
        """The one column that tells a table's nodes apart."""
        if table in self.nodes:
            return self.nodes[table]
        key = self.ids.get(table, ())
        if len(key) != 1:
            raise SchemaError(f"{table}: a node needs one id column; map its key or assign ids first")
        return key[0]

    def only(self, tables: Iterable[str]) -> Database:
        own = {t: self[t] for t in tables}
        return Database(own, self.keys.within(own), {t: c for t, c in self.nodes.items() if t in own})

    def feature_columns(self, table: str, hidden: Iterable[tuple[str, str]] = ()) -> list[str]:
        """Columns that may be features: no keys, none that are hidden."""
        keys = {*self.ids.get(table, ()), *(c for x in self.links if x.child == table for c in x.columns)}
        gone = keys | {c for t, c in hidden if t == table} | {self.nodes.get(table)}
        return [c for c in self[table].columns if c not in gone]

"""SQLite databases as tables of a Spark data source.

A table is read in ranges of row ids, a task each.  Comparisons with literals go into
each range's SELECT, and those of the integer primary key leave out whole ranges.  Keys
are read from the database.  The file must be at the same place for all executors.
"""

from __future__ import annotations

import datetime as dt
import re
import sqlite3
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from tributary.schema import Keys, Link
from tributary.sources.plugin import TableSource, register_source

#: Row ids of a split, and splits of a table at most (ids may have gaps).
SPLIT_ROWS, MOST_SPLITS = 100_000, 2_000
BATCH_ROWS = 8_192
#: More values than this are left to Spark.
MOST_VALUES = 500
#: Julian day of 1970-01-01 at midnight.
JULIAN_EPOCH = 2440587.5

# Comparisons and their SQL.
COMPARISONS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
# Which words of a declared type mean which Spark type, the first match holds.
DECLARED = [("BOOL", T.BooleanType()), ("DATE", T.TimestampNTZType()), ("TIME", T.TimestampNTZType()), ("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("NUM", T.DoubleType()), ("DEC", T.DoubleType())]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """The type of a column by its declaration; one without any, or of an unknown kind, is text."""
    return next((t for word, t in DECLARED if word in declared.upper()), T.StringType())


def as_time(value: object) -> dt.datetime | None:
    """The three forms a time may be stored in: ISO text, seconds since 1970 (integers), Julian days (reals)."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        t = dt.datetime.fromisoformat(value)
        return t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t
    days = value - JULIAN_EPOCH if isinstance(value, float) else None
    return dt.datetime(1970, 1, 1) + (dt.timedelta(seconds=value) if days is None else dt.timedelta(milliseconds=round(days * 86_400_000)))


# How values of each type are taken, and the Arrow type they get.
_TAKEN: dict[type, tuple[pa.DataType, Callable[[object], object]]] = {
    T.LongType: (pa.int64(), lambda v: v),
    T.DoubleType: (pa.float64(), lambda v: v if v is None or isinstance(v, str) else float(v)),
    T.StringType: (pa.string(), lambda v: v if v is None or isinstance(v, str) else str(v)),
    T.BinaryType: (pa.binary(), lambda v: v.encode() if isinstance(v, str) else v),
    T.BooleanType: (pa.bool_(), lambda v: v if v not in (0, 1) else bool(v)),
    T.TimestampNTZType: (pa.timestamp("us"), as_time),
}


class SqliteSource(TableSource):
    def __init__(self, path: str, split_rows: int = SPLIT_ROWS):
        self.path, self.split_rows = re.sub("^sqlite:/{2,3}(?=/)", "", path).removeprefix("sqlite:///"), split_rows
        self._types: dict[str, T.StructType] = {}

    def _ask(self, sql: str, *values: object) -> list[tuple]:
        with closing(self._open()) as db:
            return db.execute(sql, values).fetchall()

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(self.path)}?mode=ro", uri=True)

    def names(self) -> list[str]:
        return [r[0] for r in self._ask("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]

    def schema(self, table: str) -> T.StructType:
        if table not in self._types:
            found = self._ask(f"PRAGMA table_info({quoted(table)})")
            if not found:
                raise KeyError(f"{self.path} has no table {table}")
            self._types[table] = T.StructType([T.StructField(name, spark_type(kind), not needed) for _, name, kind, needed, _, _ in found])
        return self._types[table]

    def keys(self) -> Keys:
        ids, links = {}, []
        for table in self.names():
            key = sorted((place, name) for _, name, _, _, _, place in self._ask(f"PRAGMA table_info({quoted(table)})") if place)
            if key:
                ids[table] = tuple(name for _, name in key)
            found: dict[int, list[tuple]] = {}
            for row in self._ask(f"PRAGMA foreign_key_list({quoted(table)})"):
                found.setdefault(row[0], []).append(row)
            for rows in found.values():
                rows.sort(key=lambda r: r[1])
                links.append(Link(table, tuple(r[3] for r in rows), rows[0][2], tuple(r[4] for r in rows if r[4])))
        return Keys(ids, tuple(sorted(links, key=lambda x: (x.child, x.columns))))

    def _row_id(self, table: str) -> str | None:
        """The column that is the row id by another name."""
        key = [(name, kind) for _, name, kind, _, _, place in self._ask(f"PRAGMA table_info({quoted(table)})") if place]
        return key[0][0] if len(key) == 1 and key[0][1].upper() == "INTEGER" else None

    def answers(self, table: str, test: ds.Filter) -> bool:
        column = getattr(test, "attribute", ())
        if len(column) != 1 or column[0] not in self.schema(table).names:
            return False
        if isinstance(self.schema(table)[column[0]].dataType, T.TimestampNTZType | T.BooleanType):
            return False  # stored in several forms
        if isinstance(test, ds.In):
            return len(test.value) <= MOST_VALUES and None not in test.value
        return isinstance(test, (*COMPARISONS, ds.StringStartsWith, ds.IsNull, ds.IsNotNull))

    def _where(self, tests: Sequence[ds.Filter]) -> tuple[str, list[object]]:
        parts, values = [], []
        for t in tests:
            column = f"{quoted(t.attribute[0])} COLLATE BINARY"
            if isinstance(t, ds.In):
                parts.append(f"{column} IN ({', '.join('?' * len(t.value))})")
                values += t.value
            elif isinstance(t, ds.IsNull | ds.IsNotNull):
                parts.append(f"{quoted(t.attribute[0])} IS {'NOT ' if isinstance(t, ds.IsNotNull) else ''}NULL")
            elif isinstance(t, ds.StringStartsWith):
                parts.append(f"substr({quoted(t.attribute[0])}, 1, ?) = ? COLLATE BINARY")
                values += [len(t.value), t.value]
            else:
                parts.append(f"{column} {COMPARISONS[type(t)]} ?")
                values.append(t.value)
        return " AND ".join(parts), values

    def splits(self, table: str, tests: Sequence[ds.Filter]) -> list[object]:
        """Ranges of row ids, ends included; a table without row ids, or a view, is one split."""
        try:
            low, high = self._ask(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}")[0]
        except sqlite3.OperationalError:
            return ["whole"]
        if low is None or not isinstance(low, int):
            return [] if self._ask(f"SELECT count(*) FROM {quoted(table)}")[0][0] == 0 else ["whole"]
        own = self._row_id(table)
        for t in tests:
            if own and t.attribute[0] == own and isinstance(getattr(t, "value", None), int):
                if isinstance(t, ds.EqualTo | ds.GreaterThan | ds.GreaterThanOrEqual):
                    low = max(low, t.value + isinstance(t, ds.GreaterThan))
                if isinstance(t, ds.EqualTo | ds.LessThan | ds.LessThanOrEqual):
                    high = min(high, t.value - isinstance(t, ds.LessThan))
        width = max(self.split_rows, -(-(high - low + 1) // MOST_SPLITS))
        return [(a, min(a + width - 1, high)) for a in range(low, high + 1, width)]

    def scan(self, table: str, columns: Sequence[str], split: object, tests: Sequence[ds.Filter]) -> Iterator[pa.RecordBatch]:
        where, values = self._where(tests)
        parts = [where] if where else []
        if split != "whole":
            parts.append("rowid BETWEEN ? AND ?")
            values += split
        sql = f"SELECT {', '.join(map(quoted, columns))} FROM {quoted(table)}" + (f" WHERE {' AND '.join(parts)}" if parts else "")
        taken = [_TAKEN[type(self.schema(table)[c].dataType)] for c in columns]
        with closing(self._open()) as db:
            cursor = db.execute(sql, values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                arrays = []
                for c, (kind, take), cells in zip(columns, taken, zip(*rows, strict=True), strict=True):
                    try:
                        arrays.append(pa.array([take(v) for v in cells], kind))
                    except (pa.ArrowException, TypeError, ValueError) as e:
                        raise ValueError(f"{table}.{c}: a value is no {kind}: {e}") from e
                yield pa.RecordBatch.from_arrays(arrays, names=list(columns))


def make(options: Mapping[str, str]) -> SqliteSource:
    return SqliteSource(options["path"], int(options.get("split_rows", SPLIT_ROWS)))


register_source("sqlite", make)

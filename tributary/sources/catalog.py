"""Datasets on disk: tables, tasks and a catalogue of five small tables beside them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.encodings import Encoding, decode_frame, encode_frame
from tributary.functions.scalars import encoding_of
from tributary.operators.checks import violations
from tributary.operators.keys import NODE_ID, assign_dense_ids
from tributary.schema import Database, Keys, Link, SchemaError
from tributary.sources.readers import Reader, exists, listing, register_reader
from tributary.sources.versions import Versions

VERSION = "1"
RESERVED = ("_catalog_metadata", "_catalog_tables", "_catalog_columns", "_catalog_foreign_keys", "_catalog_tasks")
ROW_ID = "__target_row_id__"

# Catalogued tasks (kind, name, entity, target) whose entity holds the target though the catalogue does not hide it.
TARGETS_LEFT_IN = {("external", "beer_ratings-total_score", "beer_ratings", "total_score")}


@dataclass(frozen=True)
class Task:
    """A prediction task: rows of a table, an entity, a target, and where rows belong."""

    name: str
    table: str
    task_type: str
    entity_table: str
    entity_column: str
    target_column: str
    time_column: str | None = None
    destination_table: str | None = None
    split_column: str = "split"
    extra: Mapping[str, object] = field(default_factory=dict)

    def hides(self) -> list[tuple[str, str]]:
        """(table, column) of all that no feature may come from: what the catalogue lists, and the
        target where the entity itself has it."""
        listed = self.extra.get("hidden_columns") or ()
        if not isinstance(listed, (list, tuple)) or not all(isinstance(p, (list, tuple)) and len(p) == 2 for p in listed):
            raise TypeError(f"task {self.name}: hidden_columns lists pairs of table and column")
        kind, own = self.extra.get("kind"), (self.entity_table, self.target_column)
        if kind != "autocomplete" and (kind, self.name, *own) not in TARGETS_LEFT_IN:
            own = ()
        elif not all(own):
            raise ValueError(f"task {self.name}: predicting a column of the entity takes both names")
        return sorted({(str(t), str(c)) for t, c in listed} | ({own} if own else set()))


@dataclass
class Dataset:
    """A database with task tables and metadata; names that the catalogue uses are rejected."""

    database: Database
    tasks: dict[str, Task] = field(default_factory=dict)
    task_frames: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        names = [*self.database.frames, *self.task_frames]
        if bad := sorted({*names} & {*RESERVED}):
            raise SchemaError(f"reserved table names {bad}")
        if repeated := sorted({n for n in names if names.count(n) > 1}):
            raise SchemaError(f"table names repeat: {repeated}")
        for t in self.tasks.values():
            if t.table not in self.task_frames:
                raise SchemaError(f"task {t.name}: no table {t.table}")


def task_table_name(task: str, tasks: int) -> str:
    """One task has ``target_table``, several have ``target_<name>``."""
    slug = "".join(c if c.isalnum() else "_" for c in task).strip("_").lower()
    return "target_table" if tasks == 1 else f"target_{slug}"


def union_splits(splits: Mapping[str, DataFrame], order: Sequence[str] | None = None) -> DataFrame:
    """Rows of all splits with ``split`` and a dense row id."""
    out = None
    for name, df in splits.items():
        if {"split", ROW_ID} & set(df.columns):
            raise SchemaError("split and the row id are reserved column names")
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return assign_dense_ids(out, list(order) if order else None, ROW_ID)


def with_ids(db: Database) -> Database:
    """Tables without an id get dense ones."""
    bare = [t for t in db.frames if t not in db.ids]
    frames = db.frames | {t: assign_dense_ids(db[t]) for t in bare}
    return Database(frames, Keys(db.ids | {t: (NODE_ID,) for t in bare}, db.links, db.times))


def _rows(spark: SparkSession, dataset: Dataset) -> dict[str, DataFrame]:
    """The five tables of the catalogue."""
    db = dataset.database
    tables, columns, keys = [], [], []
    for name, df in db.frames.items():
        key = json.dumps(db.ids.get(name, ()))
        tables.append((name, "data", None, None, key, key, db.times.get(name)))
        columns += [(name, f.name, i, f.dataType.simpleString(), f.nullable, encoding_of(f.dataType.simpleString())) for i, f in enumerate(df.schema.fields)]
        keys += [(name, i, json.dumps(x.columns), x.parent, json.dumps(x.key)) for i, x in enumerate(x for x in db.links if x.child == name)]
    for t in dataset.tasks.values():
        tables.append((t.table, "task", t.name, t.split_column, "[]", "[]", t.time_column))
        columns += [(t.table, f.name, i, f.dataType.simpleString(), f.nullable, encoding_of(f.dataType.simpleString())) for i, f in enumerate(dataset.task_frames[t.table].schema.fields)]
    tasks = [(t.name, t.table, t.task_type, t.entity_table, t.entity_column, t.target_column, t.time_column, t.destination_table, t.split_column, json.dumps(dict(t.extra))) for t in dataset.tasks.values()]
    make = spark.createDataFrame
    return {
        RESERVED[0]: make(sorted((dataset.metadata | {"version": VERSION}).items()), "key string, value string"),
        RESERVED[1]: make(tables, "name string, kind string, task string, split_column string, primary_key string, identity_key string, time_column string"),
        RESERVED[2]: make(columns, "table string, name string, ordinal int, type string, nullable boolean, encoding string"),
        RESERVED[3]: make(keys, "table string, ordinal int, columns string, target string, target_columns string"),
        RESERVED[4]: make(tasks, "name string, table string, task_type string, entity_table string, entity_column string, target_column string, time_column string, destination_table string, split_column string, extra string"),
    }


def write_dataset(dataset: Dataset, path: str, *, overwrite: bool = False, check_keys: bool = True, as_text: bool = False) -> str:
    """Write tables, task tables and the catalogue as a new version of the dataset at ``path``.

    The version becomes visible when all is written, so a crash leaves the dataset that was
    there.  Tables of one id are sorted by it over ranges, so readers that ask for ranges of ids skip
    row groups.  ``as_text`` stores every column in the form of its encoding, which readers decode.
    """
    db = with_ids(dataset.database)
    spark = next(iter(db.frames.values())).sparkSession
    versions = Versions(spark, path)
    last = max(versions.numbers(), default=0)
    if not overwrite and (last or exists(spark, path)):
        raise FileExistsError(path)
    if check_keys and db.links and (bad := violations(db).filter("n > 0").collect()):
        raise SchemaError("; ".join(f"{r['child']}.{r['fk']}: {r['n']} rows without {r['parent']}" for r in bad))
    whole = Dataset(db, dataset.tasks, dataset.task_frames, dataset.metadata)
    places = {}
    for name, df in (db.frames | dataset.task_frames | _rows(spark, whole)).items():
        key = db.ids.get(name, ()) if name in db.frames else ()
        if len(key) == 1:
            df = df.repartitionByRange(key[0]).sortWithinPartitions(key[0])
        if as_text and name not in RESERVED:
            df, _ = encode_frame(df)
        places[name] = versions.new_folder(name)
        df.write.parquet(places[name])
    versions.publish(places, last)
    return path


def is_dataset(spark: SparkSession, path: str) -> bool:
    return bool(Versions(spark, path).numbers())


class DatasetReader(Reader):
    """A dataset that ``write_dataset`` made, at the version that was the last when it was opened: tables, keys and tasks."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path.rstrip("/")
        self.versions = Versions(spark, self.path)
        self.version = max(self.versions.numbers(), default=0)
        if not self.version:
            raise FileNotFoundError(f"{path}: no dataset")
        self._places = self.versions.tables(self.version)
        if (v := self.metadata().get("version", VERSION)) != VERSION:
            raise SchemaError(f"catalogue of version {v}, not {VERSION}")

    def _catalog(self, k: int) -> list:
        return self.spark.read.parquet(self._places[RESERVED[k]]).collect()

    def metadata(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self._catalog(0)}

    def table(self, name: str) -> DataFrame:
        """A table, its columns in order and decoded where they are stored in the form of their encoding."""
        self._check()
        df = self.spark.read.parquet(self._places[name])
        known = sorted((r for r in self._catalog(2) if r["table"] == name), key=lambda r: r["ordinal"])
        stored = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        coded = {r["name"]: Encoding(r["encoding"], r["type"]) for r in known if stored.get(r["name"]) != r["type"]}
        return decode_frame(df.select(*[r["name"] for r in known]) if known else df, coded)

    def names(self) -> list[str]:
        return sorted(r["name"] for r in self._catalog(1))

    def keys(self) -> Keys:
        rows = [r for r in self._catalog(1) if r["kind"] == "data"]
        ids = {r["name"]: tuple(json.loads(r["identity_key"])) for r in rows if json.loads(r["identity_key"])}
        links = sorted(self._catalog(3), key=lambda r: (r["table"], r["ordinal"]))
        links = tuple(Link(r["table"], tuple(json.loads(r["columns"])), r["target"], tuple(json.loads(r["target_columns"]))) for r in links)
        return Keys(ids, links, {r["name"]: r["time_column"] for r in rows if r["time_column"]})

    def database(self) -> Database:
        return Database({r["name"]: self.table(r["name"]) for r in self._catalog(1) if r["kind"] == "data"}, self.keys())

    def hidden(self, table: str, task: str | None = None) -> list[tuple[str, str]]:
        return sorted({h for t in self.tasks().values() if t.table == table and task in (None, t.name) for h in t.hides()})

    def tasks(self) -> dict[str, Task]:
        return {r["name"]: Task(*[r[c] for c in ("name", "table", "task_type", "entity_table", "entity_column", "target_column", "time_column", "destination_table", "split_column")], json.loads(r["extra"])) for r in self._catalog(4)}

    def task_splits(self, name: str) -> dict[str, DataFrame]:
        """The rows of each split, without the split and the row id."""
        t = self.tasks()[name]
        df = self.table(t.table)
        names = [r[0] for r in df.select(t.split_column).distinct().collect()]
        return {n: df.filter(F.col(t.split_column) == n).drop(t.split_column, ROW_ID) for n in sorted(names)}

    def update_extra(self, name: str, changes: Mapping[str, object]) -> None:
        """Merge fields into a task's ``extra``, as a version of its own that this reader then reads."""
        rows = [r.asDict() for r in self._catalog(4)]
        for r in rows:
            if r["name"] == name:
                r["extra"] = json.dumps(json.loads(r["extra"]) | dict(changes))
        schema = self.spark.read.parquet(self._places[RESERVED[4]]).schema
        places = self._places | {RESERVED[4]: self.versions.new_folder(RESERVED[4])}
        self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema).write.parquet(places[RESERVED[4]])
        self.version, self._places = self.versions.publish(places, self.version), places


def load_folder(spark: SparkSession, path: str, keys: Keys, tasks: Mapping[str, Task] | None = None, *, val_timestamp: str | None = None, test_timestamp: str | None = None) -> Dataset:
    """A dataset from plain files: ``db/<table>.parquet``, and ``tasks/<task>/<split>.parquet`` for each of ``tasks``.

    Rows of a task's splits become one table with ``split`` and a row id; tables without an id get one.
    """
    frames = {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/db/{n}") for n, _ in listing(spark, f"{path}/db") if n.endswith(".parquet")}
    found, task_frames = {}, {}
    for name, task in (tasks or {}).items():
        splits = {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/tasks/{name}/{n}") for n, _ in listing(spark, f"{path}/tasks/{name}") if n.endswith(".parquet")}
        if not splits:
            raise SchemaError(f"task {name}: no splits in {path}/tasks/{name}")
        table = task_table_name(name, len(tasks))
        found[name], task_frames[table] = replace(task, name=name, table=table, split_column="split"), union_splits(splits)
    times = {"val_timestamp": val_timestamp, "test_timestamp": test_timestamp}
    return Dataset(with_ids(Database(frames, keys)), found, task_frames, {k: v for k, v in times.items() if v})


def discover_datasets(spark: SparkSession, roots: Iterable[str]) -> dict[str, str]:
    """Folders with a catalogue, by name; the first root that has a name holds."""
    found: dict[str, str] = {}
    for root in roots:
        for name, folder in listing(spark, root):
            if folder and is_dataset(spark, f"{root}/{name}"):
                found.setdefault(name, f"{root}/{name}")
    return found


def materialize_all(spark: SparkSession, loaders: Mapping[str, Callable[[], Dataset]], target: str, *, limit: int | None = None, fail_fast: bool = False) -> dict[str, str]:
    """Write every dataset that is not there yet; the errors of those that failed, by name."""
    errors: dict[str, str] = {}
    for name in sorted(loaders)[:limit]:
        if is_dataset(spark, f"{target}/{name}"):
            continue
        try:
            write_dataset(loaders[name](), f"{target}/{name}", overwrite=True)
        except Exception as e:
            if fail_fast:
                raise
            errors[name] = str(e)
    return errors


_WRITERS: dict[str, Callable[..., str]] = {"parquet": write_dataset}


def register_writer(name: str, write: Callable[..., str]) -> None:
    _WRITERS[name.lower()] = write


def writer(name: str) -> Callable[..., str]:
    if name.lower() not in _WRITERS:
        raise ValueError(f"unknown writer {name!r}; there are {sorted(_WRITERS)}")
    return _WRITERS[name.lower()]


register_reader("dataset", DatasetReader)

"""The public flow: connect, discover the schema, validate the task, prepare the graph, plan features, read batches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import RunConfig, SplitConfig, TaskConfig
from tributary.functions.scalars import seconds
from tributary.operators import checks, graph, processors, sampling, seeds, splits, stats
from tributary.operators.features import attach
from tributary.operators.keys import NODE_ID, assign_dense_ids, with_node_ids
from tributary.operators.processors import DEFAULTS, Processor
from tributary.schema import Database, Keys, Link, SchemaError
from tributary.session import cut, together
from tributary.sources import catalog  # noqa: F401 - registers the reader of datasets
from tributary.sources.arrowstream import arrow_stream
from tributary.sources.artifacts import ArtifactError, load_json, save_json
from tributary.sources.encoded import EncodedStore
from tributary.sources.readers import Reader, batches, open_database


def connect(spark: SparkSession, config: RunConfig) -> Reader:
    return open_database(spark, config.database.url, reader=config.database.reader)


def merged_keys(declared: Keys, own: Keys) -> Keys:
    """Keys of a configuration over those a database declares; a table's id or time, and a link's columns, are replaced."""
    said = {(x.child, x.columns) for x in own.links}
    links = [*own.links, *(x for x in declared.links if (x.child, x.columns) not in said)]
    return Keys({**declared.ids, **own.ids}, tuple(links), {**declared.times, **own.times})


def discover(reader: Reader, config: RunConfig) -> Database:
    """Tables and keys, declared by the database or the configuration.

    Data tables without an id get dense ones; so do, beside their own, tables whose id is
    text or several columns.  Task tables stay as they are.
    """
    frames, keys = reader.tables(), merged_keys(reader.keys(), config.schema)
    bare = [t for t in frames if t not in keys.ids and t != config.task.table]
    frames |= {t: assign_dense_ids(frames[t]) for t in bare}
    db = Database(frames, Keys({**keys.ids, **{t: (NODE_ID,) for t in bare}}, keys.links, keys.times))
    return with_node_ids(db, [t for t in db.ids if t != config.task.table])


@dataclass(frozen=True)
class ValidatedTask:
    """A task whose columns and keys exist, with its entity's key and all columns it hides."""

    task: TaskConfig
    entity: Link
    destination: Link | None
    hidden: tuple[tuple[str, str], ...]


def _only_link(db: Database, child: str, columns: tuple[str, ...], parent: str) -> Link:
    """The link of those columns to that table; it must lead to the table's id."""
    found = [x for x in db.links if x.child == child and x.parent == parent and (not columns or x.columns == tuple(columns))]
    if len(found) != 1 or set(found[0].key) != set(db.ids.get(parent, ())):
        raise SchemaError(f"{child}: not one link {columns} to the id of {parent}, but {len(found)} links")
    return found[0]


def validate_task(db: Database, task: TaskConfig, hidden: tuple[tuple[str, str], ...] = ()) -> ValidatedTask:
    """The structural checks: columns, roles that differ, one link to the entity (and the destination), hidden columns."""
    roles = [*task.entity_columns, *(c for c in (task.target, task.time, task.split.column) if c)]
    db.need(task.table, *task.key, *roles)
    if task.target in task.key:
        raise SchemaError(f"{task.table}: the target {task.target} is part of the key")
    if len(set(roles)) < len(roles):
        raise checks.TaskError(f"{task.table}: entity, target, time and split are columns of their own, not {roles}")
    entity = _only_link(db, task.table, task.entity_columns, task.entity_table)
    destination = None
    if task.destination_table and (task.destination_columns or any(x.child == task.table and x.parent == task.destination_table for x in db.links)):
        destination = _only_link(db, task.table, task.destination_columns, task.destination_table)
    elif task.destination_table:  # lists of destinations, in the target
        db.id_of(task.destination_table)
    for table, column in hidden:
        db.need(table, column)
    automatic = [(task.table, c) for c in (task.target, task.split.column, task.time) if c]
    return ValidatedTask(task, entity, destination, tuple(dict.fromkeys([*automatic, *hidden])))


def split_rows(db: Database, task: TaskConfig) -> DataFrame:
    """The task's rows with ``split``."""
    rows, how = db[task.table], task.split
    if how.column:
        return splits.column_split(rows.withColumnRenamed(how.column, "__split"), "__split", how.values).drop("__split")
    if how.queries:
        return splits.query_split(rows, list(task.key), {k: _keys(db, q, task) for k, q in how.queries.items()}, label=task.target, time=task.time, fraction=how.fraction, seed=how.seed)
    return splits.default_split(rows, list(task.key), time=task.time, label=task.target, fraction=how.fraction, seed=how.seed)


def _keys(db: Database, query: str, task: TaskConfig) -> DataFrame:
    """Keys of a split query over the database's tables."""
    return splits.query_keys(db[task.table].sparkSession, db.frames, query, list(task.key))


def check_data(db: Database, valid: ValidatedTask, rows: DataFrame) -> DataFrame:
    """The checks of the data; (key, split)."""
    t = valid.task
    entity, destination = valid.entity, valid.destination
    checks.check_entity(db[entity.parent], list(entity.key))
    if t.destination_table:
        parent = db[t.destination_table]
        if destination:
            bad = checks.orphans(rows, list(destination.columns), parent, list(destination.key))
        else:
            bad = checks.unknown_destinations(rows, t.target, parent, db.id_of(t.destination_table))
        if bad.limit(1).count():
            raise checks.TaskError(f"destinations that are no rows of {t.destination_table}")
    return checks.check_task(rows, list(t.key), list(t.entity_columns), db[entity.parent], list(entity.key), t.target, t.task_type, t.time)


class Seeder(Protocol):
    """Rows to train on: (epoch, batch, pos, tree_id, node_type, node_id, seed_time, target)."""

    def __call__(self, data: PreparedDataset, epoch: int, split: str) -> DataFrame: ...


class Sampler(Protocol):
    """Nodes (tree_id, node_type, node_id, hop) and edges (tree_id, edge_type, src_id, dst_id, hop) around seeds."""

    def __call__(self, data: PreparedDataset, own: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]: ...


class Assembler(Protocol):
    """Features of sampled nodes, a frame for each table with ``tree_id`` and ``node_id``."""

    def __call__(self, data: PreparedDataset, nodes: DataFrame) -> dict[str, DataFrame]: ...


def node_ids(db: Database, rows: DataFrame, link: Link, name: str = "node_id") -> DataFrame:
    """``rows`` with the node id of the row each one's link leads to."""
    own = db.id_of(link.parent)
    if link.key == (own,):
        return rows.withColumn(name, F.col(link.columns[0]).cast("bigint"))
    known = db[link.parent].select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(link.key)], F.col(own).cast("bigint").alias(name))
    same = [rows[c] == known[f"__k{i}"] for i, c in enumerate(link.columns)]
    return rows.join(known, same).drop(*[f"__k{i}" for i in range(len(link.key))])


def shuffled_blocks(data: PreparedDataset, epoch: int, split: str) -> DataFrame:
    """Each row of the split once, shuffled by blocks; targets in the type their task trains on."""
    t, s = data.valid.task, data.config.sampling
    rows = assign_dense_ids(data.rows.filter(F.col("split") == split), list(t.key), "__seed")
    order = seeds.epoch_order(rows, "__seed", epoch=epoch, batch_size=s.batch_size, block_rows=s.block_rows, seed=s.seed, max_batches=s.max_batches)
    time = seconds(t.time) if t.time else F.lit((1 << 62))
    rows = node_ids(data.db, seeds.target_value(rows, t.target, t.task_type), data.valid.entity)
    own = rows.select("__seed", F.lit(t.entity_table).alias("node_type"), "node_id", time.alias("seed_time"), F.col(t.target).alias("target"))
    return order.join(own, order["key"] == own["__seed"]).select("epoch", "batch", "pos", F.col("key").alias("tree_id"), "node_type", "node_id", "seed_time", "target")


def temporal_hops(data: PreparedDataset, own: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
    s = data.config.sampling
    return sampling.khop(own, data.edges, s.num_neighbors, base_seed=s.seed + epoch)


def gathered(data: PreparedDataset, nodes: DataFrame) -> dict[str, DataFrame]:
    return attach(nodes, {t: data.encoded(t) for t in data.types})


@dataclass(frozen=True)
class Batch:
    """One batch as Arrow tables: its seeds, the edges and the features of the nodes around them."""

    epoch: int
    batch: int
    seeds: pa.Table
    edges: pa.Table
    features: Mapping[str, pa.Table]


@dataclass
class PreparedDataset:
    """Nodes and edges of the graph, seeds by epoch, and encoded features to join to what is sampled.

    ``seeder``, ``sampler`` and ``assembler`` may be any others of their protocols.
    """

    db: Database
    valid: ValidatedTask
    rows: DataFrame
    nodes: DataFrame
    edges: DataFrame
    types: Mapping[str, Mapping[str, str]]
    config: RunConfig
    seeder: Seeder = shuffled_blocks
    sampler: Sampler = temporal_hops
    assembler: Assembler = gathered
    store: EncodedStore | None = None
    fitted: dict[str, list[Processor]] = field(default_factory=dict)
    _encoded: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)

    def report(self) -> DataFrame:
        return graph.report(self.nodes, self.edges)

    def seeds(self, epoch: int, split: str = "train") -> DataFrame:
        return self.seeder(self, epoch, split)

    def train_rows(self, table: str) -> DataFrame:
        """The table's rows that are no later than the last row to train on; a table without times is seen whole."""
        time, task_time = self.db.times.get(table), self.valid.task.time
        if not time or not task_time:
            return self.db[table]
        last = self.rows.filter("split = 'train'").agg(F.max(task_time)).scalar()
        return self.db[table].filter(F.col(time) <= last)

    def processors(self, table: str) -> list[Processor]:
        """The table's processors, as configured or by type, fitted once on rows visible at train time."""
        if table not in self.fitted:
            chosen = {f.column: (f.processor, f.params) for f in self.config.features if f.table == table}
            self.fitted[table] = processors.fit_all(self.train_rows(table), processors.plan(self.types[table], chosen))
        return self.fitted[table]

    def fit(self) -> dict[str, list[Processor]]:
        """Fit the processors of all tables, side by side."""
        return dict(zip(self.types, together(self.processors, self.types), strict=True))

    def save_processors(self, path: str, identity: object) -> None:
        processors.save(self.db[next(iter(self.db.frames))].sparkSession, path, self.fit(), identity)

    def load_processors(self, path: str, identity: object) -> None:
        """Use processors that were saved instead of fitting; their columns must be those of this plan."""
        found = processors.load(self.db[next(iter(self.db.frames))].sparkSession, path, identity)
        if {t: [p.column for p in ps] for t, ps in found.items()} != {t: list(k) for t, k in self.types.items()}:
            raise ArtifactError(f"{path}: processors of other columns")
        self.fitted = found

    def encoded(self, table: str) -> tuple[DataFrame, str]:
        """(the table's features as an array for each semantic type, its key), encoded once; columns a store has are read from it."""
        if table not in self._encoded:
            df, key, own = self.db[table], self.db.id_of(table), self.processors(table)
            wide = self.store.columns(table, df, key, own) if self.store else processors.transform_all(df, key, own)
            out = processors.assemble(wide, key, own)
            self._encoded[table] = (out if self.store else cut(out), key)
        return self._encoded[table]

    def sample(self, epoch: int, split: str = "train") -> tuple[DataFrame, DataFrame, DataFrame]:
        """Seeds, sampled nodes and sampled edges of an epoch."""
        own = self.seeds(epoch, split)
        return own, *self.sampler(self, own, epoch)

    def features(self, nodes: DataFrame) -> dict[str, DataFrame]:
        return self.assembler(self, nodes)

    def batches(self, epoch: int, table: str, split: str = "train", rows: int = 10_000) -> Iterator[pd.DataFrame]:
        """Features of an epoch's sampled nodes of one table, in order of batch, in frames a trainer can take."""
        own, nodes, _ = self.sample(epoch, split)
        found = self.features(nodes)[table].join(own.select("epoch", "batch", "pos", "tree_id"), "tree_id")
        yield from batches(found.orderBy("epoch", "batch", "pos", "tree_id", "node_id"), rows)

    def load(self, epoch: int, split: str = "train") -> Iterator[Batch]:
        """An epoch's batches in order, each whole.

        Seeds, edges and the features of each table are dealt over ranges of batches and sorted
        within them, so no node sorts an epoch; their Arrow streams are read side by side,
        and the driver holds one batch and a partition of each stream.
        """
        own, nodes, edges = map(cut, self.sample(epoch, split))
        place = own.select("tree_id", "batch", "pos")
        frames = {"seeds": own.orderBy("batch", "pos")}
        frames["edges"] = edges.join(place, "tree_id").orderBy("batch", "pos", "hop", "edge_type", "dst_id", "src_id")
        found = {t: f.join(place, "tree_id").orderBy("batch", "pos", "hop", "node_id") for t, f in self.features(nodes).items()}
        streams = {name: _by_batch(f) for name, f in (frames | {f"of {t}": f for t, f in found.items()}).items()}
        empty = {name: pa.Table.from_batches([], schema) for name, (schema, _) in streams.items()}
        ahead = {name: next(groups, None) for name, (_, groups) in streams.items()}
        while ahead["seeds"] is not None:
            n = ahead["seeds"][0]
            held = {}
            for name, (_, groups) in streams.items():
                held[name] = empty[name]
                if ahead[name] is not None and ahead[name][0] == n:
                    held[name] = ahead[name][1]
                    ahead[name] = next(groups, None)
            yield Batch(epoch, n, held["seeds"], held["edges"], {t: held[f"of {t}"] for t in found})


def _by_batch(df: DataFrame) -> tuple[pa.Schema, Iterator[tuple[int, pa.Table]]]:
    """(schema, (batch, its rows) in order) of rows sorted by batch."""
    stream = arrow_stream(df)

    def groups() -> Iterator[tuple[int, pa.Table]]:
        held: list[pa.RecordBatch] = []
        current = None
        for rows in stream:
            numbers = rows.column(rows.schema.get_field_index("batch")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if held and numbers[a] != current:
                        yield current, pa.Table.from_batches(held, stream.schema)
                        held = []
                    current = int(numbers[a])
                    held.append(rows.slice(a, b - a))
        if held:
            yield current, pa.Table.from_batches(held, stream.schema)

    return stream.schema, groups()


def save_types(spark: SparkSession, path: str, types: Mapping[str, Mapping[str, str]], identity: object) -> None:
    """Keep proposed semantic types under the identity they were inferred from."""
    save_json(spark, path, stats.artifact_key(identity), {"types": types, "digest": stats.artifact_key(types)})


def load_types(spark: SparkSession, path: str, identity: object) -> dict[str, dict[str, str]]:
    """Kept types; missing, stale and altered ones raise."""
    found = load_json(spark, path, stats.artifact_key(identity))
    if found is None or found["digest"] != stats.artifact_key(found["types"]):
        raise ArtifactError(f"{path}: no semantic types for this data, or altered ones")
    return found["types"]


def plan_features(db: Database, valid: ValidatedTask, config: RunConfig) -> dict[str, dict[str, str]]:
    """A semantic type for each feature column: as configured, or inferred from a bounded sample; keys and hidden columns are none."""
    chosen = {(f.table, f.column): f.semantic_type for f in config.features}
    tables = [t for t in db.ids if t != valid.task.table]

    def types(name: str) -> dict[str, str]:
        key, columns = db.id_of(name), db.feature_columns(name, valid.hidden)
        if unknown := [c for tab, c in chosen if tab == name and c not in columns]:
            raise SchemaError(f"{name}: {unknown} can't be features")
        inferred = stats.infer_types(db[name].select(key, *columns), key=key)
        found = {c: chosen.get((name, c), inferred[c]) for c in columns}
        return {c: k for c, k in found.items() if k in DEFAULTS}

    return dict(zip(tables, together(types, tables), strict=True))


def prepare(
    spark: SparkSession, config: RunConfig, *, reader: Reader | None = None, check: bool = True, seeder: Seeder = shuffled_blocks, sampler: Sampler = temporal_hops,
    assembler: Assembler = gathered, store: str | None = None,
) -> PreparedDataset:
    """The whole flow up to a dataset that batches can be read from.

    ``reader`` stands in for the database that the configuration names; ``store`` is a
    folder to keep encoded columns in.
    """
    reader = reader or connect(spark, config)
    db = discover(reader, config)
    hidden = tuple(dict.fromkeys([*config.hidden, *reader.hidden(config.task.table, config.task.name)]))
    valid = validate_task(db, config.task, hidden)
    rows = split_rows(db, config.task)
    if check:
        check_data(db, valid, rows)
    own = db.only(t for t in db.frames if t != config.task.table and t in db.ids)
    kept = EncodedStore(spark, store) if store else None
    return PreparedDataset(db, valid, rows, graph.nodes(own), graph.edges(own), plan_features(db, valid, config), config, seeder, sampler, assembler, kept)


__all__ = ["Assembler", "Batch", "PreparedDataset", "Sampler", "Seeder", "SplitConfig", "ValidatedTask", "check_data", "connect", "discover", "load_types", "plan_features", "prepare", "save_types", "split_rows", "validate_task"]

"""The flow with keys of any kind, tasks of a catalogue, kept states, and parts of one's own."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from tributary import api
from tributary.config import parse_config
from tributary.schema import Database, Keys, Link
from tributary.sources import catalog, readers


def day(n):
    return dt.datetime(2024, 1, n)


SHELVES = [("north", 2), ("south", 1), ("north", 1)]


@pytest.fixture(scope="module")
def library(spark):
    """Shelves known by room and place, readers by name, books on shelves with a rating and a note."""
    shelves = spark.createDataFrame([(r, p, float(p), f"shelf {r}") for r, p in SHELVES] + [(None, 3, 0.0, "lost")], "room string, place int, width double, sign string")
    people = spark.createDataFrame([("ann", "en"), ("bob", "de"), ("cy", "en")], "name string, speaks string")
    books = spark.createDataFrame([(k, *SHELVES[k % 3], ["ann", "bob", "cy"][k % 3], day(1 + k), k / 2, "secret") for k in range(12)], "book long, room string, place int, owner string, bought timestamp_ntz, price double, note string")
    marks = spark.createDataFrame([(k, *SHELVES[k % 3], day(6 + k), ["yes", "No", "yes", "No"][k % 4], ["train", "train", "validation", "test"][k % 4]) for k in range(8)], "k long, room string, place int, at timestamp_ntz, full string, part string")
    keys = Keys({"shelves": ("room", "place"), "people": ("name",), "books": ("book",)}, (Link("books", ("room", "place"), "shelves"), Link("books", ("owner",), "people"), Link("marks", ("room", "place"), "shelves", ("room", "place"))), {"books": "bought"})
    return readers.FramesReader(spark, {"shelves": shelves, "people": people, "books": books, "marks": marks}, keys)


def config(**change):
    value = {
        "database": {"path": "unused"},
        "hidden_columns": [["books", "note"]],
        "task": {"table": "marks", "type": "binary_classification", "entity_table": "shelves", "entity_columns": ["room", "place"], "target": "full", "key": "k", "time": "at", "split": {"column": "part", "values": {"train": "train", "validation": "validation", "test": "test"}}},
        "sampling": {"batch_size": 3, "num_neighbors": [2, 2], "epochs": 1},
    }
    return parse_config(value | change)


NODE = {s: k for k, s in enumerate(sorted(SHELVES))}


def test_entities_of_two_columns_and_targets(spark, library):
    data = api.prepare(spark, config(), reader=library)
    seeds = {r["tree_id"]: r for r in data.seeds(0).collect()}
    rows = [k for k in range(8) if k % 4 < 2]
    assert {t: (r["node_id"], r["target"]) for t, r in seeds.items()} == {i: (NODE[SHELVES[k % 3]], 1.0 if k % 4 == 0 else 0.0) for i, k in enumerate(rows)}
    own, nodes, edges = data.sample(0)
    first = {(r["dst_id"], r["src_id"]) for r in edges.filter("hop = 1").collect()}
    assert first and all(NODE[SHELVES[b % 3]] == s for s, b in first)
    assert {r["node_type"] for r in nodes.select("node_type").distinct().collect()} == {"shelves", "books", "people"}
    shelves = data.features(nodes)["shelves"]
    assert shelves.filter("hop = 0").count() == 4
    assert data.types["shelves"] == {"width": "numerical", "sign": "categorical"} and "name" not in data.types["people"] and "owner" not in data.types["books"]


def test_batches_arrive_whole_and_in_order(spark, library):
    data = api.prepare(spark, config(), reader=library)
    batches = list(data.load(0))
    assert [b.batch for b in batches] == sorted(b.batch for b in batches)
    seen = [i for b in batches for i in b.seeds.column("tree_id").to_pylist()]
    assert sorted(seen) == list(range(4)) and max(b.seeds.num_rows for b in batches) <= 3
    own, nodes, edges = data.sample(0)
    assert sum(b.edges.num_rows for b in batches) == edges.count()
    for table in data.types:
        assert sum(b.features[table].num_rows for b in batches) == nodes.filter(F.col("node_type") == table).count()
        for b in batches:
            assert set(b.features[table].column("tree_id").to_pylist()) <= set(b.seeds.column("tree_id").to_pylist())
    assert list(api.prepare(spark, config(), reader=library).load(0, "nothing")) == []


def test_parts_of_ones_own(spark, library):
    """Another seeder, sampler and assembler take the place of the default ones."""
    calls = []

    def seeder(data, epoch, split):
        calls.append((epoch, split))
        return api.shuffled_blocks(data, epoch, split).filter("tree_id = 0")

    def sampler(data, own, epoch):
        nodes, edges = api.temporal_hops(data, own, epoch)
        return nodes.filter("hop = 0"), edges.limit(0)

    def assembler(data, nodes):
        return {"only": nodes.withColumn("const", F.lit(1.0))}

    data = api.prepare(spark, config(), reader=library, seeder=seeder, sampler=sampler, assembler=assembler)
    (batch,) = data.load(3)
    assert calls == [(3, "train")] and batch.seeds.num_rows == 1 and batch.edges.num_rows == 0
    assert batch.features["only"].column("const").to_pylist() == [1.0]


def test_configured_processors_their_states_and_the_store(spark, library, tmp_path):
    features = [{"table": "books", "column": "price", "semantic_type": "numerical", "processor": "standardize", "params": {"center": "none", "scale": "none"}}, {"table": "shelves", "column": "sign", "semantic_type": "text_embedded", "processor": "embed", "params": {"dim": 4}}]
    data = api.prepare(spark, config(features=features), reader=library, store=str(tmp_path / "store"))
    encoded, key = data.encoded("books")
    assert {r["book"]: r["numerical"] for r in encoded.collect()} == {k: [k / 2] for k in range(12)}
    last = 6 + 5  # of the rows to train on
    assert data.train_rows("books").count() == last
    assert len(data.encoded("shelves")[0].first()["text_embedded"][0]) == 4
    assert sorted(data.store.made) == [("books", "bought"), ("books", "price"), ("shelves", "sign"), ("shelves", "width")]
    data.save_processors(str(tmp_path / "states"), {"run": 1})
    again = api.prepare(spark, config(features=features), reader=library, store=str(tmp_path / "store"))
    again.load_processors(str(tmp_path / "states"), {"run": 1})
    for table in again.types:
        assert sorted(map(str, again.encoded(table)[0].collect())) == sorted(map(str, data.encoded(table)[0].collect()))
    assert again.store.made == [("people", "speaks")] and len(data.store.made) == 4  # each found what the other had made
    with pytest.raises(ValueError):
        api.prepare(spark, config(features=[features[0] | {"params": {"center": "left"}}]), reader=library).fit()


def test_tasks_of_a_catalogue_hide_their_columns(spark, tmp_path):
    people = spark.createDataFrame([(k, "ab"[k % 2], float(k), float(k * k)) for k in range(8)], "person long, kind string, age double, income double")
    visits = spark.createDataFrame([(k, k % 8, day(1 + k % 20), float(k)) for k in range(40)], "visit long, person long, at timestamp_ntz, cost double")
    rows = spark.createDataFrame([(k, k, float(k * k), ["train", "validation", "test"][k % 3]) for k in range(8)], "row long, person long, income double, split string")
    db = Database({"people": people, "visits": visits}, Keys({"people": ("person",), "visits": ("visit",)}, (Link("visits", ("person",), "people"),), {"visits": "at"}))
    task = catalog.Task("income", "target_table", "regression", "people", "person", "income", extra={"kind": "autocomplete", "hidden_columns": [["visits", "cost"]]})
    path = catalog.write_dataset(catalog.Dataset(db, {"income": task}, {"target_table": rows}), str(tmp_path / "set"))
    value = {
        "database": {"path": path, "reader": "dataset"},
        "schema": {"foreign_keys": [{"table": "target_table", "columns": "person", "target": "people"}]},
        "task": {"name": "income", "table": "target_table", "type": "regression", "entity_table": "people", "entity_columns": "person", "target": "income", "key": "row", "split": {"column": "split", "values": {"train": "train", "validation": "validation", "test": "test"}}},
    }
    data = api.prepare(spark, parse_config(value))
    assert data.types == {"people": {"kind": "categorical", "age": "numerical"}, "visits": {"at": "timestamp"}}
    assert data.db.times == {"visits": "at"}
    assert sorted(r["target"] for r in data.seeds(0).collect()) == [0.0, 9.0, 36.0]


def test_a_database_with_keys_of_its_own(spark, tmp_path):
    path = str(tmp_path / "shop.sqlite")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE users (user_id INTEGER PRIMARY KEY, kind TEXT);
        CREATE TABLE orders (order_id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users (user_id), at TIMESTAMP, amount REAL);
        CREATE TABLE labels (k INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users (user_id), at TIMESTAMP, y INTEGER);
    """)
    db.executemany("INSERT INTO users VALUES (?, ?)", [(i, "ab"[i % 2]) for i in range(6)])
    db.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [(i, i % 6, f"2024-01-{1 + i % 20:02}", float(i)) for i in range(40)])
    db.executemany("INSERT INTO labels VALUES (?, ?, ?, ?)", [(i, i % 6, f"2024-01-{10 + i:02}", i % 2) for i in range(12)])
    db.commit()
    db.close()
    value = {
        "database": {"url": f"sqlite:///{path}"},
        "schema": {"time_columns": {"orders": "at"}},
        "task": {"table": "labels", "type": "binary_classification", "entity_table": "users", "entity_columns": "user_id", "target": "y", "key": "k", "time": "at", "split": {"fraction": 0.25}},
        "sampling": {"batch_size": 4, "num_neighbors": [3], "epochs": 1},
    }
    data = api.prepare(spark, parse_config(value))
    assert {x.child for x in data.db.links} == {"orders", "labels"} and data.types["orders"] == {"at": "timestamp", "amount": "numerical"}
    assert sum(b.seeds.num_rows for b in data.load(0)) == 9
    assert data.report().filter("name = 'orders'").first()["n"] == 40


def test_split_queries_leave_no_names(spark, library):
    spark.range(3).createOrReplaceTempView("marks")  # the user's own
    task = {"table": "marks", "type": "binary_classification", "entity_table": "shelves", "entity_columns": ["room", "place"], "target": "full", "key": "k", "split": {"queries": {"test": "WITH own AS (SELECT * FROM marks) SELECT k FROM own WHERE place = 2"}}}
    data = api.prepare(spark, config(task=task), reader=library)
    assert {r["split"]: r["count"] for r in data.rows.groupBy("split").count().collect()}["test"] == 3
    assert spark.table("marks").columns == ["id"] and [t.name for t in spark.catalog.listTables() if t.name.startswith("__")] == []
    spark.catalog.dropTempView("marks")

"""The flow from a folder of tables to encoded batches, and streams of events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tributary import api
from tributary.config import parse_config
from tributary.operators import metrics
from tributary.operators.checks import TaskError
from tributary.schema import SchemaError
from tributary.sources.artifacts import ArtifactError
from tributary.streaming import windows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db"))
    day = lambda n: dt.datetime(2024, 1, n)
    spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "user_id long, kind string").write.parquet(f"{path}/users.parquet")
    spark.createDataFrame([(i, i % 6, day(1 + i % 20), float(i), "secret") for i in range(40)], "order_id long, user_id long, at timestamp_ntz, amount double, note string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, i % 6, day(10 + i), i % 2) for i in range(12)], "k long, user_id long, at timestamp_ntz, y int").write.parquet(f"{path}/labels.parquet")
    return path


def config(folder, **change):
    value = {
        "database": {"path": folder},
        "schema": {"identity_keys": {"users": "user_id", "orders": "order_id"}, "foreign_keys": [{"table": "orders", "columns": "user_id", "target": "users"}, {"table": "labels", "columns": "user_id", "target": "users"}], "time_columns": {"orders": "at"}},
        "hidden_columns": [["orders", "note"]],
        "task": {"table": "labels", "type": "binary_classification", "entity_table": "users", "entity_columns": "user_id", "target": "y", "key": "k", "time": "at", "split": {"fraction": 0.25}},
        "sampling": {"batch_size": 4, "num_neighbors": [3], "epochs": 1},
    }
    return parse_config(value | change)


def test_flow(spark, folder):
    data = api.prepare(spark, config(folder))
    assert "note" not in data.types["orders"] and data.types["users"] == {"kind": "categorical"}
    seeds, nodes, edges = data.sample(0)
    assert sorted(r["tree_id"] for r in seeds.collect()) == list(range(9))
    late = edges.join(seeds, "tree_id").join(data.nodes.filter("node_type = 'orders'"), F.col("src_id") == data.nodes["node_id"])
    assert late.filter(F.col("node_time") > F.col("seed_time")).count() == 0
    frames = list(data.batches(0, "orders", rows=5))
    assert sum(map(len, frames)) == nodes.filter("node_type = 'orders'").count() and max(map(len, frames)) <= 5
    assert data.report().filter("part = 'node'").count() == 2


def test_flow_errors(spark, folder, tmp_path):
    with pytest.raises(SchemaError):
        api.prepare(spark, config(folder, hidden_columns=[["orders", "nope"]]))
    task = dict(table="labels", type="binary_classification", entity_table="orders", entity_columns=["user_id"], target="y", key=["k"])
    with pytest.raises(SchemaError):
        api.prepare(spark, config(folder, task=task))
    task = task | {"entity_table": "users", "time": "at"}
    with pytest.raises(SchemaError):
        api.prepare(spark, config(folder, task=task | {"target": "k"}))
    with pytest.raises(TaskError):
        api.prepare(spark, config(folder, task=task | {"target": "user_id"}))
    with pytest.raises(SchemaError):
        api.prepare(spark, config(folder, features=[{"table": "orders", "column": "note", "semantic_type": "categorical"}]))
    path = str(tmp_path / "types.json")
    api.save_types(spark, path, {"users": {"kind": "categorical"}}, {"v": 1})
    assert api.load_types(spark, path, {"v": 1}) == {"users": {"kind": "categorical"}}
    with pytest.raises(ArtifactError):
        api.load_types(spark, path, {"v": 2})


def test_split_by_query(spark, folder):
    task = {"table": "labels", "type": "binary_classification", "entity_table": "users", "entity_columns": "user_id", "target": "y", "key": "k", "split": {"queries": {"test": "SELECT k FROM labels WHERE user_id = 5"}}}
    data = api.prepare(spark, config(folder, task=task), check=False)
    assert {r["split"]: r["count"] for r in data.rows.groupBy("split").count().collect()} == {"train": 8, "validation": 2, "test": 2}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windows.window_totals(windows.event_stream(spark, str(tmp_path / "events")), late="4000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("totals").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in windows.window_totals(events).collect()}


def test_small_reports(spark):
    df = spark.range(100)
    assert sorted(r[0] for r in metrics.pages(df, "id", [0, 1, 98], 3).collect()) == [0, 1, 2, 3, 98, 99]
    assert metrics.share(df, "id", 25, "id").count() == 4
    out, seen = metrics.observed(df, "seen", F.max("id").alias("most"))
    out.count()
    assert seen.get == {"rows": 100, "most": 99}

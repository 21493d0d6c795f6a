"""Small fixtures with known results, and properties."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.config import ConfigError, parse_config
from tributary.functions import encodings, scalars, text
from tributary.operators import checks, features, graph, keys, metrics, paths, processors, ranks, sampling, seeds, splits, stats
from tributary.schema import Database, Keys, Link, SchemaError
from tributary.sources import artifacts, catalog, readers, versions
from tributary.sources.encoded import EncodedStore


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.fixture(scope="module")
def temporal(spark):
    """Two sensors; readings out of order, one on the same day as another, one without a sensor."""
    sensors = spark.createDataFrame([(0, "north"), (1, "south")], "id long, place string")
    rows = [(0, 1, day(9), 0.5), (1, 0, day(20), -2.0), (2, 0, day(7), 4.0), (3, 0, day(7), 8.0), (4, None, day(1), 0.0), (5, 0, day(12), 16.0)]
    readings = spark.createDataFrame(rows, "id long, sensor long, taken timestamp_ntz, value double")
    return Database({"sensors": sensors, "readings": readings}, Keys({"sensors": ("id",), "readings": ("id",)}, (Link("readings", ("sensor",), "sensors"),), {"readings": "taken"}))


def at(n):
    return int(day(n).replace(tzinfo=dt.UTC).timestamp())


def test_edge_order_and_visibility(temporal):
    e = graph.edges(temporal, directions=(False,))
    ranked = {(r["dst_id"], r["rank"]): r["src_id"] for r in graph.neighbour_rank(e, block=5 * 86400).collect()}
    assert ranked == {(0, 0): 2, (0, 1): 3, (0, 2): 5, (0, 3): 1, (1, 0): 0}
    assert {r["src_id"] for r in graph.visible(e, at(9)).collect()} == {0, 2, 3}


def test_sampling_sees_no_future_and_keeps_to_the_limit(spark, temporal):
    seeds_ = spark.createDataFrame([("late", "sensors", 0, at(13)), ("early", "sensors", 0, at(7)), ("none", "sensors", 1, at(8))], "tree_id string, node_type string, node_id long, seed_time long")
    nodes, edges = sampling.khop(seeds_, graph.edges(temporal), [2, 2])
    found = {}
    for r in edges.filter("hop = 1").collect():
        found.setdefault(r["tree_id"], set()).add(r["src_id"])
    assert found["early"] == {2, 3} and "none" not in found and len(found["late"]) == 2 and found["late"] <= {2, 3, 5}
    assert nodes.filter("hop > 0").groupBy("tree_id", "node_type", "node_id").count().filter("count > 1").count() == 0
    assert edges.groupBy("tree_id", "edge_type", "dst_id", "hop").count().filter("count > 2").count() == 0


def test_cutoff_gap_is_an_error(temporal):
    with pytest.raises(keys.KeyCheckError):
        graph.nodes(temporal, cutoff=day(9), strict=True)
    assert graph.nodes(temporal, cutoff=day(9)).filter("node_type = 'readings'").count() == 4


def test_links_of_several_columns(spark):
    shelf = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 1)], "id long, room string, place int")
    book = spark.createDataFrame([(0, "b", 1), (1, "a", 2), (2, "a", None), (3, "c", 1)], "id long, room string, place int")
    db = Database({"shelf": shelf, "book": book}, Keys({"shelf": ("id",), "book": ("id",)}, (Link("book", ("room", "place"), "shelf", ("room", "place")),)))
    for back in (False, True):
        got = {(r["src_id"], r["dst_id"]) for r in graph.key_edges(db, db.links[0], reverse=back).collect()}
        assert got == ({(2, 0), (1, 1)} if back else {(0, 2), (1, 1)})


def test_degrees_add_up(temporal):
    e = graph.edges(temporal, directions=(False,))
    d = graph.in_degree(e, temporal["sensors"].select(F.col("id").alias("node_id")))
    assert d.agg(F.sum("degree")).first()[0] == e.count()
    assert sorted(tuple(r) for r in graph.pointers(d).collect()) == [(0, 0, 4), (1, 4, 5)]


def test_gather_keeps_order_and_repeats(spark, temporal):
    requests = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "pos int, node_id long")
    got = features.gather(requests, temporal["readings"], "id", columns=["value"], strict=True).orderBy("pos")
    assert [r["value"] for r in got.collect()] == [4.0, 0.5, 4.0]
    with pytest.raises(features.MissingRowError):
        features.gather(requests.withColumn("node_id", F.lit(9)), temporal["readings"], "id", strict=True)


def test_numeric_statistics_ignore_what_is_no_number(spark):
    rows = [(2.5, "8", None), (-math.inf, "x1", None), (6.0, None, None), (math.nan, "-1", None), (0.5, "0.5", None), (-7.0, "", None)]
    df = spark.createDataFrame(rows, "a double, b string, empty double")
    got = {r["column"]: r for r in stats.numeric_stats(df, ["a", "b", "empty"]).collect()}
    assert (got["a"]["n"], got["a"]["q0"], got["a"]["q50"], got["a"]["q100"]) == (4, -7.0, 1.5, 6.0)
    assert (got["b"]["n"], got["b"]["mean"], got["b"]["q50"]) == (3, 2.5, 0.5)
    assert got["a"]["std"] == pytest.approx((sum((x - 0.5) ** 2 for x in (2.5, 6.0, 0.5, -7.0)) / 4) ** 0.5)
    assert got["empty"]["n"] == 0 and got["empty"]["mean"] is None


def test_upper_median_and_empty_times(spark):
    df = spark.createDataFrame([(day(d),) for d in (1, 2, 3, 4)] + [(None,)], "t timestamp_ntz")
    r = stats.time_stats(df, "t").first()
    assert (r["n"], r["median"], r["min_year"]) == (4, day(3), 2024)
    r = stats.time_stats(df.filter("t IS NULL"), "t").first()
    assert (r["n"], r["min_year"], r["max_year"], r["median"]) == (0, -1, -1, None)


def test_every_row_once_an_epoch(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    order = seeds.epochs(df, "k", 2, batch_size=2, block_rows=3)
    c = {r["epoch"]: r for r in seeds.coverage(order).collect()}
    assert all((c[e]["n_rows"], c[e]["n_distinct"], c[e]["n_batches"]) == (7, 7, 5) for e in (0, 1))
    a, b = ([r["key"] for r in order.filter(F.col("epoch") == e).orderBy("batch", "pos").collect()] for e in (0, 1))
    assert a != b and sorted(a) == sorted(b)
    assert seeds.epoch_order(df, "k", epoch=0, batch_size=2, block_rows=3, max_batches=1).count() <= 2


def test_class_count(spark):
    df = spark.createDataFrame([(0, [1, 4]), (0, [])], "y int, m array<int>")
    assert (seeds.class_count(df, "y"), seeds.class_count(df, "m"), seeds.class_count(df.limit(0), "y")) == (1, 5, 0)


def test_default_split(spark):
    rows = spark.createDataFrame([(0, day(1), 1), (1, day(2), 0), (2, day(3), 1), (3, day(4), 0), (4, day(4), 1), (5, day(5), None)], "k int, t timestamp_ntz, y int")
    got = {r["k"]: r["split"] for r in splits.default_split(rows, ["k"], time="t", label="y", fraction=0.2).collect()}
    assert got == {0: "train", 1: "train", 2: "train", 3: "validation", 4: "validation", 5: "test"}
    got = splits.default_split(rows.drop("t"), ["k"], label="y", fraction=0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 4, "validation": 1, "test": 1}
    with pytest.raises(splits.SplitError):
        splits.default_split(rows.limit(1), ["k"])
    with pytest.raises(splits.SplitError):
        splits.default_split(rows.withColumn("t", F.lit(day(1))), ["k"], time="t")


def test_query_split_problems(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(4)], "k int, y int")
    part = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    good = splits.query_split(rows, ["k"], {"train": part(0, 1), "validation": part(2), "test": part(3)})
    assert good.count() == 4
    for bad in ({"train": part(0, 1), "validation": part(1, 2), "test": part(3)}, {"train": part(0), "validation": part(2), "test": part(3)}, {"train": part(0, 1), "validation": part(2), "test": part(3, 9)}):
        with pytest.raises(splits.SplitError):
            splits.query_split(rows, ["k"], bad)
    for q in ("DELETE FROM x", "SELECT 1; SELECT 2"):
        with pytest.raises(checks.TaskError):
            checks.safe_select(q)


def test_label_checks(spark):
    make = lambda rows: spark.createDataFrame(rows, "split string, y double")
    checks.check_labels(make([("train", 0.0), ("train", 1.0), ("validation", 1.0), ("test", None)]), "y", "binary_classification")
    for rows, kind in (([("train", 0.0), ("validation", 0.0)], "binary_classification"), ([("train", 0.0), ("train", 1.0), ("validation", 2.0)], "multiclass_classification"), ([("train", 0.0), ("validation", 1.0), ("test", None), ("test", 1.0)], "regression"), ([("train", math.inf), ("validation", 1.0)], "regression"), ([("train", 1.0)], "regression")):
        with pytest.raises(checks.TaskError):
            checks.check_labels(make(rows), "y", kind)


def test_labels_as_text(spark):
    df = spark.createDataFrame([(" Yes ",), ("F",), ("1",)], "s string")
    assert [r[0] for r in df.select(scalars.binary_label("s")).collect()] == [1.0, 0.0, 1.0]
    with pytest.raises(Exception, match="no binary label"):
        spark.createDataFrame([("maybe",)], "s string").select(scalars.binary_label("s")).collect()


def test_schema_errors(temporal):
    link = lambda *x: Keys({"sensors": ("id",)}, (Link(*x),))
    for bad in (Keys({"nobody": ("id",)}), Keys({"sensors": ("x",)}), Keys({"sensors": ("id", "id")}), Keys({"sensors": ()}), Keys(times={"sensors": "taken"}), link("readings", ("sensor", "id"), "sensors"), link("readings", ("sensor",), "nobody"), Keys({"sensors": ("id",)}, (Link("readings", ("sensor",), "sensors"), Link("readings", ("sensor",), "sensors", ("id",))))):
        with pytest.raises(SchemaError):
            Database(temporal.frames, bad)
    with pytest.raises(SchemaError):
        temporal.only(["sensors", "missing"])
    assert temporal.only(["readings"]).links == () and temporal.feature_columns("readings", [("readings", "taken"), ("sensors", "value")]) == ["value"]


def test_what_a_task_hides():
    task = lambda **extra: catalog.Task("rate", "t", "regression", "shop", "shop_id", "stars", extra=extra)
    assert task(kind="forecast").hides() == [] == task(hidden_columns=None).hides()
    assert task(kind="autocomplete", hidden_columns=[["visit", "note"], ["visit", "note"]]).hides() == [("shop", "stars"), ("visit", "note")]
    left_in = next(iter(catalog.TARGETS_LEFT_IN))
    assert catalog.Task(left_in[1], "t", "regression", left_in[2], "id", left_in[3], extra={"kind": left_in[0]}).hides() == [left_in[2:]]
    assert catalog.Task(left_in[1], "t", "regression", left_in[2], "id", left_in[3], extra={"kind": "forecast"}).hides() == []
    for wrong in ("note", [["visit"]], ["visit"]):
        with pytest.raises(TypeError):
            task(hidden_columns=wrong).hides()
    with pytest.raises(ValueError):
        catalog.Task("rate", "t", "regression", "", "id", "stars", extra={"kind": "autocomplete"}).hides()


def test_values_at_ranks(spark, monkeypatch):
    """Exact elements, also where only the values near a rank are counted."""
    import random

    from tributary.operators import stats as module

    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 9)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(2000)] + [("c", None), (None, 1.5)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    want = {}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g)
        want[g] = tuple(v[round((len(v) - 1) * q)] for q in shares.values())
    for few in (module.FEW, 1000):
        monkeypatch.setattr(module, "FEW", few)
        monkeypatch.setattr(module, "_REACH", module._REACH if few > 1000 else 0.01)
        assert {r["g"]: tuple(r)[1:] for r in metrics.nearest_rank(df, ["g"], "x", shares).collect()} == want


def test_values_by_rank(spark, monkeypatch):
    """Exact elements, whether columns are looked through whole, by brackets, by narrowed ones or by such that missed."""
    import random

    rng = random.Random(4)
    rows = [(rng.gauss(0, 9) if rng.random() < 0.9 else None, rng.randrange(4), float(k % 3 == 0), None) for k in range(4000)]
    df = spark.createDataFrame(rows, "a double, b long, c double, d double").repartition(5)
    places = {c: [("low", 0.0, lambda n: 0), ("some", 0.3, lambda n: (3 * n) // 10), ("mid", 0.5, lambda n: n // 2), ("high", 1.0, lambda n: n - 1)] for c in "abcd"}
    want = {}
    for i, c in enumerate("abcd"):
        v = sorted(r[i] for r in rows if r[i] is not None)
        want[c] = {"n": len(v), "min": v[0] if v else None, "max": v[-1] if v else None} | {name: v[rank(len(v))] if v else None for name, _, rank in places[c]}
    for few, inside, sample, reach in ((ranks.FEW, ranks.MOST_INSIDE, ranks.SAMPLE, ranks.REACH), (10, 1 << 22, 2000, 0.03), (10, 60, 3000, 0.03), (10, 1 << 22, 40, 0.0)):
        for name, value in (("FEW", few), ("MOST_INSIDE", inside), ("SAMPLE", sample), ("REACH", reach)):
            monkeypatch.setattr(ranks, name, value)
        assert ranks.values_by_rank(df, {c: F.col(c) for c in "abcd"}, places)[0] == want


def test_large_vocabularies_are_numbered_alike(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 37).cast("string").alias("a"), F.when(F.col("id") % 5 > 0, F.split(F.concat_ws(" ", F.col("id") % 7, F.col("id") % 11), " ")).alias("b"))
    small = sorted(map(tuple, stats.vocabularies(df, {"a": False, "b": True}).collect()))
    monkeypatch.setattr(stats, "FEW_VALUES", 5)
    assert sorted(map(tuple, stats.vocabularies(df, {"a": False, "b": True}).collect())) == small
    assert [r[3] for r in small if r[0] == "a"] and sorted(r[3] for r in small if r[0] == "b") == list(range(11))


def test_encodings_are_told_from_values(spark):
    many = [f"v{k}" for k in range(40)]
    rows = [(k, ["red", "blue", None][k % 3], many[k], f'{{"k": {k}, "t": ["x"]}}' if k % 4 else None, f"{k}.{k % 7}0", f"2024-01-{1 + k % 28:02} 0{k % 10}:00:00", f"2024-01-02T03:04:05.5+0{k % 9}:30", f"0x{k:04x}", f"INTERVAL '{k} 01:02:03' DAY TO SECOND", ["1", "x"][k % 2] + str(k), None, "007" + str(k), f"[{k}" if k == 3 else f"[{k}]", "9" * (20 + k)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, color string, word string, js string, money string, at string, zoned string, raw string, span string, mixed string, empty string, zeros string, broken string, huge string")
    found = encodings.infer_encodings(df)
    kinds = {c: e.kind for c, e in found.items()}
    assert kinds == {"id": "scalar", "color": "scalar", "word": "scalar", "js": "json", "money": "decimal", "at": "datetime", "zoned": "datetime", "raw": "bytes", "span": "timedelta_ns", "mixed": "scalar", "empty": "scalar", "zeros": "scalar", "broken": "scalar", "huge": "scalar"}
    assert (found["money"].type, found["at"].type, found["zoned"].type, found["js"].type.upper().replace(" ", "")) == ("decimal(4,2)", "timestamp_ntz", "timestamp", "STRUCT<K:BIGINT,T:ARRAY<STRING>>")
    got = {r["id"]: r for r in encodings.decode_frame(df, found).collect()}
    assert got[5]["js"]["k"] == 5 and got[5]["js"]["t"] == ["x"] and got[4]["js"] is None
    assert str(got[8]["money"]) == "8.10" and got[3]["at"] == dt.datetime(2024, 1, 4, 3) and bytes(got[255 % 40]["raw"]) == b"\x00\x0f"
    assert got[2]["span"] == dt.timedelta(days=2, hours=1, minutes=2, seconds=3)
    few = df.withColumn("color", F.element_at(F.array(F.lit("red"), F.lit("blue")), (F.col("id") % 2 + 1).cast("int")))
    assert encodings.infer_encodings(few.unionAll(few))["color"] == encodings.Encoding("category", "string", ("blue", "red"))
    assert encodings.infer_encodings(df.limit(0))["js"].kind == "scalar"


def test_every_type_comes_back_from_its_stored_form(spark):
    df = spark.sql("""SELECT id, id % 2 = 0 AS b, id / 3.0D AS d, concat('t', id) AS s, CAST(id AS decimal(20,4)) AS m, timestamp_ntz'2024-01-02 03:04:05.123456' + make_dt_interval(CAST(id AS int)) AS t,
        make_dt_interval(1, CAST(id AS int), 2, 3.000004) AS i, array(named_struct('a', id, 'b', array('x', NULL))) AS j, map('k', id) AS p, CAST(concat('é', id) AS binary) AS r FROM range(6)
        UNION ALL SELECT 99, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
    stored, known = encodings.encode_frame(df)
    assert {f.dataType.simpleString() for f in stored.select("m", "t", "i", "j", "p", "r").schema.fields} == {"string"}
    back = encodings.decode_frame(stored, known)
    assert [f.dataType.simpleString() for f in back.schema.fields] == [f.dataType.simpleString() for f in df.schema.fields]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_moments_of_mixed_texts(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05.25Z", "2024-01-02", "2460311.5", "2024-01-02T03:04:05-0130", "soon", "", None, "12", "2024-13-45"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = [r[0] for r in df.orderBy("k").select(scalars.instant("s").cast("timestamp_ntz")).collect()]
    at = dt.datetime(2024, 1, 2)
    assert got == [at.replace(hour=3, minute=4, second=5), at.replace(hour=1, minute=4, second=5), at.replace(hour=3, minute=4, second=5, microsecond=250000), at, at, at.replace(hour=4, minute=34, second=5), None, None, None, None, None]
    assert df.filter("k = 3").select(scalars.julian_day(scalars.instant("s"))).first()[0] == 2460311.5
    assert sorted(r["k"] for r in keys.before_cutoff(df, "s", dt.datetime(2024, 1, 2, 2)).collect()) == [1, 3, 4]
    db = Database({"t": df}, Keys({"t": ("k",)}, (), {"t": "s"}))
    assert graph.nodes(db).filter("node_time IS NULL").count() == 5


def test_dangling_modes(spark):
    child = spark.createDataFrame([(1, 0), (2, 9), (3, None)], "id int, p int")
    parent = spark.createDataFrame([(0,)], "id int")
    assert keys.resolve_dangling(child, "p", parent, "id", "drop").count() == 1
    assert {r["id"]: r["p"] for r in keys.resolve_dangling(child, "p", parent, "id", "null").collect()} == {1: 0, 2: None, 3: None}
    with pytest.raises(keys.KeyCheckError):
        keys.resolve_dangling(child, "p", parent, "id", "error")


def test_composite_edges(spark):
    child = spark.createDataFrame([(0, 1, 1), (1, 1, None), (2, 2, 2)], "id int, a int, b int")
    parent = spark.createDataFrame([(7, 1, 1), (8, 2, 3)], "id int, a int, b int")
    assert [tuple(r) for r in graph.composite_edges(child, "id", ["a", "b"], parent, "id", ["a", "b"]).collect()] == [(0, 7)]


def test_dense_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "v string").repartition(3)
    assert {r["v"]: r[keys.NODE_ID] for r in keys.assign_dense_ids(df).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(keys.KeyCheckError):
        keys.assign_dense_ids(df.withColumn(keys.NODE_ID, F.lit(0)))


def test_dataset_round_trip(spark, tmp_path):
    wide = -(2**62) - 7
    shops = spark.createDataFrame([(0, wide, "x"), (1, 2**62 + 5, None), (2, None, "y")], "shop_id long, code long, town string")
    visits = spark.createDataFrame([(0, 2, math.nan, []), (1, None, 0.25, None), (2, 0, None, ["q", "r"]), (3, 2, -1.0, ["q"])], "visit_id long, shop_id long, spent double, marks array<string>")
    towns = spark.createDataFrame([("y",), ("x",)], "town string")
    frames = {"shops": shops, "visits": visits, "towns": towns}
    own = Keys({"shops": ("shop_id",), "visits": ("visit_id",)}, (Link("visits", ("shop_id",), "shops"),))
    rows = catalog.union_splits({"train": visits.select("visit_id", "spent").filter("visit_id < 3"), "val": visits.select("visit_id", "spent").filter("visit_id = 3")})
    task = catalog.Task("t", "target_table", "regression", "visits", "visit_id", "spent", extra={"a": 1})
    data = catalog.Dataset(Database(frames, own), {"t": task}, {"target_table": rows}, {"test_timestamp": "2024-01-01"})
    path = str(tmp_path / "set")
    catalog.write_dataset(data, path)
    with pytest.raises(FileExistsError):
        catalog.write_dataset(data, path)
    back = catalog.DatasetReader(spark, path)
    db = back.database()
    assert sorted(r["code"] for r in db["shops"].filter("code IS NOT NULL").collect()) == [wide, 2**62 + 5]
    assert {r["town"]: r[keys.NODE_ID] for r in db["towns"].collect()} == {"x": 0, "y": 1}
    assert db.links == (Link("visits", ("shop_id",), "shops", ("shop_id",)),) and back.metadata()["test_timestamp"] == "2024-01-01"
    assert {k: v.count() for k, v in back.task_splits("t").items()} == {"train": 3, "val": 1}
    back.update_extra("t", {"b": 2})
    assert back.tasks()["t"].extra == {"a": 1, "b": 2}
    assert catalog.discover_datasets(spark, [str(tmp_path)]) == {"set": str(tmp_path / "set")}
    with pytest.raises(SchemaError):
        catalog.write_dataset(catalog.Dataset(Database({**frames, "shops": shops.filter("shop_id < 1")}, own)), str(tmp_path / "bad"))
    with pytest.raises(SchemaError):
        catalog.Dataset(Database({"_catalog_tables": shops}))


def test_dataset_from_a_folder(spark, tmp_path):
    spark.createDataFrame([(0, "x"), (1, "y")], "shop_id long, town string").write.parquet(str(tmp_path / "db" / "shops.parquet"))
    for split, rows in {"train": [(0, 1.0)], "val": [(1, 0.5)]}.items():
        spark.createDataFrame(rows, "shop_id long, stars double").write.parquet(str(tmp_path / "tasks" / "rate" / f"{split}.parquet"))
    task = catalog.Task("rate", "", "regression", "shops", "shop_id", "stars")
    data = catalog.load_folder(spark, str(tmp_path), Keys({"shops": ("shop_id",)}), {"rate": task}, test_timestamp="2024-05-01")
    assert data.tasks["rate"].table == "target_table" and data.metadata == {"test_timestamp": "2024-05-01"}
    assert {(r["shop_id"], r["split"]) for r in data.task_frames["target_table"].collect()} == {(0, "train"), (1, "val")}
    target = str(tmp_path / "kept")
    catalog.materialize_all(spark, {"a": lambda: data}, target)
    assert catalog.materialize_all(spark, {"a": lambda: 1 / 0}, target) == {}  # already there
    assert "division" in catalog.materialize_all(spark, {"b": lambda: 1 / 0}, target)["b"]
    catalog.write_dataset(data, f"{target}/a", overwrite=True)
    assert sorted(catalog.DatasetReader(spark, f"{target}/a").task_splits("rate")) == ["train", "val"]
    places = catalog.DatasetReader(spark, f"{target}/a")._places
    spark.createDataFrame([("version", "0")], "key string, value string").write.mode("overwrite").parquet(places[catalog.RESERVED[0]])
    with pytest.raises(SchemaError):
        catalog.DatasetReader(spark, f"{target}/a")


def test_a_crash_leaves_the_old_dataset(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    made = lambda k: catalog.Dataset(Database({"t": spark.createDataFrame([(i, k) for i in range(5)], "id long, k long")}, Keys({"t": ("id",)})), metadata={"k": str(k)})
    catalog.write_dataset(made(1), path)
    first = catalog.DatasetReader(spark, path)
    for step in range(7):  # a crash after some tables, and one before the version is published
        left = [step]

        def fail(self, name, left=left, real=versions.Versions.new_folder):
            left[0] -= 1
            if left[0] < 0:
                raise RuntimeError("crash")
            return real(self, name)

        with monkeypatch.context() as m:
            m.setattr(versions.Versions, "new_folder", fail)
            if step == 6:
                m.setattr(versions.Versions, "publish", lambda self, tables, after: fail(self, "", [0]))
            with pytest.raises(RuntimeError):
                catalog.write_dataset(made(2), path, overwrite=True)
        again = catalog.DatasetReader(spark, path)
        assert again.metadata()["k"] == "1" and again.database()["t"].select("k").distinct().first()[0] == 1
    catalog.write_dataset(made(3), path, overwrite=True)
    assert first.database()["t"].first()["k"] == 1 and catalog.DatasetReader(spark, path).database()["t"].first()["k"] == 3
    with pytest.raises(versions.VersionError):
        versions.Versions(spark, path).publish({}, 1)
    assert versions.Versions(spark, path).vacuum() and catalog.DatasetReader(spark, path).database()["t"].count() == 5
    assert catalog.DatasetReader(spark, path).version == 2
    with pytest.raises(FileNotFoundError):
        catalog.DatasetReader(spark, str(tmp_path))


def test_datasets_stored_as_text(spark, tmp_path):
    df = spark.sql("SELECT id, CAST(id / 4 AS decimal(10,2)) AS m, timestamp_ntz'2024-01-02 03:04:05' AS t, array(id, NULL) AS a, CAST('é' AS binary) AS r FROM range(4)")
    path = catalog.write_dataset(catalog.Dataset(Database({"t": df}, Keys({"t": ("id",)}))), str(tmp_path / "set"), as_text=True)
    reader = catalog.DatasetReader(spark, path)
    assert {f.dataType.simpleString() for f in spark.read.parquet(reader._places["t"]).schema.fields} == {"bigint", "string"}
    back = reader.table("t")
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_ranges_of_ids_reach_the_scan(spark, tmp_path):
    spark.range(0, 100_000, 1, 4).withColumn("x", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    asked = spark.createDataFrame([(i, i % 7 * 1000 + i) for i in range(300)] + [(999, 99_999), (5, 3)], "pos long, node_id long")
    assert features.id_ranges(asked, "node_id", block_rows=1000) == [(0, 6999), (99_000, 99_999)]
    got = features.gather(asked, table, "id", block_rows=1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, features.gather(asked, table, "id").collect()))
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,99000)" in plan and "LessThanOrEqual(id,6999)" in plan
    scattered = spark.range(0, 5_000_000, 50_000).select(F.col("id").alias("node_id"))
    ranges = features.id_ranges(scattered, "node_id", block_rows=10)
    assert len(ranges) <= features.MOST_RANGES and ranges[0][0] == 0 and ranges[-1][1] == 4_950_009
    assert features.within(table, "id", []).count() == 0


def test_entity_and_list_checks(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    checks.check_entity(make([(1,), (2,)], "k int"), ["k"])
    for rows in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(checks.TaskError):
            checks.check_entity(make(rows, "k int"), ["k"])
    kind = "split string, y array<int>"
    checks.check_labels(make([("train", [1, 2]), ("validation", []), ("test", None)], kind), "y", "multilabel_classification")
    for rows in ([("train", [1, 1])], [("train", None)], [("train", [1, None])]):
        with pytest.raises(checks.TaskError):
            checks.check_labels(make(rows, kind), "y", "recommendation")


def test_text_of_values(spark):
    df = spark.createDataFrame([("NaN", math.nan), (None, None), ("x", 1.5)], "s string, d double")
    assert [tuple(r) for r in df.select(scalars.text_value("s"), scalars.text_value("d")).collect()] == [("NaN", ""), ("", ""), ("x", "1.5")]


def test_reader(spark, tmp_path):
    large = 2**59 + 3
    spark.createDataFrame([(7, None), (8, large), (9, 8), (10, -large)], "id long, above long").write.parquet(str(tmp_path / "tree.parquet"))
    with readers.open_database(spark, str(tmp_path)) as db:
        assert db.names() == ["tree"]
        got = db.read_query("SELECT * FROM tree WHERE id BETWEEN :a AND :b ORDER BY id", a=8, b=9)
        assert got["above"].tolist() == [large, 8]
        assert [len(x) for x in db.iter_query("SELECT * FROM tree", batch_size=3)] == [3, 1]
        with pytest.raises(ValueError):
            db.iter_query("SELECT * FROM tree", batch_size=0)
    db.close()
    with pytest.raises(readers.ReaderClosedError):
        db.table("items")
    with pytest.raises(FileNotFoundError):
        readers.open_database(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        readers.open_database(spark, "x", reader="nope")
    assert readers.jdbc_url("postgresql+psycopg://u:p@h:5/d") == "jdbc:postgresql://h:5/d"
    assert readers.jdbc_url("mssql+pyodbc://h/d") == "jdbc:sqlserver://h;databaseName=d"


def test_artifacts(spark, tmp_path):
    df = spark.range(5).withColumn("hop", F.col("id") % 2)
    path = str(tmp_path / "plan")
    artifacts.save_frames({"e": df}, path, {"seed": 1}, {"e": ["hop"]})
    assert artifacts.load_frames(spark, path, {"seed": 1})["e"].count() == 5
    with pytest.raises(artifacts.ArtifactError):
        artifacts.load_frames(spark, path, {"seed": 2})
    artifacts.save_json(spark, f"{path}.json", "k", [1])
    assert artifacts.load_json(spark, f"{path}.json", "k") == [1]
    assert artifacts.load_json(spark, f"{path}.json", "other") is None
    rows = spark.createDataFrame([("a", "ok"), ("b", "failed")], "run string, state string")
    artifacts.append_log(rows, f"{path}.log")
    log = artifacts.read_log(spark, f"{path}.log", "run string, state string")
    assert [r[0] for r in artifacts.succeeded(log, ["run"]).collect()] == ["a"]


def test_encode_and_processors(spark):
    df = spark.createDataFrame([(0, "x", 1.0, day(1)), (1, "y", None, None), (2, None, 3.0, day(2))], "k long, c string, v double, t timestamp_ntz")
    vocab = stats.vocabulary(df.filter("k = 0"), "c")
    got = {r["k"]: r for r in features.encode_table(df, "k", {"c": "categorical", "v": "numerical", "t": "timestamp"}, {"c": vocab}).collect()}
    assert [got[i]["categorical"][0] for i in range(3)] == [0, -1, -1]
    assert got[1]["numerical"][0] is None and got[1]["timestamp"] == [-1] * 7
    assert features.encode_table(df.select("k"), "k", {}).first()["const"] == [1.0]
    for p in processors.plan({"v": "numerical", "c": "categorical", "t": "timestamp"}):
        df2 = p.fit(df).transform(df)
        assert set(p.output_spec()) <= set(df2.columns)
    with pytest.raises(ValueError):
        processors.plan({"x": "unknown"})
    with pytest.raises(processors.NotFittedError):
        processors.processor("index", "c").transform(df)


def test_processors_keep_their_state(spark, tmp_path):
    rows = [(0, "x", 1.0, day(1), "a,b", "one two"), (1, "y", None, None, "a", None), (2, "x", 3.0, day(2), None, "two"), (3, None, 8.0, day(3), "c,a,zz", "")]
    df = spark.createDataFrame(rows, "k long, c string, v double, t timestamp_ntz, m string, s string")
    types = {"c": "categorical", "v": "numerical", "t": "timestamp", "m": "multicategorical", "s": "text_embedded"}
    chosen = {"v": ("standardize", {"center": "median", "scale": "quartiles", "fill": "center"}), "c": ("index", {"least_count": 2}), "m": (None, {"separator": ","}), "s": (None, {"dim": 8})}
    plan = processors.fit_all(df.filter("k < 3"), processors.plan(types, chosen))
    out = {r["k"]: r for r in processors.transform_all(df, "k", plan).collect()}
    assert [out[k]["v_std"] for k in range(4)] == [-1.0, 0.0, 1.0, 6.0]
    assert [out[k]["c_idx"] for k in range(4)] == [0, -1, 0, -1]
    assert [out[k]["m_idx"] for k in range(4)] == [[0, 1], [0], [], [-1, 0, -1]]
    assert len(out[0]["s_vec"]) == 8 and out[1]["t_parts"] == [-1] * 7
    whole = processors.assemble(processors.transform_all(df, "k", plan), "k", plan)
    assert set(whole.columns) == {"k", "categorical", "multicategorical", "numerical", "text_embedded", "timestamp"}
    path = str(tmp_path / "plan")
    processors.save(spark, path, {"t": plan}, {"cutoff": 3})
    again = processors.load(spark, path, {"cutoff": 3})["t"]
    assert [p.digest() for p in again] == [p.digest() for p in plan]
    assert sorted(map(str, processors.transform_all(df, "k", again).collect())) == sorted(map(str, out.values()))
    with pytest.raises(artifacts.ArtifactError):
        processors.load(spark, path, {"cutoff": 4})
    with pytest.raises(ValueError):
        processors.processor("standardize", "v", scale="much")
    with pytest.raises(ValueError):
        processors.processor("standardize", "v", other=1)
    with pytest.raises(ValueError):
        processors.plan({"v": "numerical"}, {"v": ("index", {})})


def test_encoded_columns_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k), k) for k in range(20)], "k long, c string, v double, w long")
    types = {"c": "categorical", "v": "numerical", "w": "numerical"}
    store = EncodedStore(spark, str(tmp_path / "store"))
    plan = processors.fit_all(df.filter("k < 10"), processors.plan(types))
    want = sorted(map(tuple, processors.transform_all(df, "k", plan).collect()))
    for made in ([("t", c) for c in types], [("t", c) for c in types]):  # the second time nothing is made
        assert sorted(map(tuple, store.columns("t", df, "k", plan).collect())) == want and store.made == made
    other = processors.fit_all(df.filter("k < 12"), processors.plan(types))  # numbers are standardised otherwise, the vocabulary is too
    store.made = []
    assert sorted(map(tuple, store.columns("t", df, "k", [plan[0], *other[1:]]).collect())) == sorted(map(tuple, processors.transform_all(df, "k", [plan[0], *other[1:]]).collect()))
    assert store.made == [("t", "v"), ("t", "w")]
    store.made = []
    changed = df.withColumn("w", F.col("w") + F.when(F.col("k") == 3, 1).otherwise(0))
    store.columns("t", changed, "k", plan).collect()
    assert store.made == [("t", "w")]
    assert store.spec("t") == {"c": {"c_idx": "bigint"}, "v": {"v_std": "double"}, "w": {"w_std": "double"}}


def test_text_vectors(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, None), (3, "c")], "k int, s string")
    got = {r["k"]: r["embedding"] for r in text.embed_column(df, "s", text.hashed_embedder(16)).collect()}
    assert got[0] == got[1] and got[2] == [0.0] * 16 and got[0] != got[3]
    cache, hashed = str(tmp_path / "cache"), text.HashedVectors(16)
    assert text.refresh_cache(df, "s", cache, hashed).count() == 3
    assert text.refresh_cache(df, "s", cache, hashed).count() == 3
    first = text.WordVectors(spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 2.0])], "word string, vector array<float>"), dim=2)
    other = text.WordVectors(spark.createDataFrame([("a", [5.0, 0.0]), ("c", [0.0, 2.0])], "word string, vector array<float>"), dim=2)
    assert sorted(r["embedding"] for r in text.refresh_cache(df, "s", cache, first).collect()) == [[0.0, 0.0], [0.0, 2.0], [1.0, 0.0]]
    assert sorted(r["embedding"] for r in text.refresh_cache(df, "s", cache, other).collect()) == [[0.0, 0.0], [0.0, 2.0], [5.0, 0.0]]  # no stale hit
    text.compact_cache(spark, f"{cache}/embedder={first.digest()}", str(tmp_path / "small"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "small")).collect())) == sorted(map(tuple, text.refresh_cache(df, "s", cache, first).collect()))


def test_bags_equal_joined_vectors(spark, monkeypatch):
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    vectors = spark.createDataFrame([(w, [rng.uniform(-1, 1) for _ in range(5)]) for w in words[:25]], "word string, vector array<float>")
    df = spark.createDataFrame([(k, None if k == 7 else " ".join(rng.choices(words, k=rng.randrange(9)))) for k in range(60)], "k long, s string").repartition(3)
    monkeypatch.setattr(text, "BAG_IDS", 10)
    bags = {r["k"]: r["embedding"] for r in text.WordVectors(vectors, dim=5).embed(df, "s", "embedding").collect()}
    monkeypatch.setattr(text, "BROADCAST_BYTES", 0)
    joined = {r["k"]: r["embedding"] for r in text.WordVectors(vectors, dim=5).embed(df, "s", "embedding").collect()}
    assert bags.keys() == joined.keys() and all(bags[k] == pytest.approx(joined[k], abs=1e-6) for k in bags)


def test_edges_are_joined_in_small_tasks(spark, sf):
    """However large the tables, a task's share is bounded; a tighter bound of the user's own stays."""
    from tributary import session
    from tributary.plans.graph_queries import fk_edges_reverse

    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for own, want in (("64m", f"{session.TASK_BYTES}b"), ("1m", "1m")):
        spark.conf.set(size, own)
        spark.conf.unset(parts)
        fk_edges_reverse(spark, sf)
        assert spark.conf.get(size) == want and int(spark.conf.get(parts)) == session.MOST_TASKS
    spark.conf.unset(size)


def test_keys_are_looked_up_in_small_tasks(spark, monkeypatch):
    """Joins of rows with their parents are as many tasks as the bytes ask for, not as few as the session has shuffle partitions."""
    from tributary import session

    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    monkeypatch.setattr(session, "TASK_BYTES", 4096)
    rows = spark.range(40_000).selectExpr("id", "id % 30000 AS fk")
    parents = spark.range(20_000).withColumnRenamed("id", "key")
    looked_up = {
        "drop": (lambda: keys.resolve_dangling(rows, "fk", parents, "key"), 30_000),
        "null": (lambda: keys.resolve_dangling(rows, "fk", parents, "key", "null"), 40_000),
        "orphans": (lambda: keys.orphans(rows, ["fk"], parents, ["key"]), 10_000),
        "composite": (lambda: graph.composite_edges(rows, "id", ["fk"], parents, "key", ["key"]), 30_000),
    }
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        for name, (look_up, n) in looked_up.items():
            spark.conf.unset(size)
            spark.conf.unset(parts)
            found = look_up().cache()
            assert found.count() == n and found.rdd.getNumPartitions() > 8, name
            found.unpersist()
    finally:
        for key in (size, parts, *own):
            spark.conf.unset(key)


def test_batches_of_words_are_bounded(spark):
    df = spark.createDataFrame([("a b " * 500,)], "s string")
    text.bag_words(df, "s", pa.array(["a"]), np.ones((1, 1), np.float32), "v")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= text.BATCH_BYTES


def test_words_are_folded_in_their_text(spark):
    """No aggregation by text and word stands between the texts and their vectors."""
    df = spark.createDataFrame([(0, "b a b, B c"), (1, None), (2, "!"), (3, "a")], "k int, s string")
    counts = df.select("k", F.inline(text._word_counts("s"))).collect()
    assert sorted(map(tuple, counts)) == [(0, "a", 1), (0, "b", 3), (0, "c", 1), (3, "a", 1)]


def test_weighted_bags(spark):
    matrix = np.array([[1, 0], [0, 1], [4, 4]], np.float32)
    df = spark.createDataFrame([(0, [0, 1], [1.0, 3.0]), (1, [2, -1], [2.0, 9.0]), (2, [], []), (3, None, None), (4, [0, 1], [1.0, -1.0])], "k long, ids array<int>, w array<double>")
    got = {r["k"]: r["embedding"] for r in text.embed_bags(df, "ids", matrix, weights="w").collect()}
    assert got == {0: [0.25, 0.75], 1: [4.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    assert {r["k"]: r["embedding"] for r in text.embed_bags(df, "ids", matrix).collect()}[0] == [0.5, 0.5]


def test_reports(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 12)] + [("b", 5.0)], "g string, x double")
    got = {r["g"]: r["p50"] for r in metrics.nearest_rank(df, ["g"], "x", {"p50": 0.5}).collect()}
    assert got == {"a": 6.0, "b": 5.0}
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, math.nan)], "k int, x double")
    right = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 3.0), (3, math.nan)], "k int, x double")
    assert [tuple(r) for r in checks.differences(left, right, ["k"]).collect()] == [(2, "x")]


def test_routes(spark):
    k = spark.createDataFrame([("f", "a", "x"), ("f", "b", "y"), ("c", "p", "x")], "child string, fk string, parent string")
    got = {(r["kind"], r["source"], r["destination"]) for r in paths.atomic_routes(k).collect()}
    assert got == {("dim-dim", "c", "x"), ("dim-dim", "x", "c"), ("dim-fact-dim", "x", "y"), ("dim-fact-dim", "y", "x")}


def test_config():
    base = {"database": {"path": "/d"}, "task": {"table": "t", "type": "regression", "entity_table": "e", "entity_columns": "id", "target": "y", "key": ["k"]}}
    c = parse_config(base)
    assert c.task.split.fraction == 0.2 and c.sampling.num_neighbors == (128, 128)
    c = parse_config(base | {"model": {"channels": 64}, "training": {"epochs": 3}, "report": "out.jsonl", "task": base["task"] | {"name": "t", "split": {"type": "sql_query", "queries": {"test": "SELECT 1"}}}})
    assert c.model["channels"] == 64 and c.training["learning_rate"] == 0.005 and c.report == {"path": "out.jsonl", "format": "jsonl"} and c.task.name == "t"
    for change in ({"extra": 1}, {"model": {"dropout": 1}}, {"training": {"learning_rate": 0}}, {"task": base["task"] | {"split": {"type": "column"}}}, {"task": base["task"] | {"entity_columns": []}}, {"database": {"path": "a", "url": "b"}}, {"task": base["task"] | {"type": "x"}}, {"task": base["task"] | {"destination_table": "d"}}, {"task": base["task"] | {"split": {"fraction": 2}}}, {"task": base["task"] | {"split": {"queries": {"train": "SELECT 1"}}}}, {"sampling": {"batch_size": 0}}):
        with pytest.raises(ConfigError):
            parse_config(base | change)


def test_writers_and_summaries(spark, tmp_path):
    """A writer of one's own is found by name, and summaries are kept as text with a header."""
    kept = {}
    catalog.register_writer("Memory", lambda dataset, path, **how: kept.setdefault(path, dataset) and path)
    data = catalog.Dataset(Database({"t": spark.range(3)}, Keys({"t": ("id",)})))
    assert catalog.writer("memory")(data, "there") == "there" and kept["there"] is data
    assert catalog.writer("parquet") is catalog.write_dataset
    with pytest.raises(ValueError):
        catalog.writer("nothing")
    artifacts.write_csv(spark.createDataFrame([("a", 1.5), ("b,c", None)], "name string, x double"), str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "s")).collect()), key=str) == [("a", "1.5"), ("b,c", None)]


def test_processors_of_ones_own(spark):
    class Length(processors.Processor):
        name, semantic_type, learns = "length", "categorical", False

        def learn(self, found):
            return self

        @property
        def output(self):
            return f"{self.column}_length"

        def output_spec(self):
            return {self.output: "int"}

        def transform(self, rows):
            return rows.withColumn(self.output, F.length(self.column))

    processors.register_processor("length", Length)
    plan = processors.fit_all(spark.range(2), processors.plan({"s": "categorical"}, {"s": ("length", {})}))
    df = spark.createDataFrame([(0, "ab"), (1, None)], "k long, s string")
    assert sorted(map(tuple, processors.transform_all(df, "k", plan).collect()), key=str) == [(0, 2), (1, None)]

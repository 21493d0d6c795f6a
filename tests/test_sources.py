"""Arrow streams of results, and tables of other systems as Spark data sources."""

import datetime as dt
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from tributary.schema import Keys, Link
from tributary.sources import arrowstream, plugin, readers, sqlite


def test_stream_keeps_order_nulls_and_digits(spark):
    large = 2**60 + 1
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 == 0, F.lit(large) + F.col("id")).alias("x"), F.col("id").cast("string").alias("s"))
    for rows in (None, 1, 999, 5000, 9999):
        batches = list(arrowstream.arrow_stream(df, rows))
        assert all(isinstance(b, pa.RecordBatch) for b in batches)
        assert [i for b in batches for i in b.column("id").to_pylist()] == list(range(5000))
        assert rows is None or {b.num_rows for b in batches[:-1]} <= {rows} and batches[-1].num_rows <= rows
    whole = pa.Table.from_batches(batches)
    assert whole["x"].to_pylist() == [large + i if i % 3 == 0 else None for i in range(5000)]


def test_stream_is_lazy_and_has_a_schema_without_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stream = arrowstream.arrow_stream(spark.range(0, 40_000, 1, 40).mapInArrow(count, "id long"), 100)
    assert stream.read_next_batch().num_rows == 100 and seen.value < 40_000
    empty = arrowstream.arrow_stream(spark.createDataFrame([], "a long, t timestamp_ntz, v array<string>"), 10)
    assert empty.schema.names == ["a", "t", "v"] and list(empty) == []
    with pytest.raises(ValueError):
        arrowstream.arrow_stream(spark.range(1), 0)


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "shop's.sqlite")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE users (user_id INTEGER PRIMARY KEY, kind TEXT COLLATE NOCASE, born DATE, score REAL, ok BOOLEAN, raw BLOB);
        CREATE TABLE orders (order_id INTEGER PRIMARY KEY, user_id INTEGER REFERENCES users, at TIMESTAMP, amount REAL NOT NULL);
        CREATE TABLE shelf (room TEXT, place INTEGER, PRIMARY KEY (room, place)) WITHOUT ROWID;
        CREATE TABLE book (id INTEGER PRIMARY KEY, room TEXT, place INTEGER, FOREIGN KEY (room, place) REFERENCES shelf (room, place));
        CREATE TABLE empty (a INTEGER);
        CREATE VIEW rich AS SELECT user_id, score FROM users WHERE score > 5;
        CREATE TABLE "odd ""name" ("select" INTEGER, plain);
        INSERT INTO "odd ""name" VALUES (1, 'x'), (2, 3);
        INSERT INTO shelf VALUES ('a', 1), ('b', 2);
        INSERT INTO book VALUES (0, 'a', 1), (5, NULL, NULL);
    """)
    times = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.5+02:00", 1704164645, 2460311.5, None]
    db.executemany("INSERT INTO users VALUES (?, ?, ?, ?, ?, ?)", [(i, [None, "A", "a", "Ab", "b%"][i % 5], times[i % 5], [None, 1, 2.5, float("inf")][i % 4], [0, 1, None][i % 3], b"\x00x" if i % 2 else None) for i in range(1000)])
    db.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [(i, i % 1000, f"2024-01-{1 + i % 28:02} 00:00:00", float(i)) for i in range(3000)])
    db.commit()
    db.close()
    return path


def test_sqlite_types_and_values(spark, shop):
    with readers.open_database(spark, f"sqlite:///{shop}", split_rows="300") as db:
        assert db.names() == ["book", "empty", 'odd "name', "orders", "rich", "shelf", "users"]
        users = db.table("users")
        assert users.rdd.getNumPartitions() == 4
        assert [f.dataType for f in users.schema] == [T.LongType(), T.StringType(), T.TimestampNTZType(), T.DoubleType(), T.BooleanType(), T.BinaryType()]
        rows = {r["user_id"]: r for r in users.collect()}
        assert sorted(rows) == list(range(1000))
        day = dt.datetime(2024, 1, 2)
        assert [rows[i]["born"] for i in range(5)] == [day.replace(hour=3, minute=4, second=5), day.replace(hour=1, minute=4, second=5, microsecond=500000), day.replace(hour=3, minute=4, second=5), day.replace(day=2), None]
        assert [rows[i]["ok"] for i in range(3)] == [False, True, None] and bytes(rows[1]["raw"]) == b"\x00x" and rows[3]["score"] == float("inf")
        assert db.table("empty").count() == 0 and db.table("shelf").count() == 2 and db.table("rich").count() == 250
        assert [tuple(r) for r in db.table('odd "name').orderBy("select").collect()] == [(1, "x"), (2, "3")]
        assert db.table("users", columns=["score"]).columns == ["score"]
        with pytest.raises(KeyError):
            db.table("nothing")


def test_sqlite_filters_reach_the_source(spark, shop):
    source = sqlite.SqliteSource(shop, split_rows=100)
    assert len(source.splits("orders", [])) == 30
    assert source.splits("orders", [GreaterThanOrEqual(("order_id",), 2950)]) == [(2950, 2999)]
    assert source.splits("orders", [EqualTo(("order_id",), 5000)]) == []
    with readers.open_database(spark, shop, reader="sqlite", split_rows="100") as db:
        orders, users = db.table("orders"), db.table("users")
        assert orders.filter("order_id >= 2850 AND order_id < 2901").rdd.getNumPartitions() == 1
        tests = ["kind = 'A'", "kind > 'A'", "kind IN ('a', 'b%')", "kind IS NULL", "kind IS NOT NULL", "kind LIKE 'A%'", "kind LIKE 'b\\\\%%'", "score > 2", "score = double('infinity')", "born > timestamp_ntz'2024-01-02 02:00:00'", "ok", "user_id BETWEEN 7 AND 130 AND score IS NOT NULL", "user_id = 5 OR user_id = 6", "NOT kind = 'A'"]
        everything = users.cache()
        for t in tests:
            assert sorted(r["user_id"] for r in db.table("users").filter(t).collect()) == sorted(r["user_id"] for r in everything.filter(t).collect()), t
        everything.unpersist()
        got = db.read_query("SELECT kind, count(*) AS n FROM users JOIN orders USING (user_id) WHERE order_id < :most GROUP BY kind ORDER BY kind", most=1000)
        assert got["n"].tolist() == [200] * 5
        assert sum(b.num_rows for b in db.stream("SELECT * FROM orders", batch_size=700)) == 3000


def test_sqlite_declares_its_keys(spark, shop):
    keys = readers.open_database(spark, f"sqlite:///{shop}").keys()
    assert keys.ids == {"users": ("user_id",), "orders": ("order_id",), "shelf": ("room", "place"), "book": ("id",)}
    assert keys.links == (Link("book", ("room", "place"), "shelf", ("room", "place")), Link("orders", ("user_id",), "users"))


def test_values_of_no_type_are_named(spark, tmp_path):
    path = str(tmp_path / "bad.sqlite")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, x REAL); INSERT INTO t VALUES (1, 'many', 1), (2, 3, 'much')")
    db.close()
    with pytest.raises(Exception, match=r"t\.n: a value is no int64"):
        readers.open_database(spark, path, reader="sqlite").table("t", columns=["n"]).collect()
    with pytest.raises(Exception, match=r"t\.x: a value is no double"):
        readers.open_database(spark, path, reader="sqlite").table("t", columns=["x"]).collect()
    with pytest.raises(KeyError):
        sqlite.SqliteSource(path).schema("nothing")


def squares():
    """A class of this function is sent to workers whole; they can't import tests."""

    class Squares(plugin.TableSource):
        """A source of one's own: squares of numbers, ten to a split."""

        def __init__(self, n):
            self.n = n

        def names(self):
            return ["squares"]

        def schema(self, table):
            return T.StructType().add("k", "long").add("square", "long")

        def keys(self):
            return Keys({"squares": ("k",)})

        def answers(self, table, test):
            return isinstance(test, EqualTo) and test.attribute == ("k",)

        def splits(self, table, tests):
            wanted = {t.value for t in tests}
            return [k for k in range(0, self.n, 10) if not wanted or any(k <= w < k + 10 for w in wanted)]

        def scan(self, table, columns, split, tests):
            k = [i for i in range(split, min(split + 10, self.n)) if all(i == t.value for t in tests)]
            both = {"k": pa.array(k, pa.int64()), "square": pa.array([i * i for i in k], pa.int64())}
            yield pa.RecordBatch.from_arrays([both[c] for c in columns], names=list(columns))

    return Squares


def test_a_registered_source_is_read_by_sql(spark):
    source = squares()
    plugin.register_source("squares", lambda options: source(int(options["path"])))
    with readers.open_database(spark, "95", reader="Squares") as db:
        table = db.table("squares")
        assert table.rdd.getNumPartitions() == 10 and table.agg(F.sum("square")).scalar() is not None
        assert db.read_query("SELECT sum(square) AS s FROM squares")["s"].tolist() == [sum(i * i for i in range(95))]
        assert table.filter("k = 42").rdd.getNumPartitions() == 1
        assert [tuple(r) for r in table.filter("k = 42").collect()] == [(42, 1764)]
        assert table.filter("k = 1000").count() == 0
        assert db.keys().ids == {"squares": ("k",)}
        assert db.table("squares", columns=["square"]).columns == ["square"]
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW own USING squares OPTIONS (path '20', table 'squares')")
    assert spark.sql("SELECT count(*) FROM own WHERE square > 100").first()[0] == 9

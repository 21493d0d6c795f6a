"""The star-schema tables as a database with declared keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.keys import assign_dense_ids
from tributary.schema import Database, Keys, Link

KEYS = Keys(
    ids={"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("line_id",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",)},
    links=(
        Link("nation", ("n_regionkey",), "region"),
        Link("customer", ("c_nationkey",), "nation"),
        Link("supplier", ("s_nationkey",), "nation"),
        Link("orders", ("o_custkey",), "customer"),
        Link("lineitem", ("l_orderkey",), "orders"),
        Link("lineitem", ("l_partkey",), "part"),
        Link("lineitem", ("l_suppkey",), "supplier"),
        Link("events", ("user_id",), "customer"),
        Link("labels", ("doc_id",), "documents"),
    ),
    times={"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"},
)
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_ID_SQL = f"row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def database(spark: SparkSession, sf_dir: str, names: list[str], dense: bool = True) -> Database:
    """Those tables; ``lineitem`` has no key of its own and gets ids: dense ones, or any where only counts are asked for."""
    frames = {n: table(spark, sf_dir, n) for n in names}
    if "lineitem" in frames:
        lines = frames["lineitem"]
        frames["lineitem"] = assign_dense_ids(lines, LINE_ORDER, "line_id") if dense else lines.withColumn("line_id", F.monotonically_increasing_id())
    return Database(frames, KEYS.within(names))


Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module with their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep

"""Queries over keys, graph construction and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalars import order_key
from tributary.operators import graph, keys, sampling, stats
from tributary.plans.fixture import LINE_ID_SQL, LINE_ORDER, Registry, database, table

REGISTRY = Registry()
CUTOFF = "1999-01-01 00:00:00"
TABLES = {"region": None, "nation": None, "customer": None, "supplier": None, "part": None, "orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "documents": None, "labels": None}
KEYED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@REGISTRY.add("""
WITH seeds AS (SELECT c_custkey AS seed_id, TIMESTAMP '1999-01-01 00:00:00' AS seed_time FROM customer),
h1 AS (SELECT seed_id, seed_time, o_orderkey, row_number() OVER (PARTITION BY seed_id ORDER BY md5(concat_ws('|', '42', '1', CAST(seed_id AS string), CAST(o_orderkey AS string))), o_orderkey) AS rk
       FROM seeds JOIN orders ON o_custkey = seed_id WHERE o_orderdate <= seed_time),
s1 AS (SELECT * FROM h1 WHERE rk <= 4),
h2 AS (SELECT s1.seed_id, s1.o_orderkey, l_partkey, l_extendedprice,
         row_number() OVER (PARTITION BY s1.seed_id, s1.o_orderkey ORDER BY md5(concat_ws('|', '42', '2', CAST(s1.o_orderkey AS string), CAST(l_linenumber AS string),
           CAST(l_partkey AS string), CAST(l_suppkey AS string))), l_extendedprice) AS rk
       FROM s1 JOIN lineitem ON l_orderkey = s1.o_orderkey WHERE l_shipdate <= seed_time),
s2 AS (SELECT * FROM h2 WHERE rk <= 2)
SELECT seeds.seed_id, count(DISTINCT s1.o_orderkey) AS n_orders, CAST(count(s2.l_partkey) AS bigint) AS n_items, round(coalesce(sum(s2.l_extendedprice), 0.0), 4) AS item_value
FROM seeds LEFT JOIN s1 ON seeds.seed_id = s1.seed_id LEFT JOIN s2 ON s1.seed_id = s2.seed_id AND s1.o_orderkey = s2.o_orderkey GROUP BY seeds.seed_id""")
def ego_two_hop_features(spark, sf_dir):
    """Customers, up to four of their orders and two lines of each, none later than the seed."""
    customer, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    seeds = customer.select(F.col("c_custkey").alias("seed_id"), F.lit(CUTOFF).cast("timestamp_ntz").alias("seed_time"))
    orders = orders.select(F.col("o_custkey").alias("seed_id"), "o_orderkey", "o_orderdate")
    first = sampling.sample_neighbours(seeds, orders, ["seed_id"], tree=["seed_id"], fanout=4, order=[order_key(42, 1, "seed_id", "o_orderkey"), F.col("o_orderkey")], time="o_orderdate").select("seed_id", "seed_time", "o_orderkey")
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = [order_key(42, 2, "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("l_extendedprice")]
    second = sampling.sample_neighbours(first, lines, ["o_orderkey"], tree=["seed_id", "o_orderkey"], fanout=2, order=order, time="l_shipdate")
    found = first.select("seed_id", "o_orderkey").join(second.select("seed_id", "o_orderkey", "l_partkey", "l_extendedprice"), ["seed_id", "o_orderkey"], "left")
    per = found.groupBy("seed_id").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.count("l_partkey").alias("n_items"), F.sum("l_extendedprice").alias("v"))
    return seeds.select("seed_id").join(per, "seed_id", "left").select("seed_id", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("item_value"))


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST(coalesce(sum({f'CAST({c} <= TIMESTAMP {chr(39)}{CUTOFF}{chr(39)} AS BIGINT)' if c else '1'}), 0) AS BIGINT) AS n_cutoff, {f'min({c})' if c else 'CAST(NULL AS TIMESTAMP)'} AS min_time, {f'max({c})' if c else 'CAST(NULL AS TIMESTAMP)'} AS max_time FROM {t}" for t, c in TABLES.items()))
def table_stats_catalog(spark, sf_dir):
    """Rows, rows up to the cutoff and time span of every table."""
    return _union([stats.table_stats(table(spark, sf_dir, t), t, c, CUTOFF).select("table", "n_rows", "n_cutoff", "min_time", "max_time") for t, c in TABLES.items()])


def _density_sql(t: str, k: str, where: str = "") -> str:
    return f"SELECT '{t}' AS \"table\", count(*) AS n, count(*) - count({k}) AS n_null, count(DISTINCT {k}) AS n_distinct, CAST(min({k}) AS BIGINT) AS min_id, CAST(max({k}) AS BIGINT) AS max_id, coalesce(count(*) = 0 OR (count({k}) = count(*) AND count(DISTINCT {k}) = count(*) AND min({k}) = 0 AND max({k}) = count(*) - 1), FALSE) AS is_dense FROM {t}{where}"


_DENSE = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey", "documents": "doc_id"}


@REGISTRY.add(" UNION ALL ".join(_density_sql(t, k) for t, k in _DENSE.items()))
def dense_id_check(spark, sf_dir):
    return _union([keys.density(table(spark, sf_dir, t), k).withColumn("table", F.lit(t)) for t, k in _DENSE.items()])


@REGISTRY.add(" UNION ALL ".join(_density_sql(t, k, f" WHERE {c} <= TIMESTAMP '{CUTOFF}'") for t, k, c in (("orders", "o_orderkey", "o_orderdate"), ("events", "event_id", "ts"))))
def cutoff_gap_detection(spark, sf_dir):
    """Whether a cutoff leaves ids 0..N-1."""
    cut = lambda t, c: keys.before_cutoff(table(spark, sf_dir, t), c, CUTOFF)
    return _union([keys.density(cut(t, c), k).withColumn("table", F.lit(t)) for t, k, c in (("orders", "o_orderkey", "o_orderdate"), ("events", "event_id", "ts"))])


@REGISTRY.add(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {LINE_ID_SQL} AS line_id FROM lineitem")
def assign_dense_ids(spark, sf_dir):
    return keys.assign_dense_ids(table(spark, sf_dir, "lineitem"), LINE_ORDER, "line_id").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line_id")


@REGISTRY.add("SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_nationkey, c_mktsegment) - 1 AS node_id FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def composite_key_mapping(spark, sf_dir):
    """A key of two columns as dense ids."""
    return keys.key_mapping(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "node_id")


@REGISTRY.add(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t} WHERE {c} <= TIMESTAMP '{CUTOFF}'" for t, c in TABLES.items() if c))
def cutoff_view_counts(spark, sf_dir):
    return _union([keys.before_cutoff(table(spark, sf_dir, t), c, CUTOFF).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, c in TABLES.items() if c])


# ---- edges

_KEYS = [("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey", None), ("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey", None), ("supplier", "s_suppkey", "s_nationkey", "nation", "n_nationkey", None), ("orders", "o_orderkey", "o_custkey", "customer", "c_custkey", "o_orderdate"), ("lineitem", "line_id", "l_orderkey", "orders", "o_orderkey", "l_shipdate"), ("lineitem", "line_id", "l_partkey", "part", "p_partkey", "l_shipdate"), ("lineitem", "line_id", "l_suppkey", "supplier", "s_suppkey", "l_shipdate"), ("events", "event_id", "user_id", "customer", "c_custkey", "ts")]
_PARENT_TIME = {"orders": "o_orderdate"}


def _edge_sql(reverse: bool) -> str:
    parts = []
    for child, own, fk, parent, key, time in _KEYS:
        source = f"(SELECT *, {LINE_ID_SQL} AS line_id FROM lineitem)" if child == "lineitem" else child
        seconds = lambda c: f"epoch_us({c}) // 1000000" if c else "CAST(NULL AS BIGINT)"
        if reverse:
            cols = f"'rev_f2p_{fk}' AS edge_type, '{parent}' AS src_type, '{child}' AS dst_type, CAST({fk} AS BIGINT) AS src_id, CAST({own} AS BIGINT) AS dst_id, {seconds(_PARENT_TIME.get(parent))} AS src_time"
        else:
            cols = f"'f2p_{fk}' AS edge_type, '{child}' AS src_type, '{parent}' AS dst_type, CAST({own} AS BIGINT) AS src_id, CAST({fk} AS BIGINT) AS dst_id, {seconds(time)} AS src_time"
        parts.append(f"SELECT {cols} FROM {source} c JOIN {parent} p ON c.{fk} = p.{key}")
    return " UNION ALL ".join(parts)


@REGISTRY.add(_edge_sql(False))
def fk_edges_forward(spark, sf_dir):
    return graph.edges(database(spark, sf_dir, KEYED), directions=(False,))


@REGISTRY.add(_edge_sql(True))
def fk_edges_reverse(spark, sf_dir):
    return graph.edges(database(spark, sf_dir, KEYED), directions=(True,))


@REGISTRY.add(f"SELECT edge_type, src_type, dst_type, count(*) AS n_edges FROM ({_edge_sql(False)} UNION ALL {_edge_sql(True)}) GROUP BY ALL")
def edge_type_counts(spark, sf_dir):
    return graph.counts(graph.edges(database(spark, sf_dir, KEYED, dense=False)))


@REGISTRY.add(f"""WITH e AS ({_edge_sql(False)} UNION ALL {_edge_sql(True)})
SELECT 'edge' AS part, src_type || '__' || edge_type || '__' || dst_type AS name, count(*) AS n, count(src_time) AS n_timed FROM e GROUP BY ALL
""" + "".join(f" UNION ALL SELECT 'node', '{t}', count(*), {f'count({c})' if c else '0'} FROM {t}" for t, c in TABLES.items() if t in KEYED))
def graph_report(spark, sf_dir):
    db = database(spark, sf_dir, KEYED, dense=False)
    return graph.report(graph.nodes(db), graph.edges(db))


_ORDERS = "SELECT o_custkey AS dst_id, count(*) AS d FROM orders GROUP BY 1"


@REGISTRY.add(f"SELECT c_custkey AS node_id, coalesce(d, 0) AS degree FROM customer LEFT JOIN ({_ORDERS}) ON dst_id = c_custkey")
def in_degree(spark, sf_dir):
    db = database(spark, sf_dir, ["customer", "orders"])
    return graph.in_degree(graph.key_edges(db, db.links[0]), db["customer"].select(F.col("c_custkey").alias("node_id")))


@REGISTRY.add(f"""SELECT node_id, CAST(sum(degree) OVER (ORDER BY node_id) - degree AS BIGINT) AS start, CAST(sum(degree) OVER (ORDER BY node_id) AS BIGINT) AS "end"
FROM (SELECT c_custkey AS node_id, coalesce(d, 0) AS degree FROM customer LEFT JOIN ({_ORDERS}) ON dst_id = c_custkey)""")
def csc_pointer(spark, sf_dir):
    return graph.pointers(in_degree(spark, sf_dir), block=256)


@REGISTRY.add("SELECT o_orderkey AS src_id, o_custkey AS dst_id, epoch_us(o_orderdate) // 1000000 AS src_time, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders")
def neighbor_rank_by_time(spark, sf_dir):
    db = database(spark, sf_dir, ["customer", "orders"])
    return graph.neighbour_rank(graph.key_edges(db, db.links[0])).select("src_id", "dst_id", "src_time", "rank")


@REGISTRY.add(f"""SELECT 'drop' AS mode, count(*) AS n, count(l_orderkey) AS n_set FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF}')
UNION ALL SELECT 'null', count(*), count(o_orderkey) FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF}') ON o_orderkey = l_orderkey""")
def dangling_fk_after_cutoff(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), keys.before_cutoff(table(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    parts = []
    for mode in ("drop", "null"):
        rows = keys.resolve_dangling(lines, "l_orderkey", orders, "o_orderkey", mode)
        parts.append(rows.agg(F.count("*").alias("n"), F.count("l_orderkey").alias("n_set")).select(F.lit(mode).alias("mode"), "n", "n_set"))
    return _union(parts)


# ---- sampling


@REGISTRY.add("""
WITH s AS (SELECT c_custkey AS tree_id, c_custkey AS node_id, 1705363200 AS seed_time FROM customer),
r AS (SELECT tree_id, event_id AS src_id, node_id AS dst_id, row_number() OVER (PARTITION BY tree_id ORDER BY md5(concat_ws('|', '42', '1', CAST(tree_id AS string), 'f2p_user_id', CAST(node_id AS string), CAST(event_id AS string))), event_id) AS rk
      FROM s JOIN events ON user_id = node_id WHERE epoch_us(ts) // 1000000 <= 1705363200)
SELECT CAST(tree_id AS BIGINT) AS tree_id, 'f2p_user_id' AS edge_type, src_id, CAST(dst_id AS BIGINT) AS dst_id, 1 AS hop FROM r WHERE rk <= 3""")
def sample_one_hop_temporal(spark, sf_dir):
    """Up to three events of each customer."""
    db = database(spark, sf_dir, ["customer", "events"])
    seeds = db["customer"].select(F.col("c_custkey").alias("tree_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"), F.lit(1705363200).alias("seed_time"))  # the middle of the events
    return sampling.khop(seeds, graph.edges(db, directions=(False,)), [3])[1]


_SEED_TIME = 915148800  # 1999-01-01


def _khop_sql(fan: dict[str, int], trees: str, hops: str = "1") -> str:
    parts = []
    for name, own, source, fk, time in (("f2p_o_custkey", "o_orderkey", "orders", "o_custkey", "o_orderdate"), ("f2p_user_id", "event_id", "events", "user_id", "ts")):
        if name in fan:
            parts.append(f"""SELECT tree_id, '{name}' AS edge_type, {own} AS src_id, node_id AS dst_id FROM (SELECT tree_id, node_id, {own},
 row_number() OVER (PARTITION BY tree_id ORDER BY md5(concat_ws('|', '42', '1', CAST(tree_id AS string), '{name}', CAST(node_id AS string), CAST({own} AS string))), {own}) AS rk
 FROM trees JOIN {source} ON {fk} = node_id WHERE epoch_us({time}) // 1000000 <= seed_time) WHERE rk <= {fan[name]}""")
    return f"WITH trees AS ({trees}) " + " UNION ALL ".join(parts)


@REGISTRY.add(_khop_sql({"f2p_o_custkey": 4, "f2p_user_id": 2}, f"SELECT CAST(c_custkey AS BIGINT) AS tree_id, CAST(c_custkey AS BIGINT) AS node_id, {_SEED_TIME} AS seed_time FROM customer"))
def sample_per_relation_fanout(spark, sf_dir):
    """Four orders and two events of each customer."""
    db = database(spark, sf_dir, ["customer", "orders", "events"])
    seeds = db["customer"].select(F.col("c_custkey").alias("tree_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"), F.lit(_SEED_TIME).cast("bigint").alias("seed_time"))
    taken = sampling.khop(seeds, graph.edges(db, directions=(False,)), [{"f2p_o_custkey": 4, "f2p_user_id": 2}])[1]
    return taken.select("tree_id", "edge_type", "src_id", "dst_id")


@REGISTRY.add(_khop_sql({"f2p_o_custkey": 3}, f"SELECT CAST(c_custkey AS string) || '@' || CAST(t AS string) AS tree_id, CAST(c_custkey AS BIGINT) AS node_id, {_SEED_TIME} + t * 31536000 AS seed_time FROM customer, (VALUES (-1), (0), (1)) AS times(t)"))
def sample_disjoint_trees(spark, sf_dir):
    """All customers at three times: a tree each."""
    db = database(spark, sf_dir, ["customer", "orders"])
    times = F.explode(F.array(*[F.lit(t) for t in (-1, 0, 1)])).alias("t")
    rows = db["customer"].select("c_custkey", times)
    seeds = rows.select(F.concat_ws("@", F.col("c_custkey").cast("string"), F.col("t").cast("string")).alias("tree_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"), (F.lit(_SEED_TIME) + F.col("t") * 31536000).cast("bigint").alias("seed_time"))
    return sampling.khop(seeds, graph.edges(db, directions=(False,)), [3])[1].select("tree_id", "edge_type", "src_id", "dst_id")


def _below(n: str, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {n}"


_NEGATIVE = _below("(SELECT count(*) FROM part)", "'42'", "'3'", "CAST(c_custkey AS string)")


@REGISTRY.add(f"SELECT c_custkey, {_NEGATIVE} AS negative_id FROM customer")
def negative_samples(spark, sf_dir):
    return sampling.negatives(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "part").count(), "c_custkey")


_BOUGHT = f"""SELECT o_custkey AS c_custkey, arg_min(l_partkey, md5(concat_ws('|', '42', '4', o_custkey::VARCHAR, l_partkey::VARCHAR))) AS positive_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"""


def _bought(spark, sf_dir):
    """A part of each customer's."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_partkey")
    return sampling.one_of_each(pairs, "l_partkey", "c_custkey")


@REGISTRY.add(_BOUGHT)
def positive_choice(spark, sf_dir):
    """One part of those each customer bought."""
    return _bought(spark, sf_dir)


@REGISTRY.add(f"SELECT c_custkey, positive_id, {_NEGATIVE} AS negative_id FROM ({_BOUGHT})")
def recommendation_triples(spark, sf_dir):
    return sampling.negatives(_bought(spark, sf_dir), table(spark, sf_dir, "part").count(), "c_custkey").select("c_custkey", "positive_id", "negative_id")


@REGISTRY.add(f"""WITH t AS (SELECT c_custkey, positive_id, {_NEGATIVE} AS negative_id FROM ({_BOUGHT}))
SELECT 'source:' || CAST(c_custkey AS string) AS tree_id, 'customer' AS node_type, CAST(c_custkey AS BIGINT) AS node_id FROM t
UNION ALL SELECT 'positive:' || CAST(c_custkey AS string), 'part', CAST(positive_id AS BIGINT) FROM t
UNION ALL SELECT 'negative:' || CAST(c_custkey AS string), 'part', CAST(negative_id AS BIGINT) FROM t""")
def recommendation_branches(spark, sf_dir):
    """Seeds of the three trees of each triple."""
    t = recommendation_triples(spark, sf_dir).select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("source_id"), "positive_id", "negative_id", F.lit(_SEED_TIME).alias("seed_time"))
    return sampling.branches(t, "customer", "part").select("tree_id", "node_type", "node_id")

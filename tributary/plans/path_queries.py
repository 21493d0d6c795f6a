"""Queries over routes, propagation, kept plans and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import graph, paths, sampling
from tributary.plans.fixture import KEYS, Registry, database, table
from tributary.session import cut
from tributary.sources import artifacts
from tributary.streaming import windows

REGISTRY = Registry()

_TABLES = ["nation", "customer", "orders", "lineitem", "part", "supplier", "region"]
_OWN = KEYS.within(_TABLES).links
_KEY_ROWS = " UNION ALL ".join(f"SELECT '{x.child}' AS child, '{x.name}' AS fk, '{x.parent}' AS parent, count({x.columns[0]}) AS n_rows FROM {x.child}" for x in _OWN)


@REGISTRY.add(f"""WITH k AS (SELECT *, count(*) OVER (PARTITION BY child) AS n FROM ({_KEY_ROWS}))
SELECT 'dim-dim' AS kind, child AS source, CAST(NULL AS VARCHAR) AS middle, parent AS destination, fk AS via_in, CAST(NULL AS VARCHAR) AS via_out, n_rows FROM k WHERE n = 1
UNION ALL SELECT 'dim-dim', parent, NULL, child, 'rev_' || fk, NULL, n_rows FROM k WHERE n = 1
UNION ALL SELECT 'dim-fact-dim', a.parent, a.child, b.parent, a.fk, b.fk, a.n_rows FROM k a JOIN k b ON a.child = b.child AND a.fk <> b.fk WHERE a.n > 1""")
def atomic_routes(spark, sf_dir):
    """Routes between the tables, with the number of rows that have the key each route goes in by."""
    db = database(spark, sf_dir, _TABLES, dense=False)
    routes = paths.atomic_routes(paths.foreign_key_table(db))
    counts = graph.counts(graph.union_all([graph.key_edges(db, x, on_dangling="null") for x in db.links]))
    own = counts.select(F.regexp_replace("edge_type", "^f2p_", "").alias("fk"), F.col("n_edges").alias("n_rows"))
    return routes.join(own, F.regexp_replace("via_in", "^rev_", "") == own["fk"]).drop("fk")


@REGISTRY.add("SELECT c_nationkey::BIGINT AS node_id, round(avg(m), 6) AS value FROM (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def metapath_mean_two_hop(spark, sf_dir):
    """Mean order value of customers, and its mean over the customers of each nation."""
    db = database(spark, sf_dir, ["nation", "customer", "orders"])
    links = {x.child: graph.key_edges(db, x).select("src_id", "dst_id") for x in db.links}
    values = db["orders"].select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("value"))
    return paths.metapath(values, [links["orders"], links["customer"]]).select("node_id", F.round("value", 6).alias("value"))


_OVER = "SELECT l_suppkey AS node_id, round(avg(p_retailprice), 6) AS value, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"


@REGISTRY.add(_OVER)
def route_dim_fact_dim(spark, sf_dir):
    """Part prices over lines to suppliers."""
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("value"))
    return paths.over_fact(prices, table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").withColumn("value", F.round("value", 6))


@REGISTRY.add("""SELECT node_id, round(avg(value), 4) AS value FROM (SELECT l_suppkey AS node_id, avg(p_retailprice) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
UNION ALL SELECT l_suppkey, avg(o_totalprice) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) GROUP BY node_id""")
def route_combination(spark, sf_dir):
    """Two routes to suppliers, their mean."""
    lines = table(spark, sf_dir, "lineitem")
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("value"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("value"))
    parts = [paths.over_fact(prices, lines, "l_partkey", "l_suppkey"), paths.over_fact(totals, lines, "l_orderkey", "l_suppkey")]
    return paths.combine_routes(parts, "mean").withColumn("value", F.round("value", 4))


@REGISTRY.add("SELECT label, pos, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL")
def embedding_neighbor_mean(spark, sf_dir):
    """Mean vector of the members of each label."""
    return paths.vector_mean(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


@REGISTRY.add("SELECT CAST(3 AS BIGINT) AS epoch, o_custkey AS tree_id, o_orderkey AS src_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', '42', '1', CAST(o_custkey AS string), 'f2p_o_custkey', CAST(o_custkey AS string), CAST(o_orderkey AS string))), o_orderkey) AS rk FROM orders WHERE epoch_us(o_orderdate) // 1000000 <= 893462400) WHERE rk <= 2")
def fixed_replay_round_trip(spark, sf_dir):
    """A sampled plan written with its checksum, read back and replayed as another epoch."""
    import uuid

    db = database(spark, sf_dir, ["customer", "orders"])
    seeds = db["customer"].select(F.col("c_custkey").alias("tree_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node_id"), F.lit(893462400).alias("seed_time"))
    plan = sampling.khop(seeds, graph.edges(db, directions=(False,)), [2])[1]
    cut(spark.range(1))  # sets the checkpoint folder where none is named
    path = f"{spark.sparkContext.getCheckpointDir()}/plan-{uuid.uuid4().hex}"
    identity = {"seed": 42, "fanouts": [2], "data": sf_dir}
    artifacts.save_frames({"edges": plan}, path, identity, {"edges": ["hop"]})
    return artifacts.replay(artifacts.load_frames(spark, path, identity)["edges"], 3).select("epoch", "tree_id", "src_id")


@REGISTRY.add("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """An extension: totals of tumbling windows, as a stream would give them."""
    out = windows.window_totals(table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4))


@REGISTRY.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 1 DAY)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """An extension: sessions of each user, closed after a day without events."""
    return windows.sessions(table(spark, sf_dir, "events"), gap="1 day")

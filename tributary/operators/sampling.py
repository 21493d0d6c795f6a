"""Temporal neighbourhood sampling without replacement.

Randomness is an order by hash (``order_key``), so a sample is the same wherever
and however often it is computed; a neighbour is visible to a seed if it is no
later than the seed.  Each seed has a tree of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scalars import hash_below, order_key
from tributary.session import cut


def sample_neighbours(frontier: DataFrame, neighbours: DataFrame, on: Column | list[str], *, tree: list[str], fanout: int, order: list[Column], time: str | None = None, seed_time: str = "seed_time") -> DataFrame:
    """The joined rows of up to ``fanout`` visible neighbours of each frontier row.

    ``tree`` names the columns that tell frontier rows apart, ``order`` the order in
    which neighbours are taken.  The limit by rank is pushed below the shuffle.
    """
    rows = frontier.join(neighbours, on)
    if time is not None:
        rows = rows.filter(F.col(time).isNull() | (F.col(time) <= F.col(seed_time)))
    rank = F.row_number().over(Window.partitionBy(*tree).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= fanout)


def khop(seeds: DataFrame, edges: DataFrame, fanouts: Sequence[int | Mapping[str, int]], *, base_seed: int = 42, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """Trees of ``len(fanouts)`` hops around ``seeds`` (tree_id, node_type, node_id, seed_time).

    Returns nodes (tree_id, node_type, node_id, hop) and edges (tree_id, edge_type,
    src_id, dst_id, hop).  A fan-out is one number for all edge types or one for each.
    With ``once`` a node is expanded once a tree, as it is first met.
    """
    frontier = seeds.select("tree_id", "node_type", F.col("node_id").cast("bigint").alias("node_id"), "seed_time")
    met = frontier.withColumn("hop", F.lit(0))
    taken = None
    for hop, fan in enumerate(fanouts, 1):
        ends = edges.select("edge_type", F.col("src_type"), F.col("dst_type").alias("node_type"), "src_id", F.col("dst_id").alias("node_id"), "src_time")
        if isinstance(fan, Mapping):
            limit = F.coalesce(*[F.when(F.col("edge_type") == k, n) for k, n in fan.items()], F.lit(0))
            ends = ends.filter(F.col("edge_type").isin(*fan))
        else:
            limit = F.lit(fan)
        order = [order_key(base_seed, hop, "tree_id", "edge_type", "node_id", "src_id"), F.col("src_id")]
        most = max(fan.values()) if isinstance(fan, Mapping) else fan
        rows = sample_neighbours(frontier, ends, ["node_type", "node_id"], tree=["tree_id", "edge_type", "node_type", "node_id"], fanout=most, order=order, time="src_time").filter(F.col("rank") <= limit)
        step = rows.select("tree_id", "edge_type", "src_type", "src_id", F.col("node_id").alias("dst_id"), "seed_time", F.lit(hop).alias("hop"))
        taken = step if taken is None else taken.unionByName(step)
        found = step.select("tree_id", F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), "seed_time").distinct()
        frontier = found.join(met.select("tree_id", "node_type", "node_id"), ["tree_id", "node_type", "node_id"], "left_anti") if once else found
        met = met.unionByName(frontier.withColumn("hop", F.lit(hop)))
        if hop >= 3:
            frontier, met, taken = cut(frontier), cut(met), cut(taken)
    return met.select("tree_id", "node_type", "node_id", "hop"), taken.select("tree_id", "edge_type", "src_id", "dst_id", "hop")


def negatives(rows: DataFrame, n: int, *key: str, seed: int = 42, name: str = "negative_id") -> DataFrame:
    """A uniform id below ``n`` for each row, with replacement; it may be a positive."""
    return rows.withColumn(name, hash_below(n, seed, 3, *key))


def choose_positive(rows: DataFrame, candidates: str, *key: str, seed: int = 42, name: str = "positive_id") -> DataFrame:
    """One element of each row's array."""
    at = hash_below(F.size(candidates).cast("bigint"), seed, 4, *key)
    return rows.withColumn(name, F.get(F.col(candidates), at.cast("int")))


def one_of_each(pairs: DataFrame, candidate: str, *key: str, seed: int = 42, name: str = "positive_id") -> DataFrame:
    """(key, one of its candidates): the least by hash, so repeats change nothing and no candidates are gathered."""
    return pairs.groupBy(*key).agg(F.min_by(candidate, order_key(seed, 4, *key, candidate)).alias(name))


def branches(triples: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """Seeds of the three trees of each triple: source, positive and negative."""
    parts = [("source", source_type, "source_id"), ("positive", target_type, "positive_id"), ("negative", target_type, "negative_id")]
    out = None
    for branch, kind, column in parts:
        own = triples.select(F.concat_ws(":", F.lit(branch), F.col("row_id").cast("string")).alias("tree_id"), F.lit(kind).alias("node_type"), F.col(column).cast("bigint").alias("node_id"), "seed_time")
        out = own if out is None else out.unionByName(own)
    return out

"""A database as a typed temporal graph of two DataFrames.

Nodes are (node_type, node_id, node_time); edges are (edge_type, src_type, dst_type,
src_id, dst_id, src_time).  Every foreign key gives two edge types: child to parent
and back.  Neighbours of a node are the sources of edges that end in it, ordered
by (source time, source id).  No feature or label is part of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scalars import instant, seconds
from tributary.operators.keys import before_cutoff, require_dense, resolve_dangling
from tributary.schema import Database, Link
from tributary.session import small_tasks


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def relation(link: Link, reverse: bool = False) -> str:
    return f"{'rev_' if reverse else ''}f2p_{link.name}"


def _time(db: Database, table: str, at_seconds: bool):
    time = db.times.get(table)
    if time is None:
        return F.lit(None).cast("bigint" if at_seconds else "timestamp")
    moment = instant(time) if db[table].schema[time].dataType.simpleString() == "string" else F.col(time).cast("timestamp")
    return seconds(moment) if at_seconds else moment


def nodes(db: Database, *, cutoff=None, strict: bool = False, at_seconds: bool = True) -> DataFrame:
    """Nodes of all tables with an id.  ``strict`` demands ids 0..N-1 after the cutoff."""
    parts = []
    for table in db.ids:
        rows, key = before_cutoff(db[table], db.times.get(table), cutoff), db.id_of(table)
        if strict:
            require_dense(rows, key, table)
        parts.append(rows.select(F.lit(table).alias("node_type"), F.col(key).cast("bigint").alias("node_id"), _time(db, table, at_seconds).alias("node_time")))
    return union_all(parts)


def key_edges(db: Database, link: Link, *, cutoff=None, reverse: bool = False, on_dangling: str = "drop", at_seconds: bool = True) -> DataFrame:
    """Edges of one link, in one direction.  Rows with a null in the key give none; a key that is no node id is looked up."""
    child, parent, own_id = link.child, link.parent, db.id_of(link.child)
    small_tasks(db[child].sparkSession)
    rows = before_cutoff(db[child], db.times.get(child), cutoff).dropna(subset=list(link.columns))
    others = before_cutoff(db[parent], db.times.get(parent), cutoff)
    direct = link.key == (db.id_of(parent),)
    if reverse or not direct:
        known = others.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(link.key)], F.col(db.id_of(parent)).alias("__parent"), _time(db, parent, at_seconds).alias("__time"))
        same = reduce(lambda a, b: a & b, [rows[c] == known[f"__k{i}"] for i, c in enumerate(link.columns)])
        rows = rows.join(known, same, "inner" if on_dangling == "drop" else "left")
        parent_id = F.col(link.columns[0] if direct else "__parent")
    else:
        rows, parent_id = resolve_dangling(rows, link.columns[0], others, link.key[0], on_dangling), F.col(link.columns[0])
    types, ids = ((parent, child), (parent_id, F.col(own_id))) if reverse else ((child, parent), (F.col(own_id), parent_id))
    time = F.col("__time") if reverse else _time(db, child, at_seconds)
    return rows.select(F.lit(relation(link, reverse)).alias("edge_type"), F.lit(types[0]).alias("src_type"), F.lit(types[1]).alias("dst_type"), ids[0].cast("bigint").alias("src_id"), ids[1].cast("bigint").alias("dst_id"), time.alias("src_time"))


def edges(db: Database, *, cutoff=None, directions: tuple[bool, ...] = (False, True), on_dangling: str = "drop", at_seconds: bool = True) -> DataFrame:
    if not db.links:
        spark = next(iter(db.frames.values())).sparkSession
        return spark.createDataFrame([], f"edge_type string, src_type string, dst_type string, src_id bigint, dst_id bigint, src_time {'bigint' if at_seconds else 'timestamp'}")
    return union_all([key_edges(db, x, cutoff=cutoff, reverse=r, on_dangling=on_dangling, at_seconds=at_seconds) for x in db.links for r in directions])


def composite_edges(child: DataFrame, child_id: str, columns: list[str], parent: DataFrame, parent_id: str, key: list[str]) -> DataFrame:
    """(src_id, dst_id) by a key of several columns; a null part gives no edge."""
    small_tasks(child.sparkSession)
    own = child.select(F.col(child_id).alias("src_id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    other = parent.select(F.col(parent_id).alias("dst_id"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = reduce(lambda a, b: a & b, [own[f"__c{i}"] == other[f"__k{i}"] for i in range(len(columns))])
    return own.join(other, same).select("src_id", "dst_id")


def counts(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("edge_type", "src_type", "dst_type").agg(F.count("*").alias("n_edges"))


def in_degree(edge_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, degree) of every node in ``ids`` (column node_id), zeros too."""
    d = edge_rows.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("degree"))
    return ids.select(F.col("node_id").cast("bigint").alias("node_id")).join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_rank(edge_rows: DataFrame, block: int = 16 * 86400) -> DataFrame:
    """Edges with the place, from 0, of each source among the neighbours of its destination.

    Edges are ranked within a destination's spans of time; a span begins where the counts of
    the earlier ones end, so a destination that much of a table points to is many tasks' work.
    """
    hub = ["edge_type", "dst_id"]
    own = edge_rows.withColumn("__span", F.call_function("div", F.col("src_time"), F.lit(block)))
    sizes = own.groupBy(*hub, "__span").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*hub).orderBy(F.col("__span").asc_nulls_first())) - F.col("__n")
    first = sizes.select(*[F.col(c).alias(f"__{c}") for c in hub], F.col("__span").alias("__s"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*hub, "__span").orderBy(F.col("src_time").asc_nulls_first(), "src_id"))
    same = (F.col("edge_type") == F.col("__edge_type")) & (F.col("dst_id") == F.col("__dst_id")) & F.col("__span").eqNullSafe(F.col("__s"))
    ranked = own.withColumn("__inside", inside).join(first, same)
    return ranked.select(*edge_rows.columns, (F.col("__before") + F.col("__inside") - 1).cast("bigint").alias("rank"))


def pointers(degrees: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(node_id, start, end): where each node's neighbours stand in one long list ordered by node.

    Sums run inside blocks of ids, and over the few block totals; no window spans all rows.
    """
    rows = degrees.withColumn("__block", F.call_function("div", F.col("node_id"), F.lit(block)))
    totals = rows.groupBy("__block").agg(F.sum("degree").alias("__total"))
    first = totals.select("__block", (F.sum("__total").over(Window.orderBy("__block")) - F.col("__total")).alias("__first"))
    inside = F.sum("degree").over(Window.partitionBy("__block").orderBy("node_id"))
    out = rows.withColumn("__end", inside).join(first, "__block").withColumn("end", F.col("__first") + F.col("__end"))
    return out.select("node_id", (F.col("end") - F.col("degree")).alias("start"), "end")


def visible(edge_rows: DataFrame, seed_time: int) -> DataFrame:
    """Edges whose source is no later than the seed; sources without a time are always visible."""
    return edge_rows.filter(F.col("src_time").isNull() | (F.col("src_time") <= seed_time))


def report(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Counts by node type and edge type."""
    n = node_rows.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n"), F.count("node_time").alias("n_timed")).withColumn("part", F.lit("node"))
    e = edge_rows.groupBy(F.concat_ws("__", "src_type", "edge_type", "dst_type").alias("name")).agg(F.count("*").alias("n"), F.count("src_time").alias("n_timed")).withColumn("part", F.lit("edge"))
    return n.unionByName(e).select("part", "name", "n", "n_timed")

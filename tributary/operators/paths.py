"""Routes between tables and parameter-free propagation along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.schema import Database


def foreign_key_table(db: Database) -> DataFrame:
    """(child, fk, parent) of every foreign key, as a small DataFrame."""
    spark = next(iter(db.frames.values())).sparkSession
    rows = [(x.child, x.name, x.parent) for x in db.links]
    return spark.createDataFrame(rows, "child string, fk string, parent string")


def atomic_routes(keys: DataFrame) -> DataFrame:
    """Tables with one key: a route each way.  Tables with more: a route over the table for each ordered pair of keys."""
    n = keys.groupBy("child").agg(F.count("*").alias("n"))
    k = keys.join(n, "child")
    single = k.filter("n = 1")
    null = F.lit(None).cast("string")
    out = single.select(F.lit("dim-dim").alias("kind"), F.col("child").alias("source"), null.alias("middle"), F.col("parent").alias("destination"), F.col("fk").alias("via_in"), null.alias("via_out"))
    back = single.select(F.lit("dim-dim").alias("kind"), F.col("parent").alias("source"), null.alias("middle"), F.col("child").alias("destination"), F.concat(F.lit("rev_"), "fk").alias("via_in"), null.alias("via_out"))
    a, b = k.filter("n > 1").alias("a"), k.filter("n > 1").alias("b")
    pairs = a.join(b, (F.col("a.child") == F.col("b.child")) & (F.col("a.fk") != F.col("b.fk")))
    over = pairs.select(F.lit("dim-fact-dim").alias("kind"), F.col("a.parent").alias("source"), F.col("a.child").alias("middle"), F.col("b.parent").alias("destination"), F.col("a.fk").alias("via_in"), F.col("b.fk").alias("via_out"))
    return out.unionByName(back).unionByName(over)


def propagate(values: DataFrame, links: DataFrame, value: str = "value", how: str = "mean") -> DataFrame:
    """(node_id, value): mean or sum over the sources of ``links`` (src_id, dst_id) of their values (node_id, value)."""
    combine = {"mean": F.avg, "sum": F.sum}[how]
    own = values.select(F.col("node_id").alias("src_id"), F.col(value).alias("__value"))
    return links.join(own, "src_id").groupBy(F.col("dst_id").alias("node_id")).agg(combine("__value").alias(value))


def metapath(values: DataFrame, path: list[DataFrame], value: str = "value", how: str = "mean") -> DataFrame:
    """Propagation along several steps, one DataFrame of links each."""
    for links in path:
        values = propagate(values, links, value, how)
    return values


def over_fact(source: DataFrame, fact: DataFrame, source_key: str, target_key: str, value: Column | str = "value", how: str = "mean") -> DataFrame:
    """Dim-fact-dim: the source's value reaches each fact row, and the facts' values each destination."""
    rows = fact.select(F.col(source_key).alias("node_id"), F.col(target_key).alias("__target")).join(source, "node_id")
    combine = {"mean": F.avg, "sum": F.sum}[how]
    return rows.groupBy(F.col("__target").alias("node_id")).agg(combine(value).alias("value"), F.count("*").alias("n"))


def combine_routes(parts: list[DataFrame], how: str = "sum") -> DataFrame:
    """Sum or mean of a node's values over routes."""
    out = parts[0].select("node_id", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("node_id", "value"))
    return out.groupBy("node_id").agg({"mean": F.avg, "sum": F.sum}[how]("value").alias("value"))


def vector_mean(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, place by place: (group, pos, value)."""
    return rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))

"""Row identity: dense ids, density, key mappings, dangling keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scalars import instant
from tributary.schema import Database
from tributary.session import cut, small_tasks

NODE_ID = "__node_id__"


class KeyCheckError(ValueError):
    """Ids with gaps, repeats or nulls where none may be."""


def assign_dense_ids(df: DataFrame, order: list[str] | None = None, name: str = NODE_ID) -> DataFrame:
    """``df`` with ids 0..N-1 in the total order of ``order`` (all columns unless given).

    Rows are sorted over ranges and numbered within theirs; the few range sizes are
    summed up and joined back.  Rows equal in every column of the order would make
    the ids depend on the run, and one window over everything would be one task.
    """
    if name in df.columns:
        raise KeyCheckError(f"{name} is reserved")
    order = order or df.columns
    small_tasks(df.sparkSession)
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    first = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))
    return ranged.join(first, "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


def density(df: DataFrame, key: str) -> DataFrame:
    """One row: n, n_null, n_distinct, least and greatest id, and whether they are 0..N-1."""
    k = F.col(key)
    out = df.agg(F.count("*").alias("n"), F.sum(k.isNull().cast("bigint")).alias("n_null"), F.countDistinct(k).alias("n_distinct"), F.min(k).cast("bigint").alias("min_id"), F.max(k).cast("bigint").alias("max_id"))
    dense = (F.col("n") == 0) | ((F.col("n_null") == 0) & (F.col("n_distinct") == F.col("n")) & (F.col("min_id") == 0) & (F.col("max_id") == F.col("n") - 1))
    return out.withColumn("n_null", F.coalesce("n_null", F.lit(0))).withColumn("is_dense", F.coalesce(dense, F.lit(False)))


def require_dense(df: DataFrame, key: str, what: str = "table") -> int:
    """The number of rows, or an error where ids have gaps."""
    row = density(df, key).first()
    if not row["is_dense"]:
        raise KeyCheckError(f"{what}: ids are not 0..{row['n'] - 1} (least {row['min_id']}, greatest {row['max_id']}, {row['n_distinct']} distinct)")
    return row["n"]


def before_cutoff(df: DataFrame, time: str | None, cutoff) -> DataFrame:
    """Rows up to and with the cutoff; rows without a time drop out; tables without a time column stay whole."""
    if time is None or cutoff is None:
        return df
    kind = df.schema[time].dataType.simpleString()
    if kind == "string":  # compared as moments, whatever forms they are written in
        return df.filter(instant(time) <= F.lit(cutoff).cast("timestamp"))
    return df.filter(F.col(time) <= F.lit(cutoff).cast(kind))


def key_mapping(df: DataFrame, key: list[str], name: str = NODE_ID) -> DataFrame:
    """(key columns, dense id) for keys of any type and number of columns."""
    return assign_dense_ids(df.select(*key).distinct(), key, name)


def with_node_ids(db: Database, tables: list[str] | None = None) -> Database:
    """Tables whose id is no single whole number get dense node ids beside it, by the order of their keys.

    Rows without a whole key can't be nodes and drop out; links go on by the columns they name.
    """
    frames, nodes = dict(db.frames), dict(db.nodes)
    for t in db.ids if tables is None else tables:
        key = db.ids[t]
        whole = len(key) == 1 and db[t].schema[key[0]].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
        if not whole and t not in nodes:
            frames[t] = db[t].join(key_mapping(db[t].dropna(subset=list(key)), list(key)), list(key))
            nodes[t] = NODE_ID
    return Database(frames, db.keys, nodes)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    test: Column = F.lit(False)
    for k in key:
        test |= F.col(k).isNull()
    return df.filter(test)


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is set and not in ``parent``."""
    small_tasks(child.sparkSession)
    known = parent.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)])
    same, given = F.lit(True), F.lit(True)
    for i, c in enumerate(columns):
        same &= child[c] == known[f"__{i}"]
        given &= child[c].isNotNull()
    return child.filter(given).join(known, same, "left_anti")


def resolve_dangling(child: DataFrame, column: str, parent: DataFrame, key: str, on_dangling: str = "drop") -> DataFrame:
    """Rows with a key that has no parent: dropped, kept with a null key, or an error.  Null keys stay as they are for ``null``."""
    small_tasks(child.sparkSession)
    if on_dangling == "error":
        if bad := orphans(child, [column], parent, [key]).limit(1).count():
            raise KeyCheckError(f"{column}: {bad} or more rows without a parent")
        return child
    known = parent.select(F.col(key).alias("__key"))
    if on_dangling == "drop":
        return child.join(known, child[column] == known["__key"], "left_semi")
    if on_dangling != "null":
        raise ValueError("on_dangling is drop, null or error")
    known = known.distinct()
    return child.join(known, child[column] == known["__key"], "left").withColumn(column, F.col("__key").cast(child.schema[column].dataType)).drop("__key")

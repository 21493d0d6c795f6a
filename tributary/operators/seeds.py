"""Seed batches: every train row once an epoch, shuffled by blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scalars import binary_label, order_key


def epoch_order(rows: DataFrame, key: str, *, epoch: int, batch_size: int, block_rows: int = 4096, seed: int = 42, max_batches: int | None = None) -> DataFrame:
    """(epoch, batch, pos, key): blocks of ids in an order by hash, rows by hash inside their block.

    Batches do not straddle blocks, so a batch's number is the batches of earlier
    blocks, summed over the small table of blocks, plus its own place in the block.
    """
    own = rows.select(F.col(key).alias("key"), F.call_function("div", F.col(key).cast("bigint"), F.lit(block_rows)).alias("block"))
    sizes = own.groupBy("block").agg(F.count("*").alias("n")).withColumn("batches", F.ceil(F.col("n") / F.lit(float(batch_size))).cast("bigint"))
    shuffled = Window.orderBy(order_key(seed, epoch, "block"), "block")
    first = sizes.select("block", (F.sum("batches").over(shuffled) - F.col("batches")).alias("first"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(order_key(seed, epoch, "key"), "key")) - 1
    out = own.withColumn("place", place.cast("bigint")).join(first, "block")
    out = out.select(F.lit(epoch).cast("bigint").alias("epoch"), (F.col("first") + F.call_function("div", F.col("place"), F.lit(batch_size))).alias("batch"), (F.col("place") % batch_size).alias("pos"), "key")
    return out if max_batches is None else out.filter(F.col("batch") < max_batches)


def epochs(rows: DataFrame, key: str, n: int, **how) -> DataFrame:
    out = epoch_order(rows, key, epoch=0, **how)
    for e in range(1, n):
        out = out.unionByName(epoch_order(rows, key, epoch=e, **how))
    return out


def coverage(order: DataFrame) -> DataFrame:
    """(epoch, n_rows, n_distinct, n_batches, largest): each row once means n_rows equals n_distinct."""
    sizes = order.groupBy("epoch", "batch").agg(F.count("*").alias("n"))
    return order.groupBy("epoch").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_distinct"), F.countDistinct("batch").alias("n_batches")).join(sizes.groupBy("epoch").agg(F.max("n").alias("largest")), "epoch")


def target_value(df: DataFrame, label: str, task_type: str) -> DataFrame:
    """``df`` with the label in the type its task trains on; rows without one keep null, and lists of destinations stay."""
    if task_type == "recommendation":
        return df
    c = {"binary_classification": binary_label(label), "multiclass_classification": F.col(label).cast("bigint"), "multilabel_classification": F.col(label).cast("array<float>")}.get(task_type, F.col(label).cast("double"))
    return df.withColumn(label, F.when(F.col(label).isNotNull(), c))


def class_count(rows: DataFrame, label: str) -> int:
    """Greatest label plus one: of the elements where labels are lists, 0 where there are none."""
    x = F.array_max(label) if rows.schema[label].dataType.simpleString().startswith("array") else F.col(label)
    most = rows.agg(F.max(x).cast("bigint")).first()[0]
    return 0 if most is None else most + 1

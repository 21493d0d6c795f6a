"""Task splits: by a column, by queries, or by default (latest rows, or a seeded hash)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.scalars import order_key
from tributary.operators.checks import safe_select
from tributary.operators.keys import null_keys
from tributary.session import sql_over

TRAIN, VALIDATION, TEST = "train", "validation", "test"


class SplitError(ValueError):
    pass


def column_split(rows: DataFrame, column: str, values: Mapping[str, object]) -> DataFrame:
    """``rows`` with ``split`` by a column whose values are mapped; other values raise when read."""
    if len(set(map(str, values.values()))) != len(values) or any(isinstance(v, bool) for v in values.values()):
        raise SplitError("split values must differ and be text or integers")
    chain = None
    for name, v in values.items():
        test = F.col(column) == F.lit(v)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    bad = F.raise_error(F.concat(F.lit("split value not mapped: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return rows.withColumn("split", chain.otherwise(bad.cast("string")))


def _wanted(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil(n * F.lit(fraction)).cast("bigint"), n - 1))


def time_split(rows: DataFrame, time: str, *, label: str | None = None, fraction: float = 0.2, key: str | None = None) -> DataFrame:
    """Rows without a label are test; of the others, the latest fraction is validation, ties with its first row included.

    The first validation time is read off counts by time, so nothing is sorted as a whole.
    """
    labelled = F.lit(True) if label is None else F.col(label).isNotNull()
    counts = rows.filter(labelled).groupBy(F.col(time).alias("__t")).agg(F.count("*").alias("n")).withColumn("day", F.date_trunc("day", F.col("__t").cast("timestamp")))
    total = counts.agg(F.sum("n")).scalar()
    days = counts.groupBy("day").agg(F.sum("n").alias("m"))
    later = days.select("day", (F.sum("m").over(Window.orderBy(F.desc("day"))) - F.col("m")).alias("after"))
    from_end = F.sum("n").over(Window.partitionBy("day").orderBy(F.desc("__t")))
    reach = counts.withColumn("upto", from_end).join(later, "day")
    edge = reach.filter(F.col("after") + F.col("upto") >= _wanted(total, fraction)).agg(F.max("__t")).scalar()
    split = F.when(~labelled, TEST).when(F.col(time) >= edge, VALIDATION).otherwise(TRAIN)
    return rows.withColumn("split", split)


def hash_split(rows: DataFrame, key: list[str], *, label: str | None = None, fraction: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Rows without a label are test; of the others, the first fraction in an order by hash is validation.

    Ranks come from counts by the first characters of the hash; rows are only ranked
    within one of those.  Rows without a label are never ranked.
    """
    own = rows if label is None else rows.filter(F.col(label).isNotNull())
    own = own.withColumn("__h", order if order is not None else order_key(seed, *key)).withColumn("__b", F.substring("__h", 1, 4))
    counts = own.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__b").alias("__k"), (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    total = counts.agg(F.sum("__n")).scalar()
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key))
    ranked = own.withColumn("__i", inside).join(before, F.col("__b") == F.col("__k"))
    split = F.when(F.col("__before") + F.col("__i") <= _wanted(total, fraction), VALIDATION).otherwise(TRAIN)
    out = ranked.withColumn("split", split).select(*rows.columns, "split")
    return out if label is None else out.unionByName(rows.filter(F.col(label).isNull()).withColumn("split", F.lit(TEST)))


def default_split(rows: DataFrame, key: list[str], *, time: str | None = None, label: str | None = None, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """By time where there is one, by hash otherwise.  Needs two labelled rows, and two times."""
    labelled = rows if label is None else rows.filter(F.col(label).isNotNull())
    if labelled.limit(2).count() < 2:
        raise SplitError("a default split needs two labelled rows")
    if time is None:
        return hash_split(rows, key, label=label, fraction=fraction, seed=seed)
    if labelled.select(time).distinct().limit(2).count() < 2:
        raise SplitError("all labelled rows share one time")
    return time_split(rows, time, label=label, fraction=fraction)


def query_keys(spark: SparkSession, frames: Mapping[str, DataFrame], query: str, key: list[str]) -> DataFrame:
    """Keys that one SELECT over ``frames`` gives, with exactly the key's columns; null or repeated keys raise."""
    found = sql_over(spark, frames, safe_select(query))
    if sorted(found.columns) != sorted(key):
        raise SplitError(f"a split query must give the columns {key}, not {found.columns}")
    bad = found.groupBy(*key).count().filter("count > 1").limit(1).count()
    null = null_keys(found, key).limit(1).count()
    if bad or null:
        raise SplitError("a split query gives a key twice or a null key")
    return found.select(*key)


def query_split(rows: DataFrame, key: list[str], queries: Mapping[str, DataFrame], *, label: str | None = None, time: str | None = None, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Splits by membership in the keys of queries: all three, or the test keys alone with the rest split by default."""
    if set(queries) == {TEST}:
        test = rows.join(queries[TEST], key, "left_semi").withColumn("split", F.lit(TEST))
        rest = rows.join(queries[TEST], key, "left_anti")
        if label is not None and rest.filter(F.col(label).isNull()).limit(1).count():
            raise SplitError("rows without a label outside the test keys")
        return test.unionByName(default_split(rest, key, time=time, label=label, fraction=fraction, seed=seed).select(*rows.columns, "split"))
    if set(queries) != {TRAIN, VALIDATION, TEST}:
        raise SplitError("give all three queries, or the test query alone")
    problems = overlap_report(rows, key, queries).filter("n > 0 AND problem <> 'ok'").limit(1).collect()
    if problems:
        raise SplitError(f"{problems[0]['problem']}: {problems[0]['n']} keys")
    named = None
    for name, keys in queries.items():
        part = keys.withColumn("split", F.lit(name))
        named = part if named is None else named.unionByName(part)
    return rows.join(named, key)


def overlap_report(rows: DataFrame, key: list[str], queries: Mapping[str, DataFrame]) -> DataFrame:
    """(problem, n): keys in one split (ok), in several, of no row, and rows in no split; zeros included."""
    named = None
    for name, keys in queries.items():
        part = keys.select(*key).withColumn("split", F.lit(name))
        named = part if named is None else named.unionByName(part)
    per = named.groupBy(*key).agg(F.countDistinct("split").alias("splits"))
    whole = rows.select(*key).distinct().withColumn("__row", F.lit(True)).join(per, key, "full_outer")
    problem = F.when(F.col("__row").isNull(), "unknown").when(F.col("splits").isNull(), "uncovered").when(F.col("splits") > 1, "overlap").otherwise("ok")
    found = whole.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(x,) for x in ("ok", "overlap", "uncovered", "unknown")], "problem string")
    return names.join(found, "problem", "left").select("problem", F.coalesce("n", F.lit(0)).alias("n"))

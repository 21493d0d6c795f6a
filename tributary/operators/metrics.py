"""Reports over run logs and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.stats import values_at


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the element at round((n - 1) q), halves to even.

    Ranks are found by counts (``values_at``), so no group is gathered or sorted whole.
    """
    found = values_at(df, by, value, {name: (q, lambda n, q=q: F.bround((n - 1) * F.lit(q), 0)) for name, q in shares.items()})
    return found.filter("n > 0").select(*by, *shares)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def phases(df: DataFrame, method: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """A row for each method, a column with the total of each stage."""
    return df.groupBy(method).pivot(stage, stages).agg(F.sum(value))


def geometric_mean(df: DataFrame, numerator: str, denominator: str) -> DataFrame:
    ratio = F.col(numerator) / F.col(denominator)
    return df.filter((F.col(numerator) > 0) & (F.col(denominator) > 0)).agg(F.exp(F.avg(F.log(ratio))).alias("geomean"), F.count("*").alias("n"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def paired_runs(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both values of each run, and which side is missing."""
    a, b = left.select(*key, F.col(value).alias("left")), right.select(*key, F.col(value).alias("right"))
    state = F.when(F.col("left").isNull(), "missing left").when(F.col("right").isNull(), "missing right").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("state", state)


def heat(stats: DataFrame, requests: str = "requests", hits: str = "hits", indexed: str = "indexed_rows", warm_rows: int = 100_000) -> DataFrame:
    """The kind of a table's traffic, by the share of requests that met a row asked for before and by how many rows are known."""
    rate = F.col(hits) / F.greatest(F.col(requests), F.lit(1))
    small = F.col(indexed) <= warm_rows
    kind = F.when((rate >= 0.2) & small, "dimension-hot").when(rate >= 0.05, "mixed-hot").when(F.col(indexed) >= warm_rows, "streaming").otherwise("warming")
    return stats.withColumn("heat", kind)


def gaps(df: DataFrame, order: str, finish: str) -> DataFrame:
    """Time from the end of the row before to the end of each row."""
    before = F.lag(finish).over(Window.orderBy(order))
    return df.withColumn("elapsed", F.col(finish) - before)


def draw(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of at most k rows, the same whenever drawn."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def pages(df: DataFrame, key: str, anchors: list[int], size: int) -> DataFrame:
    """The first ``size`` rows from each anchor on, by key, repeats left out."""
    parts = [df.filter(F.col(key) >= a).orderBy(key).limit(size) for a in anchors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])


def share(df: DataFrame, key: str, modulus: int, *columns: str) -> DataFrame:
    """Every ``modulus``-th key whose ``columns`` are set: a cheap sample for profiling."""
    out = df.filter(F.pmod(F.col(key), F.lit(modulus)) == 0)
    for c in columns:
        out = out.filter(F.col(c).isNotNull())
    return out


def observed(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, object]:
    """``df`` and an observation of it: counts and measures that come with the first action, without a pass of their own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *measures), seen

"""Exact column statistics and vocabularies, one scan a table where it can be."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tributary.functions.scalars import number
from tributary.operators.keys import assign_dense_ids
from tributary.operators.ranks import Place, values_by_rank
from tributary.session import cut

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Vocabularies of up to so many values, all columns together, are numbered at once; larger ones over ranges.
FEW_VALUES = 10_000


#: Ranks are looked for between approximate quantiles this far on either side; each of those is
#: off by a fifth of it at most, and groups of fewer than ``FEW`` values are looked through whole.
_REACH, _ACCURACY, FEW = 2.5e-3, 2_000, 10_000


def values_at(df: DataFrame, by: list[str], value: str, places: dict[str, tuple[float, Callable[[Column], Column]]], extra: list[Column] | None = None) -> DataFrame:
    """(by, n, a column for each place, ``extra`` aggregates): exactly the elements of given ranks among the values of each group.

    A place is a share and the rank (from 0, of the group's n values) near that share.
    A first aggregation brackets each rank by approximate quantiles; a second counts how many values lie
    below each bracket, and the values inside, half a hundredth of the rows.  No group is sorted or held whole.
    """
    shares = sorted({q for q, _ in places.values()})
    ends = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-_REACH, _REACH)]
    first = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("__min"), F.max(value).alias("__max"), F.percentile_approx(value, ends, _ACCURACY).alias("__p"), *(extra or []))
    few = F.col("n") < FEW
    low = [F.when(few, F.col("__min")).otherwise(F.get("__p", F.lit(2 * i))).alias(f"__low{i}") for i in range(len(shares))]
    high = [F.when(few, F.col("__max")).otherwise(F.get("__p", F.lit(2 * i + 1))).alias(f"__high{i}") for i in range(len(shares))]
    first = cut(first.select("*", *low, *high).drop("__p"))
    ends = [f"__{e}{i}" for i in range(len(shares)) for e in ("low", "high")]

    def alike(left: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [left[c].eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.lit(True))

    keys = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "n", *ends)
    rows = df.filter(F.col(value).isNotNull()).join(keys, alike(df)).select(*by, "n", F.col(value).alias("v"), *ends)
    within = [F.col("v").between(F.col(f"__low{i}"), F.col(f"__high{i}")) for i in range(len(shares))]
    inside = F.when(reduce(lambda x, y: x | y, within), F.col("v"))
    below = [F.count(F.when(F.col("v") < F.col(f"__low{i}"), 1)).alias(f"__below{i}") for i in range(len(shares))]
    counted = rows.groupBy(*by, "n", *ends, inside.alias("v")).agg(F.count("*").alias("m"), *below)
    whole = Window.partitionBy(*by)
    for i, inner in enumerate(within):
        upto = F.sum(F.when(inner, F.col("m"))).over(whole.orderBy(F.col("v").asc_nulls_first()))
        counted = counted.withColumn(f"__upto{i}", F.when(inner, upto + F.sum(f"__below{i}").over(whole)))
    picked = [F.min(F.when(F.col(f"__upto{shares.index(q)}") > rank(F.col("n")), F.col("v"))).alias(name) for name, (q, rank) in places.items()]
    found = counted.groupBy(*by).agg(*picked)
    named = found.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *places)
    return first.drop("__min", "__max", *ends).join(named, alike(first), "left").drop(*[f"__k{i}" for i in range(len(by))])


def _linear(q: float) -> list[Place]:
    """The two elements that a quantile lies between."""
    name = f"{100 * q:.0f}"
    return [(f"low{name}", q, lambda n: math.floor((n - 1) * q)), (f"high{name}", q, lambda n: math.ceil((n - 1) * q))]


_QUARTILES = [p for q in QUANTILES[1:-1] for p in _linear(q)]
_MEDIAN: list[Place] = [("median", 0.5, lambda n: n // 2)]


def _quantile(found: dict, q: float) -> float | None:
    low, high = found[f"low{100 * q:.0f}"], found[f"high{100 * q:.0f}"]
    if low is None or low == high:
        return low
    rest = (found["n"] - 1) * q - math.floor((found["n"] - 1) * q)
    return (1 - rest) * low + rest * high


@dataclass(frozen=True)
class TableStatistics:
    """What encoders need to know of a table's columns; all rows but those of vocabularies are in memory."""

    types: Mapping[str, str]
    numbers: Mapping[str, Mapping[str, float | int | None]]
    times: Mapping[str, Mapping[str, int | None]]
    texts: Mapping[str, int]
    words: DataFrame | None  # (column, value, n, idx)

    def vocabulary(self, column: str) -> DataFrame:
        return self.words.filter(F.col("column") == column)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(column, kind, name, value, number, n): every statistic as a row."""
        rows = [(c, "numerical", name, None, None if v is None else float(v), s["n"]) for c, s in self.numbers.items() for name, v in s.items() if name != "n"]
        rows += [(c, "timestamp", name, None, None if v is None else float(v), s["n"]) for c, s in self.times.items() for name, v in s.items() if name != "n"]
        rows += [(c, "text_embedded", "filled", None, None, n) for c, n in self.texts.items()]
        out = spark.createDataFrame(rows, "column string, kind string, name string, value string, number double, n bigint")
        if self.words is None:
            return out
        kinds = F.create_map(*[F.lit(x) for c, k in self.types.items() for x in (c, k)])
        return out.unionByName(self.words.select("column", kinds[F.col("column")].alias("kind"), F.lit("value").alias("name"), "value", F.col("idx").cast("double").alias("number"), "n"))


def statistics(df: DataFrame, types: Mapping[str, str], *, separator: str | None = None) -> TableStatistics:
    """Statistics of all columns by semantic type: one scan of the table, a second near the ranks
    that quantiles and medians stand at, and one for all its vocabularies.

    numerical: n, mean and deviation (of the population) of finite values, exact interpolated quantiles.
    timestamp: n, first and last year, oldest, newest and the element of rank n div 2, in microseconds.
    categorical, multicategorical: counts of values (of elements of arrays, or of texts cut at
    ``separator``), numbered by falling count.  text_embedded: how many are there.
    """
    of = lambda kind: [c for c, k in types.items() if k == kind]
    numbers, times, texts = of("numerical"), of("timestamp"), of("text_embedded")
    columns = {c: number(c) for c in numbers} | {c: F.unix_micros(F.col(c).cast("timestamp")) for c in times}
    places = dict.fromkeys(numbers, _QUARTILES) | dict.fromkeys(times, _MEDIAN)
    extra = {f"{k}{i}": f(f"__v{i}") for i in range(len(numbers)) for k, f in (("mean", F.avg), ("std", F.stddev_pop))}
    extra |= {f"text{i}": F.count(c) for i, c in enumerate(texts)}
    found, row = values_by_rank(df.select(*types), columns, places, extra) if columns or texts else ({}, None)
    out_numbers = {}
    for i, c in enumerate(numbers):
        f = found[c]
        middle = {f"q{100 * q:.0f}": _quantile(f, q) for q in QUANTILES[1:-1]}
        out_numbers[c] = {"n": f["n"], "mean": row[f"mean{i}"], "std": row[f"std{i}"], "q0": f["min"], **middle, "q100": f["max"]}
    out_times = {c: {"n": found[c]["n"], "oldest": found[c]["min"], "median": found[c]["median"], "newest": found[c]["max"]} for c in times}
    listed = [c for c, k in types.items() if k in ("categorical", "multicategorical")]
    words = vocabularies(df, {c: types[c] == "multicategorical" for c in listed}, separator) if listed else None
    return TableStatistics(dict(types), out_numbers, out_times, {c: row[f"text{i}"] for i, c in enumerate(texts)}, words)


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, q0, q25, q50, q75, q100) of the finite values of each column, all columns together.

    The deviation is of the population, quantiles are exact and interpolated; a column
    without values has n 0 and nulls.
    """
    names = ["n", "mean", "std", *[f"q{100 * q:.0f}" for q in QUANTILES]]
    found = statistics(df, dict.fromkeys(columns, "numerical")).numbers
    kinds = "column string, n bigint, " + ", ".join(f"{n} double" for n in names[1:])
    return df.sparkSession.createDataFrame([(c, *[found[c][n] for n in names]) for c in columns], kinds)


def vocabularies(df: DataFrame, columns: Mapping[str, bool], separator: str | None = None) -> DataFrame:
    """(column, value, n, idx) for several columns, each read once; ``columns`` says of each whether it holds many values a row."""
    items = {c: F.explode(F.split(F.col(c), separator) if separator else F.col(c)) if many else F.col(c) for c, many in columns.items()}
    values = [df.select(F.lit(c).alias("column"), x.alias("value")).select("column", F.col("value").cast("string").alias("value")) for c, x in items.items()]
    counts = reduce(DataFrame.unionByName, values).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.limit(FEW_VALUES + 1).toArrow()
    if few.num_rows <= FEW_VALUES:
        rows = sorted(few.to_pylist(), key=lambda r: (r["column"], -r["n"], r["value"]))
        out = [(r["column"], r["value"], r["n"], i) for _, group in groupby(rows, key=itemgetter("column")) for i, r in enumerate(group)]
        return df.sparkSession.createDataFrame(out, "column string, value string, n bigint, idx bigint")
    counts = cut(counts)  # many: numbered over ranges, column by column
    parts = [_numbered(counts.filter(F.col("column") == c)) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def _numbered(counts: DataFrame) -> DataFrame:
    ranked = assign_dense_ids(counts.withColumn("__less", -F.col("n")), ["__less", "value"], "idx")
    return ranked.select("column", "value", "n", F.col("idx").cast("bigint").alias("idx"))


def vocabulary(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(column, value, n, idx) of the values that are not null, by falling count, then by value."""
    return vocabularies(df, {column: False}).withColumn("column", F.lit(name or column))


def element_vocabulary(df: DataFrame, column: str, separator: str | None = None) -> DataFrame:
    """As ``vocabulary``, over the elements of arrays, or of text split at ``separator``."""
    return vocabularies(df, {column: True}, separator)


def time_stats(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(column, n, min_year, max_year, oldest, median, newest): the median is the element of rank n div 2 from 0.

    An empty column has n 0 and years -1.
    """
    found = statistics(df, {column: "timestamp"}).times[column]
    out = df.sparkSession.createDataFrame([(name or column, *[found[k] for k in ("n", "oldest", "median", "newest")])], "column string, n bigint, oldest bigint, median bigint, newest bigint")
    at = {k: F.timestamp_micros(k).cast("timestamp_ntz") for k in ("oldest", "median", "newest")}
    year = {k: F.coalesce(F.year(at[t]), F.lit(-1)) for k, t in (("min_year", "oldest"), ("max_year", "newest"))}
    return out.select("column", "n", *[c.alias(k) for k, c in {**year, **at}.items()])


def table_stats(df: DataFrame, name: str, time: str | None = None, cutoff=None) -> DataFrame:
    """(table, n_rows, n_cutoff, n_columns, n_text, min_time, max_time), from one scan."""
    text = sum(f.dataType.simpleString() == "string" for f in df.schema.fields)
    if time:
        t = F.col(time)
        kept = F.sum((t <= F.lit(cutoff).cast(df.schema[time].dataType)).cast("bigint")) if cutoff else F.count("*")
        span = [F.min(t).cast("timestamp_ntz").alias("min_time"), F.max(t).cast("timestamp_ntz").alias("max_time")]
    else:
        kept, span = F.count("*"), [F.lit(None).cast("timestamp_ntz").alias("min_time"), F.lit(None).cast("timestamp_ntz").alias("max_time")]
    out = df.agg(F.count("*").alias("n_rows"), F.coalesce(kept, F.lit(0)).cast("bigint").alias("n_cutoff"), *span)
    return out.select(F.lit(name).alias("table"), "n_rows", "n_cutoff", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.lit(text).cast("bigint").alias("n_text"), "min_time", "max_time")


def fill_counts(df: DataFrame, name: str) -> DataFrame:
    """(table, column, n_set) for every column, from one scan."""
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_set")) for c in df.columns])
    return wide.select(F.explode(rows).alias("r")).select(F.lit(name).alias("table"), "r.*")


def infer_types(df: DataFrame, *, key: str, rows: int = 1000, seed: int = 42, text_words: float = 3.0) -> dict[str, str]:
    """A semantic type for each column, from at most ``rows`` rows drawn by hash of the key; binary values, maps and structs are of none."""
    sample = df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(rows)
    out: dict[str, str] = {}
    parts, asked = [], []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("timestamp") or kind == "date":
            out[f.name] = "timestamp"
        elif kind.startswith("array"):
            out[f.name] = "multicategorical"
        elif kind == "boolean":
            out[f.name] = "categorical"
        elif kind == "string":
            asked.append(f.name)
            parts += [F.countDistinct(f.name).alias(f"{f.name}__d"), F.count(f.name).alias(f"{f.name}__n"), F.avg(F.size(F.split(f.name, r"\s+"))).alias(f"{f.name}__w")]
        else:
            out[f.name] = "numerical" if isinstance(f.dataType, NumericType) else "other"
    if asked:
        r = sample.agg(*parts).first()
        for c in asked:
            few = r[f"{c}__d"] <= max(20, 0.2 * (r[f"{c}__n"] or 0))
            out[c] = "categorical" if few and (r[f"{c}__w"] or 0) <= text_words else "text_embedded"
    return {f.name: out[f.name] for f in df.schema.fields}


def stats_fingerprint(stats: DataFrame) -> DataFrame:
    """One row: the SHA-256 of all rows as JSON in order, and their number.  Statistics are a few rows a column."""
    rows = stats.select(F.to_json(F.struct(*sorted(stats.columns))).alias("j"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("j"))), 256).alias("fingerprint"), F.count("*").alias("n"))


def artifact_key(payload: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()

"""Exact elements by rank of many columns, without sorting any of them.

A first aggregation counts; quantiles of a sample of rows then bracket every asked
rank.  The next scan counts how many values lie between the brackets, and lists the
distinct values inside, about a hundredth of the rows, with their counts: running
sums of these are exact ranks.  Each column is read once a scan, rows are never
multiplied by columns, and what reaches the driver is a few numbers a column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Rows of the sample, about.  Its quantiles are off by less than ``REACH`` of the rows but once in a
#: thousand times; a bracket that missed its rank is widened.
SAMPLE, REACH, ACCURACY = 100_000, 6e-3, 2_000
#: Columns of fewer values are looked through whole; where brackets hold more values, they are narrowed first.
FEW, MOST_INSIDE = 100_000, 1 << 22

#: A name, a share of the values, and the rank (from 0) near that share, of n values.
Place = tuple[str, float, Callable[[int], int]]


@dataclass
class _Bracket:
    """Values of column ``c`` from ``low`` to ``high``, and the ranks looked for among them."""

    c: int
    low: object
    high: object
    ranks: dict[str, int]


def values_by_rank(df: DataFrame, columns: Mapping[str, Column], places: Mapping[str, list[Place]], extra: Mapping[str, Column] | None = None) -> tuple[dict[str, dict[str, object]], Row]:
    """(for each column its ``n``, ``min``, ``max`` and the element of each place, the row of the ``extra`` aggregations).

    Columns are numbers without NaN, or null; aggregations in ``extra`` may use the columns of ``df``.
    """
    names = list(columns)
    wide = df.select("*", *[columns[c].alias(f"__v{i}") for i, c in enumerate(names)])
    value = [F.col(f"__v{i}") for i in range(len(names))]
    first = [f(v).alias(f"{k}{i}") for i, v in enumerate(value) for k, f in (("n", F.count), ("min", F.min), ("max", F.max))]
    row = wide.agg(*first, *[a.alias(k) for k, a in (extra or {}).items()]).first()
    out = {c: {"n": row[f"n{i}"], "min": row[f"min{i}"], "max": row[f"max{i}"]} | {name: None for name, _, _ in places[c]} for i, c in enumerate(names)}
    asked = [i for i, c in enumerate(names) if row[f"n{i}"] and places[c]]
    brackets = [_Bracket(i, row[f"min{i}"], row[f"max{i}"], {name: rank(row[f"n{i}"]) for name, _, rank in places[names[i]]}) for i in asked if row[f"n{i}"] < FEW]
    if many := [i for i in asked if row[f"n{i}"] >= FEW]:
        share = min(1.0, SAMPLE / min(row[f"n{i}"] for i in many))
        ends = {i: [min(max(q + d, 0.0), 1.0) for _, q, _ in places[names[i]] for d in (-REACH, REACH)] for i in many}
        near = wide.select(*[value[i] for i in many]).sample(share, 1).agg(*[F.percentile_approx(value[i], ends[i], ACCURACY).alias(f"p{i}") for i in many]).first()
        for i in many:
            found = near[f"p{i}"] or [row[f"min{i}"], row[f"max{i}"]] * len(places[names[i]])
            merged: dict[tuple, _Bracket] = {}
            for k, (name, _, rank) in enumerate(places[names[i]]):
                between = (found[2 * k], found[2 * k + 1])
                merged.setdefault(between, _Bracket(i, *between, {})).ranks[name] = rank(row[f"n{i}"])
            brackets += merged.values()
    brackets = _apart(brackets)
    if any(row[f"n{b.c}"] * 4 * REACH > MOST_INSIDE for b in brackets):
        brackets = _narrowed(wide, brackets)
    while missed := _look_up(wide, brackets, found := {}):
        brackets = _apart([_Bracket(b.c, row[f"min{b.c}"], row[f"max{b.c}"], b.ranks) if b.c in missed else b for b in brackets])
    for (i, name), x in found.items():
        out[names[i]][name] = x
    return out, row


def _narrowed(wide: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Brackets around the same ranks of which none holds more than MOST_INSIDE different places, if that can be."""
    while True:
        tests = [(F.col(f"__v{b.c}") < F.lit(b.low), F.col(f"__v{b.c}").between(F.lit(b.low), F.lit(b.high))) for b in brackets]
        row = wide.agg(*[F.count_if(t).alias(f"{k}{i}") for i, both in enumerate(tests) for k, t in zip(("below", "inside"), both, strict=True)]).first()
        large = [i for i, b in enumerate(brackets) if row[f"inside{i}"] > MOST_INSIDE and b.low != b.high]
        if not large:
            return brackets
        asked, rest = [], [b for i, b in enumerate(brackets) if i not in large]
        for i in large:
            b, below, inside = brackets[i], row[f"below{i}"], row[f"inside{i}"]
            near = [min(max((rank - below) / inside + d, 0.0), 1.0) for rank in b.ranks.values() for d in (-REACH, REACH)]
            asked.append(F.percentile_approx(F.when(tests[i][1], F.col(f"__v{b.c}")), near, ACCURACY).alias(str(i)))
        ends = wide.agg(*asked).first()
        for i in large:
            b, e = brackets[i], ends[str(i)]
            rest += [_Bracket(b.c, e[2 * k], e[2 * k + 1], {name: rank}) for k, (name, rank) in enumerate(b.ranks.items())]
        rest = _apart(rest)
        if {(b.c, b.low, b.high) for b in rest} == {(b.c, b.low, b.high) for b in brackets}:
            return brackets  # a few values, many times each
        brackets = rest


def _apart(brackets: list[_Bracket]) -> list[_Bracket]:
    """Overlapping brackets of a column as one, so that a value is in one bracket at most."""
    out: list[_Bracket] = []
    for b in sorted(brackets, key=lambda b: (b.c, b.low)):
        last = out[-1] if out else None
        if last and last.c == b.c and b.low <= last.high:
            out[-1] = _Bracket(b.c, last.low, max(last.high, b.high), last.ranks | b.ranks)
        else:
            out.append(b)
    return out


def _look_up(wide: DataFrame, brackets: list[_Bracket], found: dict[tuple[int, str], object]) -> set[int]:
    """Put the element of each rank into ``found``; the columns of which a bracket missed a rank are given back.

    Values inside a bracket are counted one by one, those between brackets by their place:
    0 below the first bracket, 1 in it, 2 above it, and so on.
    """
    missed = set()
    for is_float in (True, False):
        own = [b for b in brackets if isinstance(b.low, float) == is_float]
        if not own:
            continue
        listed = []
        for c in sorted({b.c for b in own}):
            x, place = F.col(f"__v{c}"), F
            mine = [b for b in own if b.c == c]
            for k, b in enumerate(mine):
                place = place.when(x < F.lit(b.low), 2 * k).when(x <= F.lit(b.high), 2 * k + 1)
            rows = wide.filter(x.isNotNull()).select(F.lit(c).alias("c"), place.otherwise(2 * len(mine)).alias("place"), x.alias("x"))
            listed.append(rows.withColumn("x", F.when(F.col("place") % 2 == 1, F.col("x"))))
        counts = reduce(DataFrame.unionByName, listed).groupBy("c", "place", "x").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("c").orderBy("place", "x"))
        wanted = F.lit(False)
        for b in own:
            for rank in set(b.ranks.values()):
                wanted |= (F.col("c") == b.c) & (F.col("upto") > rank) & (F.col("upto") - F.col("m") <= rank)
        for hit in counts.withColumn("upto", upto).filter(wanted).collect():
            if hit["place"] % 2 == 0:
                missed.add(hit["c"])
            found |= {(b.c, name): hit["x"] for b in own if b.c == hit["c"] for name, rank in b.ranks.items() if hit["upto"] - hit["m"] <= rank < hit["upto"]}
    return missed

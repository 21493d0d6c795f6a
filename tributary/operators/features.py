"""Gathering and encoding features of requested rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.scalars import number, text_value, time_parts


class MissingRowError(KeyError):
    pass


#: Blocks of ids that are looked at one by one, and ranges that a scan is told at most.
MOST_BLOCKS, MOST_RANGES = 100_000, 64


def id_ranges(ids: DataFrame, key: str, *, block_rows: int = 4096) -> list[tuple[int, int]] | None:
    """Ranges of ids (ends included) that hold all of ``ids``: the blocks they fall in, neighbours joined.

    Where there are more ranges than a scan should be told, those with the least gaps between
    them are joined; ids in very many blocks have no ranges that would help (None).
    """
    blocks = ids.select(F.call_function("div", F.col(key).cast("bigint"), F.lit(block_rows)).alias("b")).filter("b IS NOT NULL").distinct()
    found = sorted(blocks.limit(MOST_BLOCKS + 1).toArrow()["b"].to_pylist())
    if len(found) > MOST_BLOCKS:
        return None
    gaps = sorted((b - a for a, b in zip(found, found[1:], strict=False) if b > a + 1), reverse=True)
    least = gaps[MOST_RANGES - 1] if len(gaps) >= MOST_RANGES else 1
    out: list[tuple[int, int]] = []
    for b in found:
        if out and b - out[-1][1] <= least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return [(a * block_rows, b * block_rows + block_rows - 1) for a, b in out]


def within(table: DataFrame, key: str, ranges: list[tuple[int, int]] | None) -> DataFrame:
    """Rows with ids in the ranges: comparisons that reach the scan, and skip row groups of a table sorted by id."""
    if ranges is None:
        return table
    test = F.lit(False)
    for low, high in ranges:
        test |= F.col(key).between(low, high)
    return table.filter(test)


def gather(requests: DataFrame, table: DataFrame, key: str, *, request_key: str = "node_id", columns: list[str] | None = None, strict: bool = False, block_rows: int | None = None) -> DataFrame:
    """Features of requested ids, with repeats, beside the request's columns (its ``pos`` restores the order).

    The ids are made distinct before the table is read through a semi-join, so a hot id
    meets the wide row once; ``strict`` raises for ids that the table does not have.  With
    ``block_rows`` the scan is told the ranges of ids it needs, at the cost of a look at the
    requests first: for tables sorted by id and requests that are dense in a part of them.
    """
    columns = columns or [c for c in table.columns if c != key]
    wanted = requests.select(F.col(request_key).alias("__id")).distinct()
    if block_rows:
        table = within(table, key, id_ranges(requests, request_key, block_rows=block_rows))
    rows = table.select(F.col(key).alias("__id"), *columns).join(wanted, "__id", "left_semi")
    if strict:
        missing = [r[0] for r in wanted.join(rows.select("__id"), "__id", "left_anti").limit(10).collect()]
        if missing:
            raise MissingRowError(f"no rows for ids {sorted(missing)}")
    return requests.join(rows, requests[request_key] == rows["__id"]).drop("__id")


def request_stats(requests: DataFrame, window: str, node: str = "node_id") -> DataFrame:
    """(window, requested, unique, duplicate_factor) of the requests of each window."""
    out = requests.groupBy(window).agg(F.count("*").alias("requested"), F.countDistinct(node).alias("unique_rows"))
    return out.withColumn("duplicate_factor", F.col("requested") / F.col("unique_rows"))


def block_density(ids: DataFrame, key: str, block_rows: int = 4096) -> DataFrame:
    """(block, requested, unique, density): how much of each block of ids is asked for."""
    own = ids.select(F.call_function("div", F.col(key).cast("bigint"), F.lit(block_rows)).alias("block"), F.col(key).alias("id"))
    out = own.groupBy("block").agg(F.count("*").alias("requested"), F.countDistinct("id").alias("unique_rows"))
    return out.withColumn("density", F.col("unique_rows") / F.lit(float(block_rows)))


def encode_category(df: DataFrame, column: str, vocabulary: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` with the vocabulary's index of each value; null and unknown values get -1."""
    v = vocabulary.select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
    out = df.join(v, df[column].cast("string") == v["__value"], "left")
    return out.withColumn(name or f"{column}_idx", F.coalesce("__idx", F.lit(-1)).cast("bigint")).drop("__value", "__idx")


def merged_names(types: Mapping[str, str]) -> dict[str, list[str]]:
    """Column names of each semantic type, sorted; columns that only hold a constant come alone."""
    out: dict[str, list[str]] = {}
    for name, kind in sorted(types.items()):
        out.setdefault(kind, []).append(name)
    return out


def encode_table(df: DataFrame, key: str, types: Mapping[str, str], vocabularies: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row per key with an array for each semantic type: numbers, category indexes, time parts, texts.

    A table without features gets the constant 1.0.
    """
    groups = merged_names(types)
    for c in groups.get("categorical", []):
        df = encode_category(df, c, (vocabularies or {})[c], f"__{c}")
    out = [F.col(key)]
    if "numerical" in groups:
        out.append(F.array(*[number(c) for c in groups["numerical"]]).alias("numerical"))
    if "categorical" in groups:
        out.append(F.array(*[F.col(f"__{c}") for c in groups["categorical"]]).alias("categorical"))
    if "timestamp" in groups:
        out.append(F.array(*[F.coalesce(p, F.lit(-1)).cast("bigint") for c in groups["timestamp"] for _, p in time_parts(c)]).alias("timestamp"))
    if "text_embedded" in groups:
        out.append(F.array(*[text_value(c) for c in groups["text_embedded"]]).alias("text"))
    if len(out) == 1:
        out.append(F.array(F.lit(1.0)).alias("const"))
    return df.select(*out)


def attach(sampled: DataFrame, encoded: Mapping[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Sampled nodes with their encoded features, one DataFrame for each node type in ``encoded`` (frame, its key)."""
    return {kind: gather(sampled.filter(F.col("node_type") == kind), frame, key) for kind, (frame, key) in encoded.items()}


def text_cache_misses(texts: DataFrame, column: str, cache: DataFrame | None) -> DataFrame:
    """(text_sha256, text): distinct texts whose digest the cache (column text_sha256) does not have."""
    own = texts.select(F.sha2(text_value(column), 256).alias("text_sha256"), text_value(column).alias("text")).dropDuplicates(["text_sha256"])
    return own if cache is None else own.join(cache.select("text_sha256"), "text_sha256", "left_anti")

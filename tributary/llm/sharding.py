"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the rank's
fraction of the source (plus a phase of the source's own, so small sources don't
all stand at one place) orders the rows of all sources into one even mixture, and
equal cuts of that order are the shards.  Every shard then holds each source in
proportion, within about a row, and row counts differ by one at most.

The hash is the MD5 of seed, id and checksum of the text, so any engine finds the same
order; only rows equal in all of these are told apart by where they are read, which
changes nothing but which of two equal rows stands first.

Both rankings are exact and have no large groups: rows fall into buckets by hash
(or by fraction), a running sum over the small table of bucket counts gives each
bucket its first rank, and only rows of one bucket are sorted together.  The
number of buckets follows the number of rows (``BUCKET_ROWS``), so a source with
a third of all rows is ranked by many tasks.  Texts are read once; the narrow
columns are written to the shared folder and everything else works on those.

The law held is ``rows``.  Equal texts are told by their checksum; this method
stratifies by source and does not hold copies together.

Defined cases: null text has size 1 and the checksum of the empty text; null
sources are one stratum; repeated rows are ranked each; an empty table gives no
rows; further columns are ignored here and carried by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_crc

SHARDS = 8
SEED = 42
#: Rows of a bucket, about; there are at least LEAST_BUCKETS.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 10_000, 512, 1 << 20


def _ranked(rows: DataFrame, bucket: Column, order: list[Column], within: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the rank from 0 by (bucket, order) among rows alike in ``within``."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*within, "__bucket").agg(F.count("*").alias("__count"))
    running = F.sum("__count").over(Window.partitionBy(*within).orderBy("__bucket")) - F.col("__count")
    first = counts.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__bucket").alias("__b"), running.alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(*order))
    same = F.col("__bucket") == F.col("__b")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranked = rows.withColumn("__inside", inside).join(first, same)
    return ranked.withColumn(name, F.col("__first") + F.col("__inside") - 1).drop("__bucket", "__b", "__first", "__inside", *[f"__{c}" for c in within])


def interleave(rows: DataFrame, *, stratum: str, unique: str, shuffle_by: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``.

    The columns ``shuffle_by`` decide a row's place in the shuffle; ``unique`` names a
    column that tells all rows apart, for ties.
    """
    n = rows.count()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, n // BUCKET_ROWS))
    shuffled = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in shuffle_by])))
    by_hash = F.shiftright(F.conv(F.substring("__h", 1, 10), 16, 10).cast("bigint") * buckets, 40)
    in_order = [F.col("__h"), F.col(unique)]
    ranked = _ranked(shuffled, by_hash, in_order, [stratum], "__rank")
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__n")).withColumnRenamed(stratum, "__s")
    phase = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.col(stratum).cast("string"))), 1, 5), 16, 10).cast("bigint") / float(1 << 20)
    placed = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("__at", (F.col("__rank") + phase) / F.col("__n"))
    placed = materialize(placed.select(*rows.columns, "__h", "__at"), "shard-order")
    by_place = F.least(F.floor(F.col("__at") * buckets), F.lit(buckets - 1))
    whole = _ranked(placed.withColumn("__all", F.lit(0)), by_place, [F.col("__at"), F.col(stratum), F.col("__h"), F.col(unique)], ["__all"], "__place").drop("__all")
    return _cut(whole, n, shards).select(*rows.columns, "shard", "slot")


def _cut(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Equal cuts: the first n % shards shards have one row more."""
    small, more = divmod(n, shards)
    place, edge = F.col("__place"), more * (small + 1)
    if small == 0:
        return rows.withColumn("shard", place.cast("int")).withColumn("slot", F.lit(0).cast("long"))
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / small))
    rows = rows.withColumn("shard", shard.cast("int"))
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(more))
    return rows.withColumn("slot", (place - first).cast("long"))


def narrow(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Row number, id, source, size and checksum of each row, from one reading of the texts."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), text_crc(text_col).alias("text_crc32")), "shard-rows")


def shard_report(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size, checksum, source, the law, shard, slot and grown_shard (null under this law)."""
    placed = interleave(narrow(docs, id_col=id_col, text_col=text_col, source_col=source_col), stratum="source", unique="row", shuffle_by=["id", "text_crc32"], shards=shards, seed=seed)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("source").alias("stratum"))


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", shards: int = SHARDS, seed: int = SEED, shard_col: str = "shard") -> None:
    """Write whole rows under ``path/<shard_col>=k``, each shard in slot order by files of bounded size.

    Rows are shuffled as in ``shard_report``; a column of the name ``shard_col`` is an error.
    """
    if shard_col in docs.columns:
        raise ValueError(f"the table has a column {shard_col}; give another shard_col")
    held = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(c) for c in docs.columns]).alias("__doc")), "shard-docs")
    own = held.select("__row", F.col(f"__doc.{id_col}").alias("__id"), text_crc(f"__doc.{text_col}").alias("__crc"), F.col(f"__doc.{stratum}").alias("__stratum"))
    placed = interleave(own, stratum="__stratum", unique="__row", shuffle_by=["__id", "__crc"], shards=shards, seed=seed)
    joined = held.join(placed.select("__row", F.col("shard").alias("__shard"), "slot"), "__row")
    sorted_rows = joined.repartitionByRange("__shard", "slot").sortWithinPartitions("__shard", "slot")
    sorted_rows.select(F.col("__shard").alias(shard_col), "__doc.*").write.partitionBy(shard_col).parquet(path)

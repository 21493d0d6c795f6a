"""Encoded columns kept on disk and used again where nothing about them has changed.

A column is kept under a digest of its processor (name, parameters, state) and of the
rows it was made of.  Asked for columns of a table, the store encodes the missing ones in
one pass, writes them as one group of files, and joins groups by the table's key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.processors import Processor, transform_all
from tributary.operators.stats import artifact_key
from tributary.sources.artifacts import load_json, save_json
from tributary.sources.readers import exists

KEY = "encoded columns"


class EncodedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.made: list[tuple[str, str]] = []  # (table, column) that were encoded and not found

    def _index(self, table: str) -> dict[str, dict]:
        return load_json(self.spark, f"{self.path}/{table}/index.json", KEY) or {}

    def _checksums(self, rows: DataFrame, key: str, columns: Sequence[str]) -> list[str]:
        """Of each column's values by key, all from one scan of these columns."""
        sums = [F.coalesce(F.sum(F.xxhash64(key, F.lit(c), c).cast("decimal(38,0)")), F.lit(0)).cast("string") for c in columns]
        return [str(x) for x in rows.agg(*sums).first()] if columns else []

    def columns(self, table: str, rows: DataFrame, key: str, processors: Sequence[Processor]) -> DataFrame:
        """The key and the output of every processor, for all ``rows``."""
        if not processors:
            return rows.select(key)
        sums = self._checksums(rows, key, [p.column for p in processors])
        digests = {p.output: artifact_key([table, key, p.digest(), s]) for p, s in zip(processors, sums, strict=True)}
        index = self._index(table)
        missing = [p for p in processors if digests[p.output] not in index or not exists(self.spark, self._group(table, index[digests[p.output]]["group"]))]
        if missing:
            group = artifact_key(sorted(digests[p.output] for p in missing))[:32]
            made = transform_all(rows.select(key, *dict.fromkeys(p.column for p in missing)), key, missing)
            made.write.mode("overwrite").parquet(self._group(table, group))
            index |= {digests[p.output]: {"group": group, "column": p.column, "output": p.output_spec()} for p in missing}
            save_json(self.spark, f"{self.path}/{table}/index.json", KEY, index)
            self.made += [(table, p.column) for p in missing]
        groups: dict[str, list[str]] = {}
        for output, d in digests.items():
            groups.setdefault(index[d]["group"], []).append(output)
        parts = [self.spark.read.parquet(self._group(table, g)).select(key, *outputs) for g, outputs in groups.items()]
        return reduce(lambda a, b: a.join(b, key), parts).select(key, *digests)

    def spec(self, table: str) -> dict[str, dict[str, str]]:
        """The kept columns with the names and types of what they were made into, without reading any."""
        return {v["column"]: v["output"] for v in self._index(table).values()}

    def _group(self, table: str, group: str) -> str:
        return f"{self.path}/{table}/group={group}"

"""Results kept on disk under a key: graphs, sampled plans for replay, JSON, run logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.stats import artifact_key
from tributary.sources.readers import exists, remove


class ArtifactError(ValueError):
    """Missing, unfinished, or made from something else."""


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()) if exists(spark, path) else None


def save_json(spark: SparkSession, path: str, key: str, payload: object) -> None:
    _write_text(spark, path, json.dumps({"key": key, "payload": payload}))


def load_json(spark: SparkSession, path: str, key: str) -> object | None:
    """The payload, or None where the file is missing, can't be read or has another key."""
    try:
        found = json.loads(_read_text(spark, path) or "null")
        return found["payload"] if isinstance(found, dict) and found.get("key") == key else None
    except ValueError:
        return None


def checksum(df: DataFrame) -> DataFrame:
    """One row: number of rows and a checksum that does not depend on their order."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def save_frames(frames: dict[str, DataFrame], path: str, identity: object, partition_by: dict[str, list[str]] | None = None) -> None:
    """Write frames and then a manifest with their checksums; without the manifest the folder counts as unfinished."""
    spark = next(iter(frames.values())).sparkSession
    remove(spark, f"{path}/manifest.json")
    sums = {}
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/{name}")
        row = checksum(spark.read.schema(df.schema).parquet(f"{path}/{name}").select(*df.columns)).first()
        sums[name] = [row["n"], row["checksum"], df.schema.jsonValue()]
    save_json(spark, f"{path}/manifest.json", artifact_key(identity), sums)


def load_frames(spark: SparkSession, path: str, identity: object, verify: bool = True) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    sums = load_json(spark, f"{path}/manifest.json", artifact_key(identity))
    if sums is None:
        raise ArtifactError(f"{path}: unfinished, or made from something else")
    out = {}
    for name, (n, total, schema) in sums.items():
        kind = StructType.fromJson(schema)
        out[name] = spark.read.schema(kind).parquet(f"{path}/{name}").select(*kind.names)
        if verify and tuple(checksum(out[name]).first()) != (n, total):
            raise ArtifactError(f"{path}/{name}: its rows are not those that were written")
    return out


def replay(frame: DataFrame, epoch: int) -> DataFrame:
    """A fixed plan as that of any epoch."""
    return frame.withColumn("epoch", F.lit(epoch).cast("bigint"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def succeeded(log: DataFrame, key: list[str], state: str = "state") -> DataFrame:
    """Keys a resumed run may skip."""
    return log.filter(F.col(state) == "ok").select(*key).distinct()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)

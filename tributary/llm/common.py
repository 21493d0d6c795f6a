"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on an Arrow batch.  Texts may be of any length, so bytes bound it; rows bound what many short ones cost.
ARROW_BYTES = 16 << 20
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session names it.

    Only on one machine (a local master, as in tests) may it be unset; a temporary
    folder then stands in.  On a cluster such a folder would be another one on
    each machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_tributary_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark._tributary_shared = own
    return own


#: By folder: tables that ``materialize`` wrote there and nothing has deleted yet.  Sessions of different
#: folders do not see each other's.
_held: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and keeps values that must not be computed twice (row
    numbers, random plans); a lost executor costs nothing, as the files are
    outside of it.  ``release`` deletes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _held.setdefault(shared_dir(spark), []).append(path)
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk that finished steps hold: tables of ``materialize`` that are no longer
    read, and shuffle files, which Spark drops once their plans are collected as garbage."""
    for t in tables:
        _delete(spark, t._written)
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    own = _held.get(shared_dir(spark), [])
    if name in own:
        own.remove(name)


def held(spark: SparkSession) -> set[str]:
    """The tables held now: a mark for ``release_since``."""
    return set(_held.get(shared_dir(spark), []))


def release_since(spark: SparkSession, mark: set[str], keep: DataFrame) -> None:
    """Delete the tables written since the mark, save ``keep``, whose rows have been computed from them."""
    for name in [n for n in _held.get(shared_dir(spark), []) if n not in mark]:
        if name != keep._written:
            _delete(spark, name)
    release(spark)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, since rows hold whole texts.

    Spark reads the bounds when the plan runs, so they are session settings; a
    tighter bound of the user's own stays.
    """
    conf = df.sparkSession.conf
    for key, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        size = int(conf.get(key).lower().rstrip("b"))
        if size <= 0 or size > bound:
            conf.set(key, str(bound))
    return df.mapInArrow(fn, schema)


class Tally:
    """Counts by 64-bit key within a task, given out in parts: keys are folded as they come, so a task holds few of them twice."""

    def __init__(self, columns: int, most: int = 1 << 21):
        self.columns, self.most = columns, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Add counts (a row per key); gives folded counts back once there are many."""
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > self.most:
            keys, counts = self._fold()
            if len(keys) > self.most // 2:
                yield keys, counts
            else:
                self.parts, self.held = [(keys, counts)], len(keys)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._fold()

    def _fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        self.parts, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[new], np.add.reduceat(counts, new, axis=0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_crc(col: str = "text"):
    """Unsigned CRC-32 of the UTF-8 bytes (null text: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(col), F.lit("")))

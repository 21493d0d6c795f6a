"""Opening databases: folders of Parquet, other file formats, or JDBC."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tributary.schema import Keys
from tributary.session import sql_over
from tributary.sources.arrowstream import arrow_stream


class ReaderClosedError(RuntimeError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a path of any file system holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


class Reader:
    """Tables by name, and SQL over them, until it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self._open, self._kept = spark, True, []

    def __enter__(self):
        self._check()
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def _check(self) -> None:
        if not self._open:
            raise ReaderClosedError("the reader is closed")

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept, self._open = [], False

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist a DataFrame until the reader is closed."""
        self._check()
        self._kept.append(df.persist())
        return df

    def names(self) -> list[str]:
        raise NotImplementedError

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        self._check()
        return {n: self.table(n) for n in self.names()}

    def keys(self) -> Keys:
        """Ids, links and times that the database itself declares; files declare none."""
        return Keys()

    def hidden(self, table: str, task: str | None = None) -> list[tuple[str, str]]:
        """(table, column) of what the tasks of a task table hide, where the database lists tasks."""
        return []

    def query(self, sql: str, **params) -> DataFrame:
        """SQL over the tables; ``:name`` marks a parameter, which is bound and never written into the text."""
        self._check()
        meant = [n for n in self.names() if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", sql, re.IGNORECASE)]
        return sql_over(self.spark, {n: self.table(n) for n in meant}, sql, params)

    def read_query(self, sql: str, **params) -> pd.DataFrame:
        """The whole result; integers that may be null keep all their digits."""
        return self.query(sql, **params).toArrow().to_pandas(types_mapper=pd.ArrowDtype)

    def stream(self, sql: str, *, batch_size: int | None = None, **params) -> pa.RecordBatchReader:
        """The result as Arrow record batches, in order, of ``batch_size`` rows where it is given."""
        return arrow_stream(self.query(sql, **params), batch_size)

    def iter_query(self, sql: str, *, batch_size: int | None, **params) -> Iterator[pd.DataFrame]:
        """The result in frames of up to ``batch_size`` rows, or in one frame without a size."""
        if batch_size is None:
            return iter([self.read_query(sql, **params)])
        return batches(self.query(sql, **params), batch_size)


def batches(df: DataFrame, batch_size: int) -> Iterator[pd.DataFrame]:
    """Rows as pandas frames of Arrow columns, so integers that may be null keep all their digits."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    return (b.to_pandas(types_mapper=pd.ArrowDtype) for b in arrow_stream(df, batch_size))


class FileReader(Reader):
    """Tables that are files or folders of one format in a folder."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", **options: str):
        super().__init__(spark)
        if not exists(spark, path):
            raise FileNotFoundError(path)
        self.path, self.fmt, self.options = path.rstrip("/"), fmt, options

    def names(self) -> list[str]:
        self._check()
        end = f".{self.fmt}"
        return [n.removesuffix(end) for n, folder in listing(self.spark, self.path) if not n.startswith(("_", ".")) and (n.endswith(end) or folder)]

    def table(self, name: str) -> DataFrame:
        self._check()
        whole = f"{self.path}/{name}.{self.fmt}"
        return self.spark.read.format(self.fmt).options(**self.options).load(whole if exists(self.spark, whole) else f"{self.path}/{name}")


class FramesReader(Reader):
    """Tables that are DataFrames already, with the keys they are known to have."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], keys: Keys | None = None):
        super().__init__(spark)
        self.frames, self._keys = dict(frames), keys or Keys()

    def names(self) -> list[str]:
        self._check()
        return sorted(self.frames)

    def table(self, name: str) -> DataFrame:
        self._check()
        return self.frames[name]

    def keys(self) -> Keys:
        return self._keys


# JDBC prefixes by dialect.
JDBC = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mssql": "sqlserver", "oracle": "oracle:thin", "clickhouse": "clickhouse", "sqlite": "sqlite"}


def jdbc_url(url: str) -> str:
    """A JDBC address from ``dialect[+driver]://...``; credentials are left out, they are options."""
    if url.startswith("jdbc:"):
        return url
    parts = urlsplit(url)
    dialect = parts.scheme.split("+")[0]
    if dialect not in JDBC:
        raise ValueError(f"no JDBC dialect for {dialect!r}; there are {sorted(JDBC)}")
    if dialect == "sqlite":
        return f"jdbc:sqlite:{parts.path}"
    host = parts.hostname or "localhost"
    port = f":{parts.port}" if parts.port else ""
    if dialect == "mssql":
        return f"jdbc:sqlserver://{host}{port};databaseName={parts.path.lstrip('/')}"
    if dialect == "oracle":
        return f"jdbc:oracle:thin:@//{host}{port}{parts.path}"
    return f"jdbc:{JDBC[dialect]}://{host}{port}{parts.path}"


class JdbcReader(Reader):
    """Tables of a database; ``partitions`` may name (column, least, greatest, number) of a table for parallel reads."""

    def __init__(self, spark: SparkSession, url: str, tables: list[str], partitions: dict[str, tuple[str, int, int, int]] | None = None, **options: str):
        super().__init__(spark)
        parts = urlsplit(url)
        own = {"user": parts.username, "password": parts.password} if not url.startswith("jdbc:") else {}
        self.url, self._names, self.partitions = jdbc_url(url), list(tables), partitions or {}
        self.options = {k: v for k, v in own.items() if v} | options

    def names(self) -> list[str]:
        self._check()
        return self._names

    def table(self, name: str) -> DataFrame:
        self._check()
        read = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", name).options(**self.options)
        if name in self.partitions:
            column, low, high, n = self.partitions[name]
            read = read.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
        return read.load()


_READERS: dict[str, Callable[..., Reader]] = {}


def _name(name: str) -> str:
    return name.strip().lower().replace("_", "-")


def register_reader(name: str, make: Callable[..., Reader]) -> None:
    _READERS[_name(name)] = make


def open_database(spark: SparkSession, location: str, *, reader: str | None = None, **options) -> Reader:
    """A reader for a folder or an address; the kind is told from the address unless named."""
    dialect = urlsplit(location).scheme.split("+")[0]
    kind = _name(reader) if reader else "sqlite" if dialect == "sqlite" else "jdbc" if dialect == "jdbc" or dialect in JDBC else "parquet"
    if kind == "sqlite" and kind not in _READERS:
        import tributary.sources.sqlite  # noqa: F401 - registers itself
    if kind not in _READERS:
        raise ValueError(f"unknown reader {kind!r}; there are {sorted(_READERS)}")
    return _READERS[kind](spark, location, **options)


for _fmt in ("parquet", "orc", "json", "csv"):
    register_reader(_fmt, lambda spark, path, fmt=_fmt, **options: FileReader(spark, path, fmt, **options))
register_reader("jdbc", JdbcReader)

"""Tables of any system as a Spark data source.

A ``TableSource`` says which tables there are, how each falls into splits, and yields
a split's rows as Arrow record batches.  ``register_source`` makes it a format that
``spark.read.format(name)`` and SQL read in parallel, with filters handed to the source, and a
reader that ``open_database`` and so the whole flow can use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from tributary.schema import Keys
from tributary.sources.readers import Reader, register_reader


class TableSource:
    """What a source implements.  It is sent to executors, so it holds addresses and no connections."""

    def names(self) -> list[str]:
        raise NotImplementedError

    def schema(self, table: str) -> StructType:
        raise NotImplementedError

    def keys(self) -> Keys:
        """Ids and links that the source itself declares."""
        return Keys()

    def answers(self, table: str, test: Filter) -> bool:
        """Whether ``scan`` leaves out all rows that fail the test; if not, Spark tests them itself."""
        return False

    def splits(self, table: str, tests: Sequence[Filter]) -> list[object]:
        """Parts of a table that tasks read; those without rows that pass the tests may be left out."""
        raise NotImplementedError

    def scan(self, table: str, columns: Sequence[str], split: object, tests: Sequence[Filter]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Scan(DataSourceReader):
    def __init__(self, source: TableSource, table: str, columns: Sequence[str]):
        self.source, self.table, self.columns = source, table, list(columns)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if self.source.answers(self.table, f):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.source.splits(self.table, self.tests)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            yield from self.source.scan(self.table, self.columns, partition.value, self.tests)


def data_source(name: str, make: Callable[[Mapping[str, str]], TableSource]) -> type[DataSource]:
    """A data source class for Spark; ``make`` builds the source from the read's options."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            whole = make(self.options).schema(self.options["table"])
            columns = self.options.get("columns")
            return StructType([whole[c] for c in columns.split(",")]) if columns else whole

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Scan(make(self.options), self.options["table"], schema.names)

    return Source


class SourceReader(Reader):
    """The tables of a registered source."""

    def __init__(self, spark: SparkSession, name: str, make: Callable[[Mapping[str, str]], TableSource], **options: str):
        super().__init__(spark)
        self.format, self.options = name, {k: str(v) for k, v in options.items()}
        self.source = make(self.options)
        spark.dataSource.register(data_source(name, make))
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def names(self) -> list[str]:
        self._check()
        return self.source.names()

    def keys(self) -> Keys:
        self._check()
        return self.source.keys()

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A table; ``columns`` are all that the source is asked for, as Spark hands it filters but no columns."""
        self._check()
        if name not in self.source.names():
            raise KeyError(f"no table {name}; there are {sorted(self.source.names())}")
        read = self.spark.read.format(self.format).options(**self.options).option("table", name)
        return (read.option("columns", ",".join(columns)) if columns else read).load()


def register_source(name: str, make: Callable[[Mapping[str, str]], TableSource]) -> None:
    """Let ``open_database`` find a source by name; the address it is given is the option ``path``."""
    register_reader(name, lambda spark, location, **options: SourceReader(spark, name, make, path=location, **options))

"""Results as a stream of Arrow record batches, a partition at a time and in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one binary value in Arrow's own format."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def arrow_stream(df: DataFrame, batch_rows: int | None = None) -> pa.RecordBatchReader:
    """The rows of ``df`` as record batches in the order of its partitions, for any library that reads Arrow.

    Executors pack their batches; the driver takes them partition by partition and
    only unpacks, so it makes no Python value per row, and holds one partition (as it was sent,
    compressed) and one batch.  A task that is lost is run again before its partition is handed on.
    Batches have the size of ``spark.sql.execution.arrow.maxRecordsPerBatch``, or
    exactly ``batch_rows`` rows but for the last.
    """
    if batch_rows is not None and batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    schema = df.limit(0).toArrow().schema
    packed = df.mapInArrow(_packed, "batch binary")

    def received() -> Iterator[pa.RecordBatch]:
        for held in packed.toLocalIterator():
            with pa.ipc.open_stream(held["batch"]) as stream:
                for batch in stream:
                    yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)

    return pa.RecordBatchReader.from_batches(schema, received() if batch_rows is None else _sized(received(), batch_rows, schema))


def _sized(batches: Iterator[pa.RecordBatch], rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``; slices share memory with the batches they are of."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            n += part.num_rows
            at += part.num_rows
            if n == rows:
                yield _one(held, schema)
                held, n = [], 0
    if held:
        yield _one(held, schema)


def _one(parts: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(schema))], schema=schema)

"""Sequence packing along a space-filling curve.

Each document becomes token ids and a key: its hashed bag of ids is projected to
``DIMS`` dimensions, and the key is the place of that point on a Hilbert curve,
so documents alike are near each other on the curve.  The documents are sorted
by the key over ranges, a running sum of lengths gives each its place in one
long stream, and the stream is cut every ``capacity`` tokens.  Only the last
sequence can be short, so there is next to no padding.

Steps: tokenise once into a written table with a row number (ids as 2 or 4
bytes); sort only the narrow columns by range; sum lengths within ranges and
over the few range totals; join the places back by row number and cut.  The row
number also tells repeated rows apart and breaks ties of key and id, so a hot
key is spread over ranges.

Defined cases: null or empty texts are documents of the end token alone;
repeated rows are packed each; an empty table gives no pieces; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize
from .tokens import encoder

CAPACITY = 2048
END_ID = 1
DIMS = 3
BITS = 12
PLACES = 4096


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers below 2**bits.

    Works from the highest bit down: each level undoes the reflection and exchange
    of axes that the cell chosen so far stands for, then a Gray code orders the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for axis in range(n):
            flip = (x[axis] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def curve_keys(documents: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """The curve key of each document's ids: hashed counts, damped, of length one, projected, squashed."""
    projection = np.random.default_rng(seed).standard_normal((PLACES, DIMS)).astype(np.float32)
    out = np.zeros(len(documents), np.int64)
    for a in range(0, len(documents), 256):
        part = documents[a : a + 256]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        place = ((np.concatenate(part).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        counts = np.sqrt(np.bincount(row * PLACES + place, minlength=len(part) * PLACES).reshape(len(part), PLACES).astype(np.float32))
        z = counts @ projection / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
        share = 1 / (1 + np.exp(-1.702 * z.astype(np.float64)))
        out[a : a + 256] = hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return out


def tokenized(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end_id: int) -> DataFrame:
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own = encoder(tokenizer)
        kind = np.dtype("<u2") if max(own.vocabulary, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            ids = [np.append(x, end_id).astype(kind) for x in own.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(curve_keys(ids) if ids else [], pa.int64())], ["row", "id", "n", "ids", "key"])

    return map_arrow(source, run, T.StructType([T.StructField("row", T.LongType()), source.schema["id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("key", T.LongType())]))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the lengths before each row of this range."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        total = np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(before + total - n), batch.column("n")], ["row", "part", "before", "n"])
        before += int(total[-1]) if len(n) else 0


def _cut(capacity: int, keep_ids: bool):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            docs: list[int] = []
            for i, (n, raw, at) in enumerate(zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                ids = np.frombuffer(raw, np.dtype("<u2") if len(raw) == 2 * n else np.dtype("<u4")).astype("<u4").tobytes()
                start = 0
                while start < n:
                    length = min(n - start, capacity - at % capacity)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(piece), n, at // capacity, at % capacity, piece if keep_ids else None))
                    docs.append(i)
                    start += length
                    at += length
            columns = [pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * 7)[:6]]
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array([r[6] for r in rows], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(docs, pa.int32())), *columns], ["id", *names])

    return run


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and the piece's ids as little-endian 32-bit integers, if ``keep_ids``)."""
    rows = materialize(tokenized(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "pack-ids")
    narrow = rows.select("row", "id", "n", "key")
    ranges = narrow.repartitionByRange("key", "id", "row").sortWithinPartitions("key", "id", "row")
    running = materialize(map_arrow(ranges.select("row", "n"), _running, "row long, part int, before long, n long"), "pack-order")
    totals = running.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    first = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    place = running.join(first, "part").select("row", (F.col("first") + F.col("before")).alias("at"))
    placed = rows.select("row", "id", "n", "ids").join(place.hint("shuffle_hash"), "row").select("id", "n", "ids", "at")
    fields = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return map_arrow(placed, _cut(capacity, keep_ids), T.StructType([rows.schema["id"], *fields])).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    """The vocabulary file the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

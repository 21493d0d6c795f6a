"""Benchmark decontamination: a broadcast hash set of test n-grams.

The windows of the benchmark items are hashed into a set that every executor
holds; each text is scanned once, its window hashes are looked up, and each hit
is verified against the words themselves.  That takes one scan and no shuffle while the
benchmark has at most ``BLOCK_BYTES`` of text.

A larger one is never gathered: its windows are made in Spark and written to the shared
folder, and what is broadcast is a bitmap of their hashes, of at most ``MOST_BITS`` bits whatever
their number.  One scan of the texts finds the windows whose bit is set; these meet the
benchmark's by hash in a join, are verified word by word, and are put together by text.

Defined cases: null or wordless texts have no words and no hits; items without
words have no windows; repeated rows each get their own result; columns beyond
those named are carried (or ignored by the report) whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize
from .textbytes import mix, words

#: Bytes of benchmark text whose windows are broadcast whole.  A window takes about 30 bytes of memory, and there is at most one a word.
BLOCK_BYTES = 8 << 20
#: The bitmap for a larger benchmark has 2**28 bits (32 MB) at most.
MOST_BITS = 28
WINDOW = 10


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + len(out)]
    return mix(out)


class WindowSet:
    """The windows of benchmark items, (name, text) each, as arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = [x[0] for x in items]
        data, starts, ends, found = [], [], [], {}
        offset = 0
        for w in words(pa.array([x[1] for x in items], pa.large_string())) if items else ():
            base, hashes, length = sum(map(len, starts)), w.hashes(), np.diff(w.of)
            item_of = np.repeat(np.arange(w.first, w.last), length)
            for n in np.unique(np.minimum(length, window)):
                if n == 0:
                    continue
                h = window_hashes(hashes, int(n))
                at = np.arange(len(h))
                # whole windows inside an item; shorter than ``window`` only where the item is
                at = at[(item_of[at] == item_of[at + n - 1]) & (np.minimum(length, window)[item_of[at] - w.first] == n)]
                found.setdefault(int(n), []).append((h[at], item_of[at].astype(np.int32), (at + base).astype(np.int64)))
            data.append(w.data)
            starts.append(w.starts + offset)
            ends.append(w.ends + offset)
            offset += len(w.data)
        self.data = np.concatenate(data).tobytes() if data else b""
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.tables = {}
        for n, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            h, item, at = h[order], item[order], at[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])))
            if len(h):
                h, item, at = h[new], item[new], at[new]
                bits = max(16, math.ceil(math.log2(16 * len(h))))
                near = np.zeros(1 << bits, bool)
                near[h >> np.uint64(64 - bits)] = True
                self.tables[n] = h, item, at, near, np.uint64(64 - bits)

    def _words(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))

    def scan(self, w) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are inside an occurrence, and the items found in each text."""
        hit = np.zeros(len(w.starts), bool)
        found: list[set[str]] = [set() for _ in range(w.last - w.first)]
        if not len(w.starts):
            return hit, found
        hashes = w.hashes()
        text_of = np.repeat(np.arange(w.last - w.first), np.diff(w.of))
        owners: dict[bytes, set[str]] = {}  # of the windows met in these texts, verified word by word
        for n, (known, item, where, near, shift) in self.tables.items():
            h = window_hashes(hashes, n)
            at = np.flatnonzero(near[h >> shift])
            at = at[text_of[at] == text_of[at + n - 1]]
            left, right = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            some = right > left
            for p, a, b in zip(at[some].tolist(), left[some].tolist(), right[some].tolist(), strict=True):
                own = b" ".join(w.word(q) for q in range(p, p + n))
                if own not in owners:
                    owners[own] = {self.names[item[k]] for k in range(a, b) if self._words(int(where[k]), n) == own}
                if owners[own]:
                    hit[p : p + n] = True
                    found[text_of[p]] |= owners[own]
        return hit, found


def _runs(hit: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.tolist()


_FOUND = [T.StructField("__n", T.LongType()), T.StructField("__runs", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))]
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]


def _scanned(docs: DataFrame, text_col: str, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """``docs`` with __n, __runs and __items, from a broadcast of all windows."""
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet(items, window))
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, found = [], [], []
            for w in words(batch.column(text_col)):
                hit, items = windows.value.scan(w)
                for t in range(w.last - w.first):
                    own = hit[w.of[t] : w.of[t + 1]]
                    n_words.append(len(own))
                    runs.append(_runs(own) if items[t] else [])
                    found.append(sorted(items[t]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip((n_words, runs, found), _KINDS, strict=True))], [*names, *(f.name for f in _FOUND)])

    return map_arrow(docs, scan, T.StructType([*docs.schema.fields, *_FOUND]))


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, n, h, own) of every different window of every item: its number of words, their hash, and the words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                hashes = w.hashes()
                for t in range(w.last - w.first):
                    a, b = int(w.of[t]), int(w.of[t + 1])
                    if n := min(window, b - a):
                        h = window_hashes(hashes[a:b], n)
                        own = [b" ".join(w.word(q) for q in range(p, p + n)) for p in range(a, b - n + 1)]
                        item = [batch.column(0)[w.first + t].as_py() or ""] * len(h)
                        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array([n] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(own, pa.binary())], ["item", "n", "h", "own"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_arrow(rows, cut, "item string, n int, h long, own binary").distinct()


def _bitmap(windows: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """(bits, how many): those of the windows' hashes by their first bits are set."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(count, 1)))))
    place = F.shiftrightunsigned("h", 64 - bits) + 1  # bitmaps count from 1
    parts = windows.select(place.alias("i")).groupBy(F.bitmap_bucket_number("i").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("bits"))
    near = np.zeros((1 << bits) // 8, np.uint8)
    for b, part in zip(*(c.to_pylist() for c in parts.toArrow().columns), strict=True):
        held = np.frombuffer(part, np.uint8)
        near[(b - 1) * len(held) : b * len(held)] = held[: len(near) - (b - 1) * len(held)]
    return near, bits


def _candidates(texts: DataFrame, near: np.ndarray, bits: int, lengths: list[int]) -> DataFrame:
    """(__t1, __t2, n, p, h, own): windows of the texts whose bit is set, by the texts' hashes."""
    shared = texts.sparkSession.sparkContext.broadcast(near)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("__text")):
                hashes, text_of = w.hashes(), np.repeat(np.arange(w.last - w.first), np.diff(w.of))
                for n in lengths:
                    h = window_hashes(hashes, n)
                    i = (h >> np.uint64(64 - bits)).astype(np.int64)
                    at = np.flatnonzero((shared.value[i >> 3] >> (i & 7).astype(np.uint8)) & 1)
                    at = at[text_of[at] == text_of[at + n - 1]]
                    if len(at):
                        t = pa.array(text_of[at] + w.first)
                        own = [b" ".join(w.word(q) for q in range(p, p + n)) for p in at.tolist()]
                        place = at - w.of[text_of[at]]
                        arrays = [pa.array([n] * len(at), pa.int32()), pa.array(place.astype(np.int64)), pa.array(h[at].view(np.int64)), pa.array(own, pa.binary())]
                        yield pa.RecordBatch.from_arrays([batch.column("__t1").take(t), batch.column("__t2").take(t), *arrays], ["__t1", "__t2", "n", "p", "h", "own"])

    return map_arrow(texts, scan, "__t1 long, __t2 long, n int, p long, h long, own binary")


def _merged(docs: DataFrame, text_col: str, hits: DataFrame) -> DataFrame:
    """``docs`` with __n, __runs and __items from the hits of all blocks, met by the hashes of the text."""
    each = hits.groupBy("__t1", "__t2").agg(F.flatten(F.collect_list("__runs")).alias("__all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    own = docs.withColumns(_text_keys(text_col)).join(each.withColumnsRenamed({"__t1": "__u1", "__t2": "__u2"}), (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left")
    own = own.select(*docs.columns, "__all", F.coalesce("__items", F.array().cast("array<string>")).alias("__items"))

    names = docs.columns

    def merge(batches):
        for batch in batches:
            n_words, runs = [], []
            for w in words(batch.column(text_col)):
                for t in range(w.last - w.first):
                    hit = np.zeros(w.of[t + 1] - w.of[t], bool)
                    spans = batch.column("__all")[w.first + t].as_py() or []
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        hit[a:b] = True
                    n_words.append(len(hit))
                    runs.append(_runs(hit) if spans else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, _KINDS[0]), pa.array(runs, _KINDS[1]), batch.column("__items").cast(_KINDS[2])], [*names, "__n", "__runs", "__items"])

    return map_arrow(own, merge, T.StructType([*docs.schema.fields, *_FOUND]))


def _text_keys(text_col: str) -> dict:
    return {"__t1": F.xxhash64(text_col), "__t2": F.xxhash64(F.lit(7), text_col)}


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """``docs`` with __n (words), __runs (word positions hit, as start and end by turns) and __items (found, sorted)."""
    size = benchmark.agg(F.sum(F.octet_length(item_text) + 8)).first()[0] or 0
    if size <= block_bytes:
        items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text)).toArrow()
        return _scanned(docs, text_col, list(zip(*(c.to_pylist() for c in items.columns), strict=True)), window)
    windows = materialize(_item_windows(benchmark, item_col, item_text, window), "benchmark-windows")
    kinds = windows.groupBy("n").count().collect()
    near, bits = _bitmap(windows, sum(k["count"] for k in kinds))
    texts = docs.select(F.col(text_col).alias("__text")).filter("__text IS NOT NULL").withColumns(_text_keys("__text"))
    met = _candidates(texts, near, bits, sorted(k["n"] for k in kinds)).dropDuplicates(["__t1", "__t2", "n", "p"])
    found = met.join(windows.withColumnRenamed("own", "__known"), ["n", "h"]).filter("own = __known")
    return _merged(docs, text_col, found.select("__t1", "__t2", F.array("p", F.col("p") + F.col("n")).alias("__runs"), F.array("item").alias("__items")))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per document: its id, n_words, runs (word positions hit, as start and
    end by turns), items (ids of items with occurring windows), and the text if asked."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = _marked(own, benchmark, "__text", item_col, item_text, window, block_bytes)
    text = [F.col("__text").alias(text_col)] if keep_text else []
    return out.select(F.col("__id").alias(id_col), *text, F.col("__n").alias("n_words"), F.col("__runs").alias("runs"), F.col("__items").alias("items"))


def overlap_digest(report: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report as figures: n_words, n_hit, n_items, items_sha256, contaminated."""
    length = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return report.select(id_col, "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, remove: str = "documents") -> DataFrame:
    """``docs`` without contamination, with the same columns.

    ``remove="documents"`` drops every document with a hit; ``"spans"`` cuts the
    hit words out of the text and keeps the document.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    marked = _marked(docs, benchmark, text_col, item_col, item_text, window, block_bytes)
    if remove == "documents":
        return marked.filter(F.size("__runs") == 0).select(*docs.columns)

    names = docs.columns

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for w in words(batch.column(at)):
                for t in range(w.last - w.first):
                    runs = batch.column("__runs")[w.first + t].as_py()
                    if runs:
                        raw, base, pieces, end = texts[w.first + t].encode(), int(w.bounds[t]), [], 0
                        for a, b in zip(runs[::2], runs[1::2], strict=True):
                            pieces.append(raw[end : int(w.starts[w.of[t] + a]) - base])
                            end = int(w.ends[w.of[t] + b - 1]) - base
                        texts[w.first + t] = b"".join([*pieces, raw[end:]]).decode()
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.select(names)

    return map_arrow(marked, clean, docs.schema)

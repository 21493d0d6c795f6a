"""Text vectors: from a function of a batch of texts to a matrix, or from a table of word vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.scalars import text_value
from tributary.operators.features import text_cache_misses

Embedder = Callable[[list[str]], np.ndarray]
_TOKEN = re.compile(r"[^\W_]+")


def hashed_embedder(dim: int = 64) -> Embedder:
    """Mean of fixed random signs of the words: a stand-in that needs no model file."""

    def embed(texts: list[str]) -> np.ndarray:
        known: dict[str, np.ndarray] = {}
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            tokens = _TOKEN.findall(t.lower())
            for w in tokens:
                if w not in known:
                    bits = np.unpackbits(np.frombuffer(hashlib.blake2b(w.encode(), digest_size=(dim + 7) // 8).digest(), np.uint8))[:dim]
                    known[w] = bits.astype(np.float32) * 2 - 1
                out[i] += known[w]
            if tokens:
                out[i] /= len(tokens)
        return out

    return embed


def embed_column(df: DataFrame, column: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text; equal texts are embedded once, null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            order = np.argsort([-len(t) for t in texts], kind="stable")
            vectors = np.empty((len(texts), 0), np.float32)
            if len(texts):
                found = embedder([texts.iloc[i] for i in order])
                vectors = np.empty_like(found)
                vectors[order] = found
            yield pd.Series(list(vectors))

    distinct = text_cache_misses(df, column, None)
    vectors = distinct.select("text_sha256", run("text").alias(name))
    return df.withColumn("text_sha256", F.sha2(text_value(column), 256)).join(vectors, "text_sha256").drop("text_sha256")


def pool_vectors(df: DataFrame, column: str, vectors: DataFrame, *, word: str = "word", vector: str = "vector", dim: int, name: str = "embedding") -> DataFrame:
    """``df`` with the mean of its words' vectors, looked up in a table (word, vector); words it lacks don't
    count, and a text without known words has zeros.  Equal texts are pooled once.

    Words meet their vectors in a join, so the table may be of any size; sums are kept by
    text and dimension, so no text's vectors are gathered.  Repeated words are folded
    within their text, so no task holds the words of many texts.
    """
    distinct = text_cache_misses(df, column, None)
    times = distinct.select("text_sha256", F.inline(_word_counts("text")))
    met = times.join(vectors.select(F.col(word).alias("__w"), F.col(vector).alias("__v")), "__w")
    parts = met.select("text_sha256", "__n", F.posexplode("__v").alias("__i", "__x")).groupBy("text_sha256", "__i").agg((F.sum(F.col("__n") * F.col("__x")) / F.sum("__n")).alias("__x"))
    pooled = parts.groupBy("text_sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda e: e["__x"].cast("float")).alias(name))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    own = df.withColumn("text_sha256", F.sha2(text_value(column), 256)).join(pooled, "text_sha256", "left")
    return own.withColumn(name, F.coalesce(name, zeros)).drop("text_sha256")


def _word_counts(column: str) -> Column:
    """Array of (__w, __n): the distinct words of a text and how often it has them."""

    def folded(words: Column) -> Column:
        last = F.size(words) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(words, i) != F.get(words, i + 1)))
        return F.get(F.transform(F.array(ends), lambda e: F.transform(e, lambda i, k: F.struct(F.get(words, i).alias("__w"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("bigint").alias("__n")))), F.lit(0))

    words = F.array_sort(F.expr(WORDS.format(column)))
    return F.get(F.transform(F.filter(F.array(words), lambda a: F.size(a) > 0), folded), F.lit(0))


def bag_mean(ids: np.ndarray, offsets: np.ndarray, matrix: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted means of rows of ``matrix``: bag i has the rows ``ids[offsets[i]:offsets[i + 1]]``; negative ids don't count.

    A bag without weight has zeros.  Sums are of doubles, a slice of bags at a time, so memory is bounded.
    """
    n, dim = len(offsets) - 1, matrix.shape[1]
    out = np.zeros((n, dim), np.float32)
    weights = np.ones(len(ids)) if weights is None else np.asarray(weights, np.float64)
    begin = 0
    while begin < n:
        stop = max(int(np.searchsorted(offsets, offsets[begin] + BAG_IDS, "right")) - 1, begin + 1)
        part = slice(int(offsets[begin]), int(offsets[stop]))
        bag = np.repeat(np.arange(stop - begin), np.diff(offsets[begin : stop + 1]))
        known = ids[part] >= 0
        bag, row, w = bag[known], ids[part][known], weights[part][known]
        if len(bag):
            heads = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
            total = np.add.reduceat(matrix[row].astype(np.float64) * w[:, None], heads, axis=0)
            mass = np.add.reduceat(w, heads)
            held = mass != 0
            out[begin + bag[heads[held]]] = total[held] / mass[held, None]
        begin = stop
    return out


#: Ids of a slice of bags, about.
BAG_IDS = 1 << 16


def embed_bags(df: DataFrame, bags: str, matrix: np.ndarray, *, weights: str | None = None, name: str = "embedding") -> DataFrame:
    """``df`` with the mean of the matrix rows that each list of ids names, by weight where there are weights.

    The matrix is broadcast, so its size is the caller's to bound; null lists are empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix, np.float32))
    columns = [c for c in df.columns if c != name]
    schema = df.select(*columns).schema.add(name, T.ArrayType(T.FloatType()))
    at, by = columns.index(bags), None if weights is None else columns.index(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _flat(batch.column(at))
            w = None if by is None else _flat(batch.column(by))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(bag_mean(ids, offsets, shared.value, w))], names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, dim = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(matrix.ravel()))


#: Words of a text, for tables of word vectors.
WORDS = r"regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+', 0)"
#: Bound on the words that reach Python at once.
BATCH_BYTES = 4 << 20
#: Tables of vectors up to this size are broadcast, larger ones joined.
BROADCAST_BYTES = 64 << 20


class HashedVectors:
    """Vectors of ``hashed_embedder``, for flows without a table of vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def digest(self) -> str:
        return f"hashed-{self.dim}"

    def embed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        return embed_column(df, column, hashed_embedder(self.dim), name)


class WordVectors:
    """Mean word vectors from a table (word, vector): as bags over a broadcast matrix where it is small, else by joins."""

    def __init__(self, vectors: DataFrame, *, word: str = "word", vector: str = "vector", dim: int):
        self.vectors, self.dim = vectors.select(F.col(word).alias("word"), F.col(vector).cast("array<float>").alias("vector")), dim
        self._digest: str | None = None

    def digest(self) -> str:
        """Of the words, their vectors, the dimension and the splitting of words; another table gives another digest."""
        if self._digest is None:
            h = F.xxhash64("word", "vector")
            row = self.vectors.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
            self._digest = hashlib.sha256(f"{row[0]}|{row[1]}|{self.dim}|{WORDS}".encode()).hexdigest()[:32]
        return self._digest

    def embed(self, df: DataFrame, column: str, name: str) -> DataFrame:
        size = self.vectors.agg(F.sum(F.octet_length("word") + 4 * self.dim + 16)).first()[0] or 0
        if size > BROADCAST_BYTES:
            return pool_vectors(df, column, self.vectors, dim=self.dim, name=name)
        held = self.vectors.dropDuplicates(["word"]).toArrow()
        known = held["word"].combine_chunks()
        matrix = np.zeros((len(known), self.dim), np.float32)
        if len(known):
            matrix[:] = np.stack(held["vector"].to_pylist())
        return bag_words(df, column, known, matrix, name)


def bag_words(df: DataFrame, column: str, known: pa.Array, matrix: np.ndarray, name: str) -> DataFrame:
    """``df`` with the mean of the rows of ``matrix`` of a text's words, the k-th row being of ``known[k]``; equal texts once."""
    distinct = text_cache_misses(df, column, None).select("text_sha256", F.expr(WORDS.format("text")).alias("words"))
    shared = df.sparkSession.sparkContext.broadcast((known, np.ascontiguousarray(matrix, np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows = shared.value
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bag_mean(ids, np.concatenate(([0], np.cumsum(sizes))), rows))], names=["text_sha256", name])

    # the lists hold whole texts, so bytes bound a batch; Spark reads the bound when the plan runs
    conf = df.sparkSession.conf
    size = int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b"))
    if size <= 0 or size > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    vectors = distinct.mapInArrow(run, f"text_sha256 string, `{name}` array<float>")
    return df.withColumn("text_sha256", F.sha2(text_value(column), 256)).join(vectors, "text_sha256").drop("text_sha256")


def refresh_cache(df: DataFrame, column: str, cache_path: str, embedder: HashedVectors | WordVectors) -> DataFrame:
    """(text_sha256, embedding) of all texts of a column; those the cache lacks are computed and appended.

    The cache has a folder for each embedder, by its digest: vectors of another table, another
    dimension or another splitting of words are never taken for its own.
    """
    spark = df.sparkSession
    path = f"{cache_path}/embedder={embedder.digest()}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    cache = spark.read.parquet(path) if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path) else None
    missing = text_cache_misses(df, column, cache)
    embedder.embed(missing, "text", "embedding").select(F.sha2("text", 256).alias("text_sha256"), "embedding").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def compact_cache(spark, path: str, target: str, files: int = 8) -> None:
    """Many small files of a cache as few, sorted by key over ranges."""
    spark.read.parquet(path).repartitionByRange(files, "text_sha256").sortWithinPartitions("text_sha256").write.parquet(target)

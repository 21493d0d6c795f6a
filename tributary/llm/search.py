"""Ranked lexical search by windowed bucket scoring.

The best documents for each query item under an integer BM25-like score.

1. One reading of the texts finds each document's terms that any item asks for, with
   their counts; these rows are written to the shared folder (``forward``).  All other
   passes read them and never a text.  The terms asked for are broadcast while there
   are at most ``MOST_TERMS``; beyond that, documents keep all their terms.
2. Document frequencies, the number of documents and of terms are exact aggregations
   over all rows, and give each term its weight (``weights``).
3. Items are taken in blocks of at most ``BLOCK_TERMS`` terms, one broadcast each.  A task
   goes through its documents in the order of their ids, in fixed windows of ``WINDOW``
   documents.  In a window the postings are turned by term, and for each item the
   postings of its terms are added into one array of a window's size, which stays in
   the processor's cache, with a bitset of the slots in use; slots in use are
   harvested into the item's heap, and only those are set back to zero (``Scorer``).
4. A task gives at most ``k`` rows for each item; the best of these are the result.

Terms are told by 64-bit hashes.  While terms are broadcast, each match's bytes are
compared with the term's, so no other word counts as one.

Defined cases: a document of null text has no term and is never found; documents
without any term do not count in N; repeated rows are ranked each; null and
repeated ids are ids like others, and among equal scores nulls come first; items
of one id are one item with the terms of all its texts, a null item id included;
items without a term, or whose terms no document has, give no rows; empty tables give
no rows; further columns of either table are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize
from .textbytes import words

BEST = 50
#: Documents of a window: 8 bytes each are a quarter of a megabyte.  Its postings are bounded too, about.
WINDOW, POSTINGS = 1 << 15, 1 << 22
#: Terms broadcast as a filter at most (about 40 bytes each), and (item, term) pairs of a block of items (16 bytes each).
MOST_TERMS, BLOCK_TERMS = 1 << 20, 1 << 20
#: Postings lists from this length on keep their bits for a window's other items.
LONG_LIST = 256


class Vocabulary:
    """The terms asked for: sorted hashes, and their bytes to tell a match from a collision."""

    def __init__(self, terms: list[bytes], hashes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        data = [terms[i] for i in order]
        self.lengths = np.array([len(t) for t in data], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word among the terms, -1 where it is none of them."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        like = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == ends - starts))
        size = (ends - starts)[like]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        same = data[np.repeat(starts[like], size) + step] == self.data[np.repeat(self.starts[at[like]], size) + step]
        like = like[np.logical_and.reduceat(same, first)] if len(like) else like
        found = np.full(len(hashes), -1)
        found[like] = at[like]
        return found


def item_terms(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term, word) of all items; ``term`` is the word's hash."""
    field = items.schema[item_col]
    schema = T.StructType([T.StructField(item_col, field.dataType), T.StructField("term", T.LongType()), T.StructField("word", T.BinaryType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                of = np.repeat(np.arange(w.first, w.last), np.diff(w.of))
                hashes = w.hashes()
                _, keep = np.unique(np.stack((of.astype(np.uint64), hashes)), axis=1, return_index=True)
                text = pa.array([w.word(i) for i in keep.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[keep])), pa.array(hashes[keep].view(np.int64)), text], names=[item_col, "term", "word"])

    return map_arrow(items.select(item_col, text_col), split, schema).distinct()


def forward(docs: DataFrame, vocabulary: Vocabulary | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, number of terms ``n``, and its ``terms`` of the vocabulary (None: all) with their counts ``tfs``."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType(), False)), T.StructField("tfs", T.ArrayType(T.IntegerType(), False))])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for w in words(batch.column(1)):
                texts = w.last - w.first
                of, hashes = np.repeat(np.arange(texts), np.diff(w.of)), w.hashes()
                if known is not None:
                    at = known.find(hashes, w.data, w.starts, w.ends)
                    of, hashes = of[at >= 0], hashes[at >= 0]
                order = np.lexsort((hashes, of))
                of, hashes = of[order], hashes[order]
                new = np.flatnonzero(np.concatenate((np.ones(min(len(of), 1), bool), (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))))
                tfs = np.diff(np.append(new, len(of))).astype(np.int32)
                offsets = pa.array(np.searchsorted(of[new], np.arange(texts + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (hashes[new].view(np.int64), tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, texts), pa.array(np.diff(w.of).astype(np.int64)), *lists], names=[id_col, "n", "terms", "tfs"])

    return map_arrow(docs.select(id_col, text_col), count, schema)


def weights(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """(asked terms with their weights, number of documents with a term, number of all their terms)."""
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (F.col("df") * 2 + 1).cast("double")
    weight = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    return asked.join(df, "term").select(*asked.columns, weight.alias("w")), n_docs, n_terms


class Block:
    """Some items with their terms and weights: terms of item i are ``term[of[i]:of[i + 1]]``, places in ``hashes``."""

    def __init__(self, items: pa.Array, hashes: np.ndarray, weight: np.ndarray):
        coded = items.dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        self.items = coded.dictionary
        self.hashes, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        self.weight = weight[first]
        order = np.argsort(code, kind="stable")
        self.term = place[order]
        self.of = np.searchsorted(code[order], np.arange(len(self.items) + 1))


class Scorer:
    """Scores windows of documents against a block of items and keeps each item's best."""

    def __init__(self, block: Block, n_docs: int, n_terms: int, best: int, window: int):
        self.block, self.n_docs, self.n_terms, self.best = block, n_docs, n_terms, best
        self.heaps: list[list[tuple]] = [[] for _ in range(len(block.items))]
        self.sums = np.zeros(window, np.int64)
        self.seen = 0

    def add(self, ids: pa.Array, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, of: np.ndarray) -> None:
        """Score documents of ascending ids; postings of document i are ``of[i]:of[i + 1]``."""
        block = self.block
        slot = np.repeat(np.arange(len(n)), np.diff(of))
        place = np.minimum(np.searchsorted(block.hashes, terms), len(block.hashes) - 1)
        asked = np.flatnonzero((block.hashes[place] == terms) & (block.weight[place] > 0))
        asked = asked[np.argsort(place[asked], kind="stable")]
        slot, place, tf = slot[asked], place[asked], tfs[asked].astype(np.int64)
        length = 50 + (50 * n * self.n_docs) // max(self.n_terms, 1)
        part = block.weight[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * length[slot]))
        edges = np.searchsorted(place, np.arange(len(block.hashes) + 1))
        begin, end = edges[:-1].tolist(), edges[1:].tolist()
        bits: dict[int, np.ndarray] = {}
        for item in range(len(block.items)):
            used = np.zeros((len(n) + 7) // 8, np.uint8)
            for t in block.term[block.of[item] : block.of[item + 1]].tolist():
                b, e = begin[t], end[t]
                if b < e:
                    at = slot[b:e]
                    self.sums[at] += part[b:e]  # a document has a term once, so no slot twice
                    if e - b < LONG_LIST:
                        np.bitwise_or.at(used, at >> 3, (1 << (at & 7)).astype(np.uint8))
                    else:
                        if t not in bits:
                            mark = np.zeros(len(used) * 8, bool)
                            mark[at] = True
                            bits[t] = np.packbits(mark, bitorder="little")
                        used |= bits[t]
            hit = np.flatnonzero(np.unpackbits(used, bitorder="little"))
            if len(hit):
                self._harvest(item, ids, hit, self.sums[hit])
                self.sums[hit] = 0
        self.seen += len(n)

    def _harvest(self, item: int, ids: pa.Array, slots: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[item]
        above = heap[0][0] if len(heap) == self.best else 0  # an equal score of a later id is no better
        keep = scores > above
        slots, scores = slots[keep], scores[keep]
        if len(slots) > self.best:
            least = np.partition(scores, len(scores) - self.best)[len(scores) - self.best]
            slots, scores = slots[scores >= least], scores[scores >= least]
            first = np.lexsort((slots, -scores))[: self.best]
            slots, scores = slots[first], scores[first]
        for s, score in zip(slots.tolist(), scores.tolist(), strict=True):
            entry = (score, -(self.seen + s), ids[s])
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def result(self, id_type: pa.DataType) -> tuple[pa.Array, pa.Array, pa.Array]:
        item = np.repeat(np.arange(len(self.heaps)), [len(h) for h in self.heaps])
        ids = pa.array([e[2].as_py() for h in self.heaps for e in h], id_type)
        return self.block.items.take(pa.array(item)), ids, pa.array([e[0] for h in self.heaps for e in h], pa.int64())


def _windows(batches: Iterator[pa.RecordBatch], window: int, most: int = POSTINGS) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a task in order, ``window`` at a time and fewer where postings are many: (ids, n, terms, tfs, offsets)."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        begin = 0
        while begin < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[begin:]), most - postings, "right")
            stop = min(len(sizes), begin + window - rows, begin + max(int(room), 0 if rows else 1))
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                rows += stop - begin
                postings += int(sizes[begin:stop].sum())
                begin = stop
            if begin < len(sizes):
                yield _joined(held)
                held, rows, postings = [], 0, 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
    terms = np.concatenate([b.column(2).flatten().to_numpy() for b in held]).view(np.uint64)
    tfs = np.concatenate([b.column(3).flatten().to_numpy() for b in held])
    n = np.concatenate([b.column(1).to_numpy() for b in held])
    return pa.concat_arrays([b.column(0) for b in held]), n, terms, tfs, np.concatenate(([0], np.cumsum(sizes)))


def _best_of_block(rows: DataFrame, block: Block, n_docs: int, n_terms: int, item: T.StructField, best: int, window: int) -> DataFrame:
    """The best documents of each task for the block's items."""
    doc = rows.schema[0]
    schema = T.StructType([item, doc, T.StructField("score", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, id_type = Scorer(shared.value, n_docs, n_terms, best, window), None
        for ids, n, terms, tfs, of in _windows(batches, window):
            id_type = ids.type
            scorer.add(ids, n, terms, tfs, of)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(list(scorer.result(id_type)), names=schema.names)

    return map_arrow(rows.sortWithinPartitions(doc.name), score, schema)


def _blocks(asked: DataFrame, item_col: str, most: int) -> tuple[DataFrame, int]:
    """(``asked`` with the number of each item's block, number of blocks); a block holds at most ``most`` rows, or one item."""
    sizes = asked.groupBy(item_col).agg(F.count("*").alias("n"))
    total, items = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = -(-total // most)

    def block() -> Column:
        return F.pmod(F.xxhash64(F.col(item_col)), F.lit(max(blocks, 1))).alias("block")

    while 1 < blocks < 16 * items:
        shared = sizes.groupBy(block()).agg(F.sum("n").alias("n"), F.count("*").alias("items")).filter("items > 1")
        if (shared.agg(F.max("n")).first()[0] or 0) <= most:
            break
        blocks *= 2
    return asked.select("*", block()), blocks


def search(
    docs: DataFrame, items: DataFrame, *, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    window: int = WINDOW, most_terms: int = MOST_TERMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``best`` documents for each item with a score above zero."""
    if id_col == item_col:
        raise ValueError("documents and items need id columns of different names")
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_col=item_col, text_col=text_col), "search-terms")
    few = asked.groupBy("term").agg(F.min("word").alias("word")).limit(most_terms + 1).toArrow()
    vocabulary = None
    if few.num_rows <= most_terms:
        vocabulary = Vocabulary(few["word"].to_pylist(), few["term"].combine_chunks().to_numpy().view(np.uint64))
    rows = materialize(forward(docs, vocabulary, id_col=id_col, text_col=text_col), "search-postings")
    asked, n_docs, n_terms = weights(rows, asked.select(item_col, "term"))
    asked, blocks = _blocks(materialize(asked, "search-weights"), item_col, block_terms)
    out = spark.createDataFrame([], T.StructType([items.schema[item_col], docs.schema[id_col], T.StructField("score", T.LongType())]))
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).select(item_col, "term", "w").toArrow().combine_chunks()
        if part.num_rows:
            held = Block(_one(part[item_col]), _one(part["term"]).to_numpy().view(np.uint64), _one(part["w"]).to_numpy())
            found = _best_of_block(rows, held, n_docs, n_terms, items.schema[item_col], best, window)
            out = out.unionAll(found if blocks == 1 else materialize(found, "search-found"))
    order = Window.partitionBy(item_col).orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_first())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select(item_col, "rank", id_col, "score")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


#: The same by joins over all terms, without hashes, blocks or windows.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(words)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(words) > 0),
p AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
      FROM p JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""

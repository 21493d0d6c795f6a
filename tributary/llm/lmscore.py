"""Cross-entropy difference: how much more a text is like a target than like the other texts.

Two bigram models of words share one vocabulary: the words whose share of all tokens
is 1 / ``VOCABULARY`` or more (and that occur twice at least); all others are one
unknown word.  Words and marks are those of ``textbytes.tokens``: as written, marks
apart, characters of three or four bytes (Chinese, Japanese, Thai and the like,
written without blanks) each by itself.  The target model counts the target documents, the background model all
others, so they are disjoint, and every document counts.  They are matched: same
order, vocabulary and smoothing, and the counts of the larger are scaled to the
tokens of the smaller, which weighs against smoothing of a fixed strength as a
smaller corpus would.  A document is left out of its own model at every order, so
no text is scored by a model that has seen it.  The strength of smoothing, one for
both, is that of ``STRENGTHS`` under which the median text of each model, left out,
has the least loss (the median, as texts with copies are predicted by those whatever
the strength).

    p1(w)    = (s c(w) + ADDED) / (s N + ADDED V)
    p(w | h) = (s c(h w) + m p1(w)) / (s c(h) + m)

A document's score is the mean over its tokens (its words and its end) of background
loss minus target loss: higher is more like the target.

Counts of words and of word pairs are Spark aggregations, and grow with the corpus.
What is broadcast is bounded by arithmetic: at most ``VOCABULARY`` words can have
their share, and at most ``HEAVY`` pairs; the pairs of the heavy share are scored
while reading.  All others, none of which is frequent, meet their counts in a
shuffle join.  A pair counted once in all is in no other text, so left out it
counts as unseen, and needs no place in that join.

Defined cases: texts without words and null texts have no tokens, null losses and a
null score; if target or background have no tokens, all scores are 0; ids that repeat
in the labels are one; null ids are never in the target; repeated rows are texts of
their own and each get a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tally, map_arrow, materialize, release
from .textbytes import tokens

#: Bounds on the words and the word pairs that are broadcast.
VOCABULARY, HEAVY = 1 << 20, 1 << 20
#: Tokens added to each word, and the strengths of smoothing to choose from.
ADDED, STRENGTHS = 0.5, (256.0, 1024.0, 4096.0, 16384.0)
#: Ids of words that are not in the vocabulary, and of a text's edge; those of the vocabulary follow.
UNKNOWN, EDGE, FIRST = 0, 1, 2
_BITS = 21
#: The light pairs meet their counts in so many rounds, as a shuffle of all at once would take more disk than the texts.
ROUNDS = 4
#: Stands for the edge among hashes of words.
_EDGE_HASH = -1


def good_documents(labels: DataFrame, good: Column | None = None) -> DataFrame:
    """Ids of labelled documents that make the target: good quality and not toxic, unless told otherwise."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0) if good is None else good
    return labels.filter(good).select(F.col("doc_id").alias("id"))


def flagged(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and whether the document is in the target (by shuffle at every size: labels grow with the corpus)."""
    wanted = target.select(F.col("id").alias("__id")).filter("__id IS NOT NULL").distinct().withColumn("__in", F.lit(True))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.join(wanted.hint("shuffle_hash"), source["id"] == wanted["__id"], "left").select("id", F.coalesce("__in", F.lit(False)).alias("wanted"), "text")


def _by_model(flag: np.ndarray, n: np.ndarray | int = 1) -> np.ndarray:
    """Counts in two columns, target and background."""
    out = np.zeros((len(flag), 2), np.int64)
    out[:, 0] = np.where(flag, n, 0)
    out[:, 1] = np.where(flag, 0, n)
    return out


def _counted(source: DataFrame, parts, key: str) -> DataFrame:
    """(key, t, b): what ``parts`` gives for each batch, counted by task and then by key."""

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], [key, "t", "b"])

    def run(batches):
        tally = Tally(2)
        for batch in batches:
            for keys, flag in parts(batch):
                found, at = np.unique(keys, return_inverse=True)
                both = np.stack([np.bincount(at[own], minlength=len(found)) for own in (flag, ~flag)], 1)
                for done in tally.add(found, both):
                    yield rows(*done)
        for done in tally.rest():
            yield rows(*done)

    return map_arrow(source, run, f"{key} long, t long, b long").groupBy(key).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


@dataclass
class Vocabulary:
    """Words known by hash, and of each id the counts in target and background (pairs: the same by key)."""

    hashes: np.ndarray  # sorted; the id of hashes[i] is FIRST + i
    counts: np.ndarray  # 2 rows: of each id
    heavy: np.ndarray  # sorted keys of heavy pairs
    heavy_counts: np.ndarray  # 2 rows

    @property
    def tokens(self) -> np.ndarray:
        return self.counts.sum(1)

    @property
    def scale(self) -> np.ndarray:
        """What the counts of each model are multiplied by: the larger is brought to the smaller one's tokens."""
        n = self.tokens
        return n.min() / np.maximum(n, 1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.view(np.int64)
        if not len(self.hashes):
            return np.full(len(hashes), UNKNOWN)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + FIRST, UNKNOWN)


def word_counts(source: DataFrame) -> DataFrame:
    """(word, t, b): of every word, by hash, and of the edge: one for each text with words."""

    def parts(batch):
        flag = batch.column("wanted").to_numpy(zero_copy_only=False)
        for w in tokens(batch.column("text")):
            size = np.diff(w.of)
            own = flag[w.first : w.last]
            yield w.hashes().view(np.int64), np.repeat(own, size)
            yield np.full(int((size > 0).sum()), _EDGE_HASH, np.int64), own[size > 0]

    return _counted(source, parts, "word")


def vocabulary(words: DataFrame, limit: int = VOCABULARY) -> Vocabulary:
    total = words.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.sum(F.when(F.col("word") == _EDGE_HASH, F.col("t"))).alias("et"), F.sum(F.when(F.col("word") == _EDGE_HASH, F.col("b"))).alias("eb")).first()
    n = (total["t"] or 0) + (total["b"] or 0)
    least = max(2, math.ceil(n / limit))
    known = words.filter((F.col("word") != _EDGE_HASH) & (F.col("t") + F.col("b") >= least)).toArrow().sort_by("word")
    counts = np.zeros((2, FIRST + len(known)), np.int64)
    for m, name in enumerate(("t", "b")):
        counts[m, FIRST:] = known[name].to_numpy()
        counts[m, EDGE] = total[f"e{name}"] or 0
        counts[m, UNKNOWN] = (total[name] or 0) - counts[m].sum()
    return Vocabulary(known["word"].to_numpy().astype(np.int64), counts, np.zeros(0, np.int64), np.zeros((2, 0), np.int64))


def pairs(batch: pa.RecordBatch, known: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, of, key) for runs of texts: the pair of each token and the word before it, and the text it is of (from 0); a text's last token is its edge."""
    for w in tokens(batch.column("text")):
        ids = known.ids(w.hashes())
        size = np.diff(w.of)
        some = np.flatnonzero(size)
        n = size[some] + 1
        end = np.cumsum(n) - 1
        after = np.full(int(n.sum()), EDGE, np.int64)
        inner = np.ones(len(after), bool)
        inner[end] = False
        after[inner] = ids
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[:1] = EDGE
        yield w.first, w.last, np.repeat(some, n), (before << _BITS) | after


def pair_counts(source: DataFrame, shared) -> DataFrame:
    """(pair, t, b) of all pairs."""

    def parts(batch):
        flag = batch.column("wanted").to_numpy(zero_copy_only=False)
        for first, last, of, key in pairs(batch, shared.value):
            yield key, flag[first:last][of]

    return _counted(source, parts, "pair")


@dataclass
class Models:
    known: Vocabulary
    pairs: DataFrame  # pair, t, b of pairs that are not heavy, and the counts of their second word
    source: DataFrame
    written: list[DataFrame]


def count(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary_limit: int = VOCABULARY, heavy_limit: int = HEAVY) -> Models:
    """The counts of both models: of the documents whose id is in ``target`` (column id), and of all others."""
    spark = docs.sparkSession
    source = flagged(docs, target, id_col, text_col)
    words = materialize(word_counts(source), "lm-words")
    known = vocabulary(words, vocabulary_limit)
    release(spark, words)
    shared = spark.sparkContext.broadcast(known)
    found = materialize(pair_counts(source, shared).filter("t + b > 1"), "lm-pairs")
    least = max(2, math.ceil(int(known.tokens.sum()) / heavy_limit))
    heavy = found.filter(F.col("t") + F.col("b") >= least).toArrow().sort_by("pair")
    known = Vocabulary(known.hashes, known.counts, heavy["pair"].to_numpy().astype(np.int64), np.stack([heavy["t"].to_numpy(), heavy["b"].to_numpy()]))
    release(spark)
    return Models(known, found.filter(F.col("t") + F.col("b") < least), source, [found])


_SUMS = [f"{m}{k}" for m in ("t", "b") for k in range(len(STRENGTHS))]


def _single(known: Vocabulary, m: int, w: np.ndarray, left_w: np.ndarray, left_n: np.ndarray) -> np.ndarray:
    """p1 of words under model m, with a text's own counts left out."""
    s, n = known.scale[m], known.tokens[m]
    return (s * (known.counts[m][w] - left_w) + ADDED) / (s * (n - left_n) + ADDED * known.counts.shape[1])


def _first_sums(known: Vocabulary, of: np.ndarray, key: np.ndarray, flag: np.ndarray):
    """What reading alone tells of a run of texts.

    Tokens of each text, its losses (a column of each of ``_SUMS``) with light pairs
    as unseen, and of each light pair: text, key, times, times of its second word.
    """
    shift = np.uint64(2 * _BITS)
    both, n = np.unique((of.astype(np.uint64) << shift) | key.astype(np.uint64), return_counts=True)
    text = (both >> shift).astype(np.int64)
    pair = (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    h, w = pair >> _BITS, pair & ((1 << _BITS) - 1)
    # a word's own times as second of a pair are those as first: every token has one after it, the edge one before
    own, at = np.unique((text << _BITS) | w, return_inverse=True)
    times = np.bincount(at, n, len(own)).astype(np.int64) if len(own) else np.zeros(0, np.int64)
    own_w, own_h = times[at], times[np.searchsorted(own, (text << _BITS) | h)]
    size = np.bincount(text, n, len(flag)).astype(np.int64)
    if len(known.heavy):
        place = np.minimum(np.searchsorted(known.heavy, pair), len(known.heavy) - 1)
        is_heavy = known.heavy[place] == pair
    else:
        place, is_heavy = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
    sums = np.zeros((len(flag), len(_SUMS)))
    for m in (0, 1):
        inside = (flag if m == 0 else ~flag)[text]
        p1 = _single(known, m, w, own_w * inside, size[text] * inside)
        seen = np.where(is_heavy, known.heavy_counts[m][place] - n * inside, 0) if len(known.heavy) else np.zeros(len(pair))
        s = known.scale[m]
        base = s * (known.counts[m][h] - own_h * inside)
        for k, strength in enumerate(STRENGTHS):
            sums[:, m * len(STRENGTHS) + k] = np.bincount(text, -n * np.log((s * seen + strength * p1) / (base + strength)), len(flag))
    light = ~is_heavy
    return size, sums, (text[light], pair[light], n[light], own_w[light])


def _round(pair):
    """Which round a pair is dealt with in, for arrays and for columns."""
    if isinstance(pair, Column):
        return (F.shiftright(pair, _BITS) + pair).bitwiseAND(ROUNDS - 1)
    return ((pair >> _BITS) + pair) & (ROUNDS - 1)


def _read(models: Models) -> DataFrame:
    """One row per document: its number, id, flag, tokens, losses with light pairs as unseen, and its light pairs."""
    shared = models.source.sparkSession.sparkContext.broadcast(models.known)
    source = models.source.select(F.monotonically_increasing_id().alias("row"), "id", "wanted", "text")

    def run(batches):
        for batch in batches:
            flag = batch.column("wanted").to_numpy(zero_copy_only=False)
            for first, last, of, key in pairs(batch, shared.value):
                size, sums, (text, pair, n, own) = _first_sums(shared.value, of, key, flag[first:last])
                part = batch.slice(first, last - first)
                columns = [*(part.column(c) for c in ("row", "id", "wanted")), pa.array(size), *(pa.array(c) for c in sums.T)]
                in_round = _round(pair)
                for r in range(ROUNDS):
                    own_r = in_round == r
                    offsets = pa.array(np.searchsorted(text[own_r], np.arange(last - first + 1)), pa.int32())
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(v[own_r], kind)) for v, kind in ((pair, pa.int64()), (n, pa.int32()), (own, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("row", T.LongType()), source.schema["id"], T.StructField("wanted", T.BooleanType()), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in _SUMS)]
    for r in range(ROUNDS):
        fields += [T.StructField(f"{c}{r}", T.ArrayType(kind)) for c, kind in (("pair", T.LongType()), ("n", T.IntegerType()), ("own", T.IntegerType()))]
    names = [f.name for f in fields]
    return map_arrow(source, run, T.StructType(fields))


def _seen_gains(rows: DataFrame, models: Models, r: int) -> DataFrame:
    """(row, what each of ``_SUMS`` falls by): light pairs of a round that other texts hold, met by key."""
    spark, known = rows.sparkSession, models.known
    light = rows.select("row", "wanted", "n_tokens", F.explode(F.arrays_zip(F.col(f"pair{r}").alias("pair"), F.col(f"n{r}").alias("n"), F.col(f"own{r}").alias("own"))).alias("e"))
    light = light.select("row", "wanted", "n_tokens", "e.pair", "e.n", "e.own")
    ids = pa.table({"w": np.arange(known.counts.shape[1]), "wt": known.counts[0], "wb": known.counts[1]})
    word = F.col("pair").bitwiseAND((1 << _BITS) - 1)
    # the vocabulary, bounded by its share of the tokens, brings the counts of second words
    table = models.pairs.filter(_round(F.col("pair")) == r).withColumn("w", word).join(F.broadcast(spark.createDataFrame(ids)), "w").drop("w")
    both = light.join(table, "pair")
    gains = []
    for m, name in enumerate(("t", "b")):
        inside = F.when(F.col("wanted") == (m == 0), 1).otherwise(0)
        s, total = float(known.scale[m]), float(known.tokens[m])
        p1 = (s * (F.col(f"w{name}") - F.col("own") * inside) + ADDED) / (s * (total - F.col("n_tokens") * inside) + ADDED * known.counts.shape[1])
        seen = s * (F.col(name) - F.col("n") * inside)
        both = both.withColumn(f"r{name}", seen / p1)
        gains += [F.sum(F.when(F.col(f"r{name}") > 0, F.col("n") * F.log1p(F.col(f"r{name}") / strength))).alias(f"g{name}{k}") for k, strength in enumerate(STRENGTHS)]
    return both.groupBy("row").agg(*gains)


def score(models: Models, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document: n_tokens, ce_target, ce_background (nats a token) and score, their difference."""
    spark = models.source.sparkSession
    rows = materialize(_read(models), "lm-rows")
    release(spark)
    parts = []
    for r in range(ROUNDS):
        parts.append(materialize(_seen_gains(rows, models, r), "lm-gains"))
        release(spark)
    gains = reduce(DataFrame.union, parts).groupBy(F.col("row").alias("__row")).agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in _SUMS])
    sums = rows.select("row", "id", "wanted", "n_tokens", *_SUMS).join(gains, F.col("row") == F.col("__row"), "left")
    sums = materialize(sums.select("id", "wanted", "n_tokens", *[(F.col(c) - F.coalesce(f"g{c}", F.lit(0.0))).alias(c) for c in _SUMS]), "lm-sums")
    release(spark, rows, *parts, *models.written)
    typical = sums.filter("n_tokens > 0").groupBy("wanted").agg(*[F.percentile_approx(F.col(c) / F.col("n_tokens"), 0.5, 10000).alias(c) for c in _SUMS]).collect()
    best = min(range(len(STRENGTHS)), key=lambda k: sum(r[f"{'t' if r['wanted'] else 'b'}{k}"] for r in typical))
    ce = {name: F.when(F.col("n_tokens") > 0, F.col(f"{name}{best}") / F.col("n_tokens")) for name in ("t", "b")}
    if not models.known.tokens.all():  # one model has no tokens: nothing to compare
        ce["t" if models.known.tokens[1] else "b"] = ce["b" if models.known.tokens[1] else "t"]
    return sums.select(F.col("id").alias(id_col), "n_tokens", ce["t"].alias("ce_target"), ce["b"].alias("ce_background"), (ce["b"] - ce["t"]).alias("score"))

"""Near-duplicate documents by improved consistent weighted sampling.

A document is its weighted set of shingles: five consecutive words each, weighing
term frequency times inverse document frequency.  Document frequencies are counted
over all documents.  Only shingles with 1 / ``HEAVY`` of all (document, shingle) pairs
or more, of which there can be ``HEAVY`` at most, are told apart and broadcast; all
others count as having just that share.  The inverse frequency runs from one for those
down to ``DAMPED`` for a shingle of every document: undamped, a text that fills much of
a corpus with near copies would weigh next to nothing in them, and their few edits
would outweigh all they share.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each set;
two sets agree in a sample with the probability of their weighted Jaccard
similarity.  Documents that agree in all samples of a band meet in a group.

* A group of at most ``SMALL`` documents compares all its pairs.
* In a larger one each member meets a few centres: the least document, the one whose
  groups are the largest (what others were copied from), and one drawn anew in each
  band.  Pairs grow in proportion.
* Pairs are verified by the weighted Jaccard similarity of the whole texts: first each
  document with the partner it meets most often; then, after links are joined into
  components, all pairs that still stand between two components.
* A large group that still holds several components (filled-in forms, texts about one
  long passage) may hide copies in the crowd.  Its documents go on to an exact join: with
  shingles ordered from rare to frequent, two sets of similarity t share one among those
  that make up 1 - t or less of either's weight, and at the first they share, the weight
  from there on bounds what the two have in common.  All pairs within that bound that
  lie in two components are candidates, whatever the size of a shingle's group, and are
  verified as above.  So no two documents of a group are left apart that should be linked.

Equal texts are folded beforehand.

Defined cases: null texts are alone; texts without words equal only equal texts;
texts of fewer than five words are one shingle; ids that repeat with other texts
are told apart by text; the class id is the least id in it (null ids first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tally, map_arrow, materialize, release
from .components import connected_components
from .decontaminate import window_hashes
from .textbytes import Words, mix, segment_sums, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 2
#: Bound on the shingles whose document frequency is broadcast, and the places that find them.
HEAVY, PLACES = 1 << 14, 1 << 18
#: Weight of a shingle that every document has.
DAMPED = 0.75
#: Groups up to this size compare all their pairs; larger ones draw this many centres in each band.
SMALL, CENTRES = 8, 1
#: Members of a shingle's group that one task pairs with the whole group.
BLOCK = 4096
#: Room for rounding in bounds by weight.
SLACK = 1 + 1e-6
#: Bits of a shingle's hash.
_HASH_BITS = 44


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


@dataclass
class Weights:
    """Inverse document frequencies: ``weight`` of the heavy shingles ``hashes`` (sorted), one of all others."""

    hashes: np.ndarray
    weight: np.ndarray

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(shingle), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, shingle), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingle, self.weight[at], np.float32(1))


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, times, of): the distinct shingles of each text and how often it has them; those of text i are of[i]:of[i + 1]."""
    n_texts = w.last - w.first
    hashes = w.hashes()
    length = np.diff(w.of)
    owner, shingle = [], []
    for n in range(1, SHINGLE + 1):
        h = window_hashes(hashes, n)
        if n < SHINGLE:
            texts = np.flatnonzero(length == n)
            at = w.of[texts]
        else:
            text_of = np.repeat(np.arange(n_texts), length)
            at = np.arange(len(h))
            at = at[text_of[: len(h)] == text_of[n - 1 :]] if len(h) else at
            texts = text_of[at]
        owner.append(texts)
        shingle.append(h[at])
    owner, shingle = np.concatenate(owner), np.concatenate(shingle) >> np.uint64(64 - _HASH_BITS)
    key, times = np.unique((owner.astype(np.uint64) << np.uint64(_HASH_BITS)) | shingle, return_counts=True)
    found = key & np.uint64((1 << _HASH_BITS) - 1)
    return found, times, np.searchsorted(key >> np.uint64(_HASH_BITS), np.arange(n_texts + 1))


def shingle_sets(w: Words, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, of): as ``shingles``, with weights."""
    found, times, of = shingles(w)
    return found, weights.of(found) * times, of


def shingle_weights(docs: DataFrame, text_col: str = "text", heavy: int = HEAVY) -> Weights:
    """Weights from the document frequencies of all shingles.

    A first reading counts shingles in hashed places; only shingles of places that
    hold the share of a heavy one are then counted one by one.
    """
    source = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    shift = np.uint64(_HASH_BITS - (PLACES - 1).bit_length())

    def places(batches):
        total = np.zeros(PLACES, np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for w in words(batch.column("text")):
                total += np.bincount((shingles(w)[0] >> shift).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["place", "n"])

    found = map_arrow(source, places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = found["place"].to_numpy(), found["n"].to_numpy()
    texts, all_ = int(n[place < 0].sum()), int(n[place >= 0].sum())
    least = max(1, math.ceil(all_ / heavy))
    if texts <= least:
        return Weights(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    maybe = np.zeros(PLACES, bool)
    maybe[place[(place >= 0) & (n >= least)]] = True
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def exact(batches):
        tally = Tally(1)
        for batch in batches:
            for w in words(batch.column("text")):
                s = shingles(w)[0]
                s = s[shared.value[(s >> shift).astype(np.int64)]]
                for keys, counts in tally.add(*(x.astype(np.int64) for x in np.unique(s, return_counts=True))):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["s", "n"])
        for keys, counts in tally.rest():
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["s", "n"])

    counted = map_arrow(source, exact, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow().sort_by("s")
    n = counted["n"].to_numpy()
    weight = DAMPED + (1 - DAMPED) * np.log(texts / n) / math.log(texts / least)
    return Weights(counted["s"].to_numpy().astype(np.uint64), weight.astype(np.float32))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of Gamma(2, 1), log Gamma(2, 1) and a uniform share at 2**16 even quantiles.

    The quantiles x solve 1 - (1 + x) exp(-x) = q, by bisection.
    """
    q = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(q), np.full_like(q, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < q
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32), q.astype(np.float32)


GAMMA, LOG_GAMMA, SHARE = _tables()


def samples(shingle: np.ndarray, weight: np.ndarray, of: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` consistent weighted samples (64-bit values) of each non-empty set, one row per set; empty sets get zeros."""
    out = np.zeros((len(of) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(of))
    if not len(full):
        return out
    starts = of[full]
    log_w = np.log(weight).astype(np.float32)
    place = np.arange(len(shingle), dtype=np.uint64)
    for k in range(count):
        z = mix(shingle ^ np.uint64((seed * 1000003 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = GAMMA[z & np.uint64(0xFFFF)]
        share = SHARE[(z >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(log_w / r + share)
        log_a = LOG_GAMMA[(z >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - share) - r
        bits = log_a.view(np.int32)
        rank = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
        best = np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)
        at = best.astype(np.int64)
        out[full, k] = mix(shingle[at] * np.uint64(0xA24BAED4963EE407) + t[at].astype(np.int64).astype(np.uint64))
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of ``rows`` samples."""
    out = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(values), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + values[:, b * rows + r])
        out[:, b] = h
    return out


def sketches(docs: DataFrame, weights, *, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, two hashes of the text and its band keys (empty for texts without words)."""
    source = docs.select(F.col(id_col).alias("id"), *text_keys(F.col(text_col)), F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def run(batches):
        for batch in batches:
            keys: list[list[int]] = []
            for w in words(batch.column("text")):
                shingle, weight, of = shingle_sets(w, weights.value)
                found = band_keys(samples(shingle, weight, of, bands * rows), bands, rows).view(np.int64)
                keys += [row.tolist() if n else [] for row, n in zip(found, np.diff(of), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array(keys, pa.list_(pa.int64()))], ["id", "t1", "t2", "keys"])

    return map_arrow(source, run, T.StructType([source.schema["id"], T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of small groups, members of large groups): key, v, and for large ones ``pop``, the summed sizes of the groups v is in."""
    met = nodes.select("v", F.explode("keys").alias("key"))
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
    shared = materialize(sizes.filter("a < z").select("key", "n"), "near-keys")
    members = materialize(met.join(shared, "key"), "near-members")
    release(nodes.sparkSession, shared)
    large = members.filter(F.col("n") > SMALL)
    pop = members.groupBy("v").agg(F.sum("n").alias("pop"))
    wide = materialize(large.join(pop, "v").select("key", "v", "pop"), "near-large")
    small = materialize(members.filter(F.col("n") <= SMALL).select("key", "v"), "near-small")
    release(nodes.sparkSession, members)
    return small, wide


def candidate_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b, times): all pairs of small groups, members and centres of large ones; a below b, and in how many groups they met."""
    each = small.groupBy("key").agg(F.collect_list("v").alias("vs"))
    near = each.select(F.explode("vs").alias("a"), "vs").select("a", F.explode("vs").alias("b")).filter("a < b")
    drawn = [F.min(F.struct(F.xxhash64("key", "v", F.lit(c)).alias("h"), "v"))["v"].alias(f"c{c}") for c in range(CENTRES)]
    plain = F.max_by("v", F.struct("pop", -F.col("v")))
    centres = large.groupBy("key").agg(F.min("v").alias("least"), plain.alias("plain"), *drawn)
    centres = centres.select("key", F.array_distinct(F.array("least", "plain", *(f"c{c}" for c in range(CENTRES)))).alias("centres"))
    far = large.join(centres, "key").select("v", F.explode("centres").alias("c")).filter("v <> c")
    return near.union(far.select(F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("times"))


def similarity(left: pa.Array, right: pa.Array, weights: Weights) -> Iterator[float]:
    """Weighted Jaccard similarity of the texts of two columns, row by row."""
    sets: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for column in (left, right):
        own = []
        for w in words(column):
            shingle, weight, of = shingle_sets(w, weights)
            own += [(shingle[a:b], weight[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
        sets.append(own)
    for (s, v), (t, u) in zip(*sets, strict=True):
        _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
        both = float(np.minimum(v[i], u[j]).sum())
        whole = float(v.sum() + u.sum()) - both
        yield both / whole if whole else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts reach the threshold."""
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("right"))
    # by shuffle at every size: pairs and texts both grow with the corpus
    both = pairs.select("a", "b").hint("merge").join(left, "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            ok = [s >= threshold for s in similarity(batch.column("left"), batch.column("right"), weights.value)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(map_arrow(both, run, "a long, b long"), "near-links")


def crowded(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, v, label) of the members of large groups that hold several components."""
    named = large.join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))
    open_ = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a < z").select("key")
    return named.join(open_, "key", "left_semi")


def prefix_pairs(crowd: DataFrame, texts: DataFrame, weights, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, times): all pairs of ``crowd`` (key, v, label) in two components that may reach the threshold,
    and how many shingles of both their prefixes they share.

    A prefix is a document's rarest shingles, as long as those before weigh 1 - ``threshold`` of it or less.
    Where two documents share their first shingle, they have in common at most what either weighs from
    there on, so ``most`` is the weight up to which a partner's can be.  Large groups are dealt in blocks.
    """
    docs = crowd.select("v", "label").distinct()

    def run(batches):
        for batch in batches:
            for w in words(batch.column("text")):
                s, weight, of = shingle_sets(w, weights.value)
                total = segment_sums(weight.astype(np.float64), of)
                row = np.repeat(np.arange(w.first, w.last), np.diff(of))
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(row)), pa.array(s.astype(np.int64)), pa.array(weight.astype(np.float64)), pa.array(total[row - w.first])], ["v", "s", "w", "total"])

    sets = map_arrow(texts.join(docs.select("v"), "v", "left_semi"), run, "v long, s long, w double, total double")
    sets = materialize(sets, "near-sets")
    held = sets.groupBy("s").agg(F.count("*").alias("df"))
    before = F.sum("w").over(Window.partitionBy("v").orderBy("df", "s")) - F.col("w")
    ranked = sets.join(held, "s").withColumn("before", before)
    ranked = ranked.filter((F.col("df") > 1) & (F.col("before") <= F.col("total") * (1 - threshold) * SLACK))
    most = ((F.col("total") - F.col("before")) * (1 + threshold) / threshold - F.col("total")) * SLACK
    keys = materialize(ranked.select("v", "s", "total", most.alias("most")).join(docs, "v"), "near-prefixes")
    release(crowd.sparkSession, sets)

    group = keys.groupBy("s").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    keys_ = keys.join(group.select("s", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "s")
    # the lighter of two has the shingle among fewer: its partner weighs as much as itself at least
    light = keys_.filter("most >= total").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).alias("p")
    heavy = keys_.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("q")
    near = F.expr("p.s = q.s AND p.block = q.block AND p.label <> q.label AND p.most >= q.total AND q.most >= p.total AND (p.total < q.total OR p.total = q.total AND p.v < q.v)")
    pairs = light.join(heavy, near).select(F.least("p.v", "q.v").alias("a"), F.greatest("p.v", "q.v").alias("b"))
    out = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("times")), "near-prefix")
    release(crowd.sparkSession, keys)
    return out


def linked(pairs: DataFrame, texts: DataFrame, weights, threshold: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) among ``pairs`` (a, b, times): first each document's with the partner it meets most often,
    then, once those and the ``known`` links are joined, of all pairs that still lie in two components."""
    best = F.max(F.struct(F.col("times").alias("times"), (-F.col("a")).alias("minus")))
    first = pairs.groupBy("b").agg(best.alias("m")).select((-F.col("m.minus")).alias("a"), "b")
    one = verified(first, texts, weights, threshold)
    labels = connected_components(one if known is None else known.union(one))
    at = {side: labels.select(F.col("v").alias(side), F.col("label").alias(f"of_{side}")) for side in ("a", "b")}
    open_ = pairs.join(at["a"], "a", "left").join(at["b"], "b", "left")
    open_ = open_.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    open_ = materialize(open_, "near-open")
    two = verified(open_, texts, weights, threshold)
    release(pairs.sparkSession, labels, open_, pairs)
    return one, two


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, t1, t2, class_id, class_t1, class_t2, links) of every row with a text; class_* name the class's first document, links counts the texts found alike."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(shingle_weights(docs, text_col))
    all_rows = materialize(sketches(docs, weights, id_col=id_col, text_col=text_col, bands=bands, rows=rows), "near-sketches")
    distinct = materialize(all_rows.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "near-distinct")
    order = ["rep", "t1", "t2"]
    nodes = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("v"), *order, "keys"), "near-nodes")
    release(spark, distinct)
    small, large = groups(nodes)
    pairs = materialize(candidate_pairs(small, large), "near-pairs")
    release(spark, small)

    part = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    part = materialize(nodes.join(part, "v", "left_semi").select("v", *order), "near-part")
    named = docs.select(F.col(id_col).alias("rep"), *text_keys(F.col(text_col)), F.col(text_col).alias("text"))
    same = named["rep"].eqNullSafe(part["rep"]) & (named["t1"] == part["t1"]) & (named["t2"] == part["t2"])
    texts = materialize(named.join(part.hint("shuffle_hash"), same).select("v", "text").dropDuplicates(["v"]), "near-texts")
    release(spark, part)

    one, two = linked(pairs, texts, weights, threshold)
    found = one.union(two)
    labels = connected_components(found)
    crowd = materialize(crowded(large, labels), "near-crowd")
    release(spark, labels, large)
    hidden = prefix_pairs(crowd, texts, weights, threshold)
    release(spark, crowd)
    three, four = linked(hidden, texts, weights, threshold, found)
    release(spark, texts)
    links = found.union(three).union(four)
    labels = connected_components(links)

    tops = labels.join(nodes.select(F.col("v").alias("label"), F.col("rep").alias("class_id"), F.col("t1").alias("class_t1"), F.col("t2").alias("class_t2")), "label").drop("label")
    count = links.distinct().select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("links"))
    named = nodes.select("v", *order).join(tops.join(count, "v"), "v", "left")
    names = [F.when(F.col("class_t1").isNull(), F.col(own)).otherwise(F.col(c)).alias(c) for own, c in (("rep", "class_id"), ("t1", "class_t1"), ("t2", "class_t2"))]
    named = materialize(named.select("t1", "t2", *names, F.coalesce("links", F.lit(0)).cast("long").alias("links")), "near-classes")
    release(spark, labels, nodes, one, two, three, four)
    return all_rows.select("id", "t1", "t2").join(named, ["t1", "t2"]).select("id", "t1", "t2", "class_id", "class_t1", "class_t2", "links")


def class_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its class_id, whether it is the document that stays, and the links found to other texts."""
    found = classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("t1") == F.col("class_t1")) & (F.col("t2") == F.col("class_t2"))
    out = found.select(F.col("id").alias(id_col), "class_id", first.alias("stays"), "links")
    alone = docs.filter(F.col(text_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(True).alias("stays"), F.lit(0).cast("long").alias("links"))
    return out.unionByName(alone)


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class (that of least id); rows with null text stay."""
    found = classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    first = found.select(F.col("class_id").alias("__id"), F.col("class_t1").alias("__t1"), F.col("class_t2").alias("__t2")).distinct()
    t1, t2 = text_keys(F.col(text_col))
    own = docs.filter(F.col(text_col).isNotNull()).withColumns({"__k1": t1, "__k2": t2})
    kept = own.join(first, own[id_col].eqNullSafe(first["__id"]) & (own["__k1"] == first["__t1"]) & (own["__k2"] == first["__t2"])).dropDuplicates([id_col, "__k1", "__k2"])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(text_col).isNull()))

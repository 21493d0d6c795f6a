"""Language identification by hierarchical discrimination.

A linear support vector machine per family (one against the rest) decides the
language family; inside the family, one-versus-one linear support vector
machines separate its languages by majority of votes, then by margin.  All read
the same features: frequencies of byte 2-, 3- and 4-grams of the whole
lower-cased text, hashed to ``DIMS`` places, square-rooted (so every text has
length one).  Training fits a bounded sample of labelled texts (``PER_LANGUAGE``
for each language, or all its distinct texts, drawn by the hash of the text);
prediction is one pass over the texts without a shuffle.

The machines always choose one of the learned languages, so whether a text is of any
of them is decided apart (``reject``): its likelihood under each language's mean
frequencies, over that of even frequencies, must not lie further below the usual
than ``SLACK`` times what texts of that language do that the mean has not seen.

Defined cases: null text or a text without a letter gives ``und`` with score 0;
one learned language is given to every text with letters; none learned gives
``und``.  Equal texts get equal results, whatever their other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow
from .textbytes import chunks, separated, text_buffer

DIMS = 1 << 13
#: Bound on the sample: labelled texts of each language.
PER_LANGUAGE = 400
UNKNOWN = "und"
#: A text is of a language if it is at most this many times further from the usual than the learned ones.
SLACK = 8.0
#: Even part of a language's frequencies, so that n-grams it hasn't shown cost a bounded amount.
EVEN = 0.1
#: Letters' worth of doubt: a text of this many n-grams may lie 1.4 times as far off as a very long one.
DOUBT = 64

# Language families of ISO 639-1 codes.  A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "ar am he mt",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg mi ms tl",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


# Every byte that is no letter of ASCII and no part of a longer character becomes a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(column: pa.Array):
    """(first, last, matrix, sizes) for runs of texts: their feature rows, and their numbers of n-grams."""
    raw, offsets = text_buffer(column)
    for i, j in chunks(offsets):
        for a in range(i, j, 256):
            b = min(a + 256, j)
            data, bounds = separated(raw, offsets, a, b)
            data = _FOLD[data]
            # capitals of the Latin-1 block are two bytes, the second 32 below that of the small letter
            upper = np.flatnonzero(data[:-1] == 0xC3) + 1
            upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E) & (data[upper] != 0x97)]
            data[upper] += 32
            d = data.astype(np.uint32)
            text_of = np.repeat(np.arange(b - a), np.diff(bounds))
            left = bounds[1:][text_of] - np.arange(len(data))
            counts = np.zeros((b - a) * DIMS, np.float32)
            code = d.copy()
            for n in (2, 3, 4):
                code = code[:-1] * np.uint32(257) + d[n - 1 :]
                at = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(19)
                ok = left[: len(code)] >= n
                counts += np.bincount((text_of[: len(code)] * DIMS + at)[ok], minlength=len(counts))
            rows = counts.reshape(b - a, DIMS)
            total = rows.sum(1, keepdims=True)
            yield a, b, np.sqrt(rows / np.maximum(total, 1)), total[:, 0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]  # languages of each family
    pairs: list[tuple[int, int, int]]  # family, and the two places in members
    weights: np.ndarray  # DIMS + 1 rows; families first, then pairs
    profiles: np.ndarray | None = None  # DIMS rows; of each language, the gain of an n-gram over even frequencies
    usual: np.ndarray | None = None  # of each language, the mean gain of its texts
    limit: np.ndarray | None = None  # of each language, how far below that a text may lie

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        if not self.families:
            return [(UNKNOWN, 0.0)] * len(x)
        m = x @ self.weights[:-1] + self.weights[-1]
        nf = len(self.families)
        top = m[:, :nf].argmax(1)
        out = []
        for row, f in zip(m, top.tolist(), strict=True):
            best = np.sort(row[:nf])
            score = _sure(best[-1] - best[-2]) if nf > 1 else 1.0
            langs = self.members[f]
            votes = np.zeros(len(langs))
            margins = np.zeros(len(langs))
            least = np.full(len(langs), np.inf)
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    v = row[nf + k]
                    votes[a if v > 0 else b] += 1
                    for at, s in ((a, v), (b, -v)):
                        margins[at] += s
                        least[at] = min(least[at], s)
            at = max(range(len(langs)), key=lambda i: (votes[i], margins[i], -i))
            if len(langs) > 1:
                score *= _sure(2 * least[at])
            out.append((langs[at], float(min(max(score, 0.0), 1.0))))
        return out


    def typical(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each text, of so many n-grams, is of one of the learned languages."""
        if self.profiles is None:
            return np.ones(len(x), bool)
        return (_distance((x * x) @ self.profiles, self.usual, sizes) <= self.limit).any(1)


def _distance(gain: np.ndarray, usual: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far each text's gain lies below the usual, short texts with more room."""
    return (usual - gain) / np.sqrt(1 + DOUBT / np.maximum(sizes, 1))[:, None]


def _profile(f: np.ndarray) -> np.ndarray:
    return np.log((1 - EVEN) * f.mean(0) * DIMS + EVEN)


def _profiles(of: list[str], x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Profiles, usual gains and limits of the languages, each text judged by the half it is not in.

    The limit comes from the 0.95 quantile, as labelled texts hold some junk.  A language of
    fewer than eight texts tells nothing about its own spread and takes every text.
    """
    profiles, usual, limit = [], [], []
    for lang in sorted(set(of)):
        own = [i for i, a in enumerate(of) if a == lang]
        f = x[own, :-1] ** 2
        n = sizes[own]
        profiles.append(_profile(f))
        if len(own) < 8:
            usual.append(0.0)
            limit.append(np.inf)
            continue
        gain = np.empty(len(own))
        for k in (0, 1):
            gain[k::2] = f[k::2] @ _profile(f[1 - k :: 2])
        usual.append(float(np.median(gain)))
        limit.append(SLACK * max(0.0, float(np.quantile(_distance(gain[:, None], np.array(usual[-1:]), n), 0.95))))
    return np.stack(profiles, 1).astype(np.float32), np.array(usual), np.array(limit)


def _sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * margin)))


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> np.ndarray:
    """Linear machines with squared hinge loss, one column of y (+1, -1, or 0 for rows
    that don't count) each, by accelerated gradient descent; classes weigh the same.
    The last column of x is 1."""
    weight = np.zeros_like(y)
    for k in range(y.shape[1]):
        for s in (-1, 1):
            own = y[:, k] == s
            weight[own, k] = 0.5 / max(1, own.sum())
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    before, rate = w, np.float32(0.25)
    for t in range(steps):
        look = w + np.float32(t / (t + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ look)) * weight
        gradient = x.T @ (-2 * y * slack) + np.float32(penalty) * look
        before, w = w, look - rate * gradient
    return w


def train(of: list[str], x: np.ndarray, sizes: np.ndarray) -> Model:
    """A model from languages and their texts' features, with a last column of ones, and numbers of n-grams."""
    langs = sorted(set(of))
    families = sorted({family_of(x) for x in langs})
    members = [[x for x in langs if family_of(x) == f] for f in families]
    pairs = [(f, a, b) for f, own in enumerate(members) for a in range(len(own)) for b in range(a + 1, len(own))]
    if not of:
        return Model([], [], [], np.zeros((DIMS + 1, 0), np.float32))
    y = np.zeros((len(of), len(families) + len(pairs)), np.float32)
    for i, lang in enumerate(of):
        f = families.index(family_of(lang))
        y[i, : len(families)] = -1
        y[i, f] = 1
        for k, (g, a, b) in enumerate(pairs):
            if g == f and lang in (members[f][a], members[f][b]):
                y[i, len(families) + k] = 1 if lang == members[f][a] else -1
    return Model(families, members, pairs, _svm(x, y), *_profiles(of, x, sizes))


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the labelled rows of ``docs`` (null labels and texts don't count)."""
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # distinct texts, as copies may be most of a language's rows: 1.5 times the bound of them is drawn, or all there are
    counts = {r["lang"]: r["n"] for r in own.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], np.zeros((0, DIMS + 1), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * per_language / n))])
    drawn = own.filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def vectors(batches):
        for batch in batches:
            for a, b, x, sizes in features(batch.column("text")):
                own = batch.slice(a, b - a)
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("h"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(sizes, pa.float32())], ["lang", "h", "x", "size"])

    found = map_arrow(drawn, vectors, "lang string, h long, x binary, size float").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    langs, taken = found["lang"].to_pylist(), []
    for i, lang in enumerate(langs):
        if i < per_language or langs[i - per_language] != lang:
            taken.append(i)
    x = np.ones((len(taken), DIMS + 1), np.float32)
    for row, i in enumerate(taken):
        x[row, :-1] = np.frombuffer(found["x"][i].as_py(), np.float16)
    return train([langs[i] for i in taken], x, found["size"].to_numpy()[taken])


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            found: list[tuple[str, float]] = []
            for _, _, x, _ in features(texts):
                found += shared.value.predict(x)
            sure = [f if has_letter(t.as_py()) else (UNKNOWN, 0.0) for f, t in zip(found, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f[0] for f in sure], pa.string()), pa.array([f[1] for f in sure], pa.float64())], [*keep, "lang_pred", "score"])

    return map_arrow(source, run, T.StructType([*(source.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.0, learned_only: bool = False) -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``, or a score below ``min_score``)
    and, if ``learned_only``, those that are of no learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            keep: list[bool] = []
            for _, _, x, sizes in features(texts):
                own = shared.value.typical(x, sizes) if learned_only else np.ones(len(x), bool)
                keep += [k and lang != UNKNOWN and score >= min_score for k, (lang, score) in zip(own.tolist(), shared.value.predict(x), strict=True)]
            yield batch.filter(pa.array([k and has_letter(t.as_py()) for k, t in zip(keep, texts, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2

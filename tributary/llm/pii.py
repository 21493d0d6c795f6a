"""Personal data in texts: fixed patterns, and a character tagger for other spellings.

Base spans are those of the patterns (e-mail and IP addresses, card and phone
numbers) with their tests.  The tagger, a bidirectional LSTM with CRF transitions
trained here from labelled spans (``examples`` writes them), reads overlapping
windows of the whole text; each window is decoded on its own, and a span cut by a
window's edge that no other window holds whole is decoded again in a wider window,
until it stands whole, so a span may be of any length.  The spans of all windows of a
text are reconciled globally: of those that overlap, the set with the largest total
score stays.  Tagger spans must pass the test of their kind and may
not touch a base span of it, so base spans always stay.

Every span that passes its test (``plausible``) holds a digit, an @ or an at in
brackets.  Windows without one can give nothing and are not decoded; no
part of a text is left out.  The patterns take time in proportion to the text,
whatever runs of digits or letters it holds.

Defined cases: null counts as empty; positions are code points; repeated rows get
equal results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow
from .tagger import KINDS, PADDING, Weights, decode, symbols, train

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The part of EMAIL after the @, and IP from the start of a run of digits: a match that
#: fails there fails further into the run too, so each run is read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP_AT_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
WIDTH, STRIDE = 96, 48
#: A span this near to a window's edge may go on beyond it (`` dot org``), so it counts as cut.
EDGE = 8

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL: for each @, the longest run before it that no match has taken, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            # the run up to the @, read backwards
            back = text[done:at][::-1]
            start = at - _LOCAL_END.match(back).end()
            if start < at:
                yield start, domain.end()
                done = domain.end()
                at = text.find("@", done)
                continue
        done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, kind by kind, those that fail their test left out."""
    out: list[Span] = [(0, *s) for s in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(1, *m.span()) for m in _IP_AT_RUN.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def plausible(kind: int, text: str) -> bool:
    """The test of a kind for a span in another spelling."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s*+(@|[(\[]at[)\]])\s*+[A-Za-z0-9]", text) and re.search(r"\.|\bdot\b", text))
    if kind == 1:
        parts = [p for p in _NOT_DIGIT.split(text) if p]
        return len(parts) == 4 and all(map(_small, parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(text)


# ---- labelled spans to learn from

_SYLLABLES = "an be ca do en fi ga ho in ju ka lo ma ne on pa que re sa ti un vi wo xi ya zu".split()


def _word(rng) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.integers(1, 4)))


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _example(rng, kind: int) -> str:
    if kind == 0:
        at = rng.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] "])
        dot = rng.choice([".", " . ", " dot "]) if at != "@" else rng.choice([".", " dot ", " . "])
        return f"{_word(rng)}{rng.choice(['', '.', '_'])}{_word(rng)}{at}{_word(rng)}{dot}{rng.choice(['com', 'org', 'net', 'io', 'example'])}"
    if kind == 1:
        sep = rng.choice([".", " . ", "[.]", " dot "])
        return sep.join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        sep = rng.choice(["", " ", "-", ".", "/", "_"])
        d = _digits(rng, 16)
        return sep.join((d[:4], d[4:8], d[8:12], d[12:]))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"00{a[:2]} {b} {c}{a[:1]}", f"+{a[:2]} {b} {c}", f"+{a[:2]}/{b}/{c}"]))


def _clean(rng) -> str:
    """Text with digits or marks that is no personal data."""
    k = rng.integers(0, 9)
    d = _digits(rng, 9)
    hexes = "".join(rng.choice(list("0123456789abcdef"), 24))
    return [f"{rng.integers(1900, 2100)}-{d[:2]}-{d[2:4]}", f"{d[:2]}:{d[2:4]}", f"${d[:3]}.{d[3:5]}", f"v{d[0]}.{d[1]}.{d[2]}", hexes, f"no. {d[:5]}", f"{d[:4]} - {d[4:8]}", f"@{_word(rng)}", f"{d[:2]}%"][k]


def examples(count: int = 4800, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented text as symbols, and their tags from the spans put in."""
    rng = np.random.default_rng(seed)
    x, y = np.full((count, WIDTH), PADDING, np.int64), np.zeros((count, WIDTH), np.int64)
    for row in range(count):
        text, tags = "", []
        while len(text) < WIDTH + 60:
            r = rng.random()
            kind = int(rng.integers(0, len(KINDS)))
            piece = _example(rng, kind) if r < 0.10 else _clean(rng) if r < 0.17 else _word(rng)
            if r >= 0.17 and rng.random() < 0.1:
                piece = piece.upper() if rng.random() < 0.5 else piece.capitalize()
            own = [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if r < 0.10 else [0] * len(piece)
            tail = str(rng.choice([" ", " ", " ", ", ", ". ", "\n", "### ", "!! "]))
            text, tags = text + piece + tail, tags + own + [0] * len(tail)
        shift = int(rng.integers(0, 60))
        while tags[shift] and tags[shift] % 2 == 0:
            shift += 1
        text, tags = text[shift : shift + WIDTH], tags[shift : shift + WIDTH]
        if rng.random() < 0.1:
            n = int(rng.integers(10, WIDTH))
            text, tags = text[:n], tags[:n]
        x[row, : len(text)] = symbols(np.array([ord(c) for c in text]))
        y[row, : len(tags)] = tags
    return x, y


@lru_cache(1)
def weights() -> Weights:
    """The trained tagger; training takes some seconds once per driver."""
    return train(*examples())


# ---- windows of many texts, decoded together and reconciled text by text


def window_starts(text: str) -> list[int]:
    """Starts of the windows with a trigger: those of a grid that covers the text with overlap."""
    last = max(0, -(-(len(text) - WIDTH) // STRIDE))
    found: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        found.update(i for i in (k - 1, k) if 0 <= i <= last)
    return [i * STRIDE for i in sorted(found)]


def _decoded(texts: list[str], where: list[tuple[int, int]], width: int, w: Weights, block: int) -> Iterator[tuple[int, float, int, int, int, bool]]:
    """(place in ``where``, score, kind, start, end, cut) of every span in windows of one width, given as (text, start); cut if it lies at an edge inside the text."""
    for a in range(0, len(where), block):
        part = where[a : a + block]
        x = np.full((len(part), width), PADDING, np.int64)
        for row, (i, s) in enumerate(part):
            piece = texts[i][s : s + width]
            x[row, : len(piece)] = symbols(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32))
        tags, gain = decode(w, x)
        for row in np.flatnonzero((tags > 0).any(1)).tolist():
            i, s = part[row]
            own, t = tags[row], 0
            while t < width:
                if own[t] % 2 == 1:
                    kind, end = int(own[t]) // 2, t + 1
                    while end < width and own[end] == own[t] + 1:
                        end += 1
                    cut = (t < EDGE and s > 0) or (end > width - EDGE and s + width < len(texts[i]))
                    yield a + row, float(gain[row, t:end].sum()), kind, s + t, s + end, cut
                    t = end
                else:
                    t += 1


def _possible(kind: int, piece: str) -> bool:
    """Whether a plausible span of the kind may hold the piece: digits, or numbers of an address, only grow."""
    if kind == 0:
        return True
    return len([p for p in _NOT_DIGIT.split(piece) if p]) <= 4 if kind == 1 else len(_NOT_DIGIT.sub("", piece)) <= 19


def _joined(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def tagged_spans(texts: list[str], w: Weights, block: int = 2048) -> list[list[tuple[float, int, int, int]]]:
    """(score, kind, start, end) of every span the windows of each text hold."""
    out: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    # of each width: windows, and the part of the text that each is about (None: all)
    windows = {WIDTH: [(i, s, None) for i, t in enumerate(texts) for s in window_starts(t)]}
    while windows:
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for width, where in windows.items():
            for k, score, kind, start, end, cut in _decoded(texts, [x[:2] for x in where], width, w, max(1, block * WIDTH // width)):
                i, _, about = where[k]
                if about and not (start < about[1] and about[0] < end):
                    continue
                if cut:
                    pieces.setdefault(i, []).append((kind, start, end))
                else:
                    out[i].append((score, kind, start, end))
        windows = {}
        for i, own in pieces.items():
            left = [(s, e) for k, s, e in own if _possible(k, texts[i][s:e]) and not any(k == kind and a <= s and e <= b for _, kind, a, b in out[i])]
            for s, e in _joined(left):
                # as much text again on either side: what is cut again is longer than before
                room = max(WIDTH, e - s)
                start = max(0, s - room)
                width = 1 << (min(len(texts[i]), e + room) - start - 1).bit_length()
                windows.setdefault(width, []).append((i, start, (s, e)))
    return out


def reconciled(text: str, base: list[Span], found: list[tuple[float, int, int, int]]) -> list[Span]:
    """Base spans and, of the plausible spans of all windows that touch none of them, the set of largest total score without overlap."""
    taken = _joined([(s, e) for _, s, e in base])
    taken_ends = [e for _, e in taken]
    free: dict[tuple[int, int, int], float] = {}
    for score, kind, start, end in found:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        after = bisect_right(taken_ends, start)
        if score > 0 and plausible(kind, text[start:end]) and not (after < len(taken) and taken[after][0] < end):
            free[kind, start, end] = max(score, free.get((kind, start, end), 0.0))
    spans = sorted(free, key=lambda x: (x[2], x[1], x[0]))
    ends = [s[2] for s in spans]
    best, came = [0.0], []  # of the first k spans: the largest total, and which the last one is
    for k, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, k)
        take = best[before] + free[s] > best[k]
        best.append(best[before] + free[s] if take else best[k])
        came.append(before if take else -1)
    chosen, k = [], len(spans)
    while k:
        if came[k - 1] >= 0:
            chosen.append(spans[k - 1])
            k = came[k - 1]
        else:
            k -= 1
    return sorted([*base, *chosen])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Weights | None = None) -> DataFrame:
    """One row per document: base spans by kind, their digest, all spans, and how many the tagger added."""
    shared = docs.sparkSession.sparkContext.broadcast(model or weights())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = T._parse_datatype_string(DIGEST).fields

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for text, found in zip(texts, tagged_spans(texts, shared.value), strict=True):
                base = base_spans(text)
                spans = reconciled(text, base, found) if found else base
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *(f.name for f in fields)])

    return map_arrow(source, run, T.StructType([source.schema["id"], *fields])).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, *, text_col: str = "text", model: Weights | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or weights())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(tagged_spans([t or "" for t in texts], shared.value)):
                if texts[i]:
                    end, pieces = 0, []
                    for k, s, e in sorted(reconciled(texts[i], base_spans(texts[i]), found), key=lambda x: x[1:]):
                        if s >= end:
                            pieces += [texts[i][end:s], f"<{KINDS[k]}>"]
                            end = e
                    texts[i] = "".join([*pieces, texts[i][end:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)

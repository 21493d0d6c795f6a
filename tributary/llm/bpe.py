"""BPE encoding and decoding with reuse of content-defined chunks.

Encoding (``encode``):

1. A rolling hash over the characters cuts each text where the last 32 characters say so
   (``cuts``), so passages that documents share are cut alike wherever they stand.
2. Each distinct chunk is encoded once, as if it were a text, and remembered with the
   places where its words begin; a chunk met again costs a look-up.  Chunks are told by
   their whole text, so there are no collisions.
3. Words next to a join may be cut or split otherwise than in the whole text.  From the
   last word of a chunk that its end can't change, a window over the join is encoded
   again, and widened until one of its word beginnings is also one of the next chunk's.
   From there on both agree for good, as the splitting of words looks only forward
   (``Encoder._join``).

Decoding (``decode``) puts the bytes of the ids together, all texts of a batch at once.

The ids are exactly those of the tokenizers library, special tokens in the text included;
words are found with numpy for many chunks at once, and the library encodes only words
not met before.  Both are one pass over the documents without a shuffle.

Chunks and words are remembered by each worker process, within ``MEMORY_BYTES`` and
``tokens.CACHE_WORDS``; the chunks used least recently go first.

Defined cases: null text is empty and has no ids; any length of text works, even one
word of megabytes (the window then grows over its chunks); rows are taken one by one, so
repeated rows, ties and null ids change nothing; empty tables give no rows; only the
columns named by ``keep`` go along, whatever others there are.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import map_arrow
from .textbytes import span_hashes
from .tokens import LETTER, NUMBER, OTHER, SPACE

# Fixed value: how a byte-level BPE splits words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Chunks have 512 more characters than LEAST on average, and MOST at the most.
LEAST, MASK, MOST = 128, np.uint32(511), 4096
#: Characters that decide a cut, as a power of two: 2**5.
ROLLS = 5
#: Characters of the next chunk in the first window over a join.
AHEAD = 24
#: Characters worked on at a time, and bytes of chunks that a worker remembers.
GROUP_CHARS, MEMORY_BYTES = 1 << 19, 32 << 20
END, UNSURE = 4, 5


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each code point; those this Python's Unicode tables don't know are unsure."""
    kinds = tokens._kinds().copy()
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    kinds[unknown] = UNSURE
    return kinds


def rolled(code: np.ndarray) -> np.ndarray:
    """A hash of each character and the 31 before it, by doubling: a window's hash is that of its second half and the shifted first."""
    h = code.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for k in range(ROLLS):
        n = 1 << k
        h[n:] += h[:-n] << np.uint32(n)
    return h


def cuts(text: str) -> list[int]:
    """Where the chunks of a text end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    found = []
    for begin in range(0, n, GROUP_CHARS):
        lead = min(begin, 1 << ROLLS)
        part = text[begin - lead : begin + GROUP_CHARS]
        h = rolled(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32))
        found.append(np.flatnonzero((h[lead:] >> np.uint32(16)) & MASK == 0) + begin + 1)
    ends, last = [], 0
    for at in np.concatenate(found).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def word_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words begin, as PATTERN matches them; texts are set apart by a character of kind END.

    Runs of letters, of numbers and of others are words, each with one blank before it; of
    a longer run of white space all but the last character is a word, at the end all.
    """
    new = np.empty(len(code), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    blank = code == 32
    space = kind == SPACE
    # the run of white space goes before its last character, save at the end of a text
    last = np.zeros(len(code), bool)
    last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != END)
    new |= last
    new[1:] &= ~(blank[:-1] & last[:-1])  # a blank is the next word's
    # 's, 't, 'm, 'd, 're, 've, 'll where an apostrophe begins a word
    mark = np.flatnonzero((code == 39) & new)
    mark = mark[mark + 1 < len(code)]
    mark = mark[kind[mark + 1] == LETTER]
    if len(mark):
        padded = np.concatenate((code, np.zeros(3, code.dtype)))
        one = np.isin(padded[mark + 1], [ord(c) for c in tokens.SUFFIXES_1])
        two = np.zeros(len(mark), bool)
        for a, b in tokens.SUFFIXES_2:
            two |= (padded[mark + 1] == ord(a)) & (padded[mark + 2] == ord(b))
        two &= ~one
        new[mark[one | two] + 1] = False
        for at, n in ((mark[one], 2), (mark[two], 3)):
            after = at + n
            after = after[after < len(code)]
            new[after[kind[after] == LETTER]] = True
    return np.flatnonzero(new & (kind != END))


class Chunk:
    """A text encoded by itself: its ids, where its words begin and end in characters, and in ids.

    ``safe`` words are those that more text at the end can't change: they end two
    characters before it (one decides where a run ends, two whether ``'re`` is one word).
    """

    __slots__ = ("edges", "ids", "places", "safe")

    def __init__(self, ids: np.ndarray, edges: np.ndarray, places: np.ndarray):
        self.ids, self.edges, self.places = ids, edges, places
        self.safe = int(np.searchsorted(edges[1:], edges[-1] - 2, "right"))

    def size(self) -> int:
        return 500 + self.ids.nbytes + self.edges.nbytes + self.places.nbytes


class Encoder(tokens.Encoder):
    """Ids of texts for a byte-level BPE of the form checked here; remembers words and chunks."""

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        split, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["type"] != "BPE" or model["dropout"] or not plain:
            raise ValueError(f"{path}: splits or normalises words otherwise than this module can")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = {t["content"]: t["id"] for t in added}
        self.kinds = _kinds().copy()
        self.chunks: dict[str, Chunk] = {}
        self.memory, self.held = memory, 0
        self.encoded = self.reused = 0  # characters of chunks
        self._forget()

    # -- words

    def _kind(self, code: np.ndarray) -> np.ndarray:
        kind = self.kinds[code]
        if (kind == UNSURE).any():
            for c in np.unique(code[kind == UNSURE]).tolist():
                begins = {begin for _, (begin, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"\na{chr(c)}\n1{chr(c)}\n!{chr(c)}")}
                self.kinds[c] = next((k for at, k in ((2, LETTER), (5, NUMBER), (8, OTHER)) if at not in begins), SPACE)
            kind = self.kinds[code]
        return kind

    def _encoded(self, texts: list[str]) -> Iterator[Chunk]:
        """Each text encoded by itself."""
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
            group.append(t)
            size += len(t) + 1
        if group:
            yield from self._group(group)

    def _group(self, group: list[str]) -> Iterator[Chunk]:
        text = "\0".join(group) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in group]) - 1
        kind = self._kind(code)
        kind[stops] = END
        starts = word_starts(code, kind)
        of = np.concatenate(([0], np.searchsorted(starts, stops)))
        ends = np.append(starts[1:], len(code))
        ends[of[1:] - 1] = stops
        distinct, first, inverse = np.unique(span_hashes(code, starts, ends), return_index=True, return_inverse=True)
        new = self._place(distinct) < 0
        if len(self.known) + new.sum() > tokens.CACHE_WORDS:
            self._forget()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(distinct[new], [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slot = self.slot[self._place(distinct)]
        size = self.size[slot][inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[slot][inverse], size)]
        begin = 0
        for a, b, stop in zip(of[:-1].tolist(), of[1:].tolist(), stops.tolist(), strict=True):
            edges = np.append(starts[a:b] - begin, stop - begin).astype(np.int32)
            yield Chunk(ids[total[a] : total[b]].copy(), edges, (total[a : b + 1] - total[a]).astype(np.int32))
            begin = stop + 1

    # -- chunks

    def _ensure(self, texts: list[str]) -> dict[str, Chunk]:
        """The chunk of each text, encoded once and then remembered."""
        found: dict[str, Chunk] = {}
        new: dict[str, None] = {}
        for t in texts:
            if t in found or t in new:
                self.reused += len(t)
            elif (c := self.chunks.pop(t, None)) is not None:
                self.chunks[t] = found[t] = c  # used last
                self.reused += len(t)
            else:
                new[t] = None
        for t, c in zip(new, self._encoded(list(new)), strict=True):
            self.chunks[t] = found[t] = c
            self.held += c.size() + len(t)
            self.encoded += len(t)
        while self.held > self.memory and self.chunks:
            t = next(iter(self.chunks))
            self.held -= self.chunks.pop(t).size() + len(t)
        return found

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids (int32) of each text, in order; null counts as empty."""
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t or "") > GROUP_CHARS:
                yield from self._texts(group)
                group, size = [], 0
            group.append(t or "")
            size += len(t or "")
        if group:
            yield from self._texts(group)

    def _texts(self, group: list[str]) -> Iterator[np.ndarray]:
        parts = [self._split(t) for t in group]  # a text is parts between special tokens
        stretches = [p for text in parts for p in text if isinstance(p, str)]
        ends = [cuts(p) for p in stretches]
        pieces = [[p[a:b] for a, b in zip([0, *e], e, strict=False)] for p, e in zip(stretches, ends, strict=True)]
        chunks = self._ensure([c for cs in pieces for c in cs])
        held = [[chunks[c] for c in cs] for cs in pieces]
        # first windows over all joins: from the last safe word of one chunk to some way into the next
        windows = [[p[e[i] - int(cs[i].edges[-1] - cs[i].edges[cs[i].safe]) : min(e[i] + AHEAD, len(p))] for i in range(len(e) - 1)] for p, e, cs in zip(stretches, ends, held, strict=True)]
        joined = self._ensure([w for ws in windows for w in ws])
        done = iter([self._join(p, e, cs, [joined[w] for w in ws]) for p, e, cs, ws in zip(stretches, ends, held, windows, strict=True)])
        for text in parts:
            ids = [next(done) if isinstance(p, str) else np.array([self.added[p[0]]], np.int32) for p in text]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def _split(self, text: str) -> list[str | tuple[str]]:
        """The text between special tokens, and these (as 1-tuples), the leftmost first."""
        parts: list[str | tuple[str]] = []
        while text:
            at, token = min(((i, t) for t in self.added if (i := text.find(t)) >= 0), default=(len(text), None))
            if at:
                parts.append(text[:at])
            if token is None:
                break
            parts.append((token,))
            text = text[at + len(token) :]
        return parts

    def _join(self, text: str, ends: list[int], chunks: list[Chunk], windows: list[Chunk]) -> np.ndarray:
        """Ids of a text from those of its chunks, with the words around each join encoded again.

        ``word`` is the first word of chunk ``i`` that is not put out yet; the text's own words
        and the chunk's agree from there on.
        """
        if len(chunks) == 1:
            return chunks[0].ids
        out = []
        i = word = 0
        while True:
            here = chunks[i]
            if i == len(chunks) - 1:
                out.append(here.ids[here.places[word] :])
                return np.concatenate(out)
            out.append(here.ids[here.places[word] : here.places[here.safe]])
            begin = ends[i] - int(here.edges[-1] - here.edges[here.safe])
            window, stop = windows[i], min(ends[i] + AHEAD, len(text))
            while (met := self._agreed(window, begin, stop == len(text), ends, chunks, i + 1)) is None:
                stop = min(stop + 4 * (stop - begin), len(text))
                window = next(self._encoded([text[begin:stop]]))
            n_ids, i, word = met
            out.append(window.ids[:n_ids])
            if i == len(chunks):
                return np.concatenate(out)

    @staticmethod
    def _agreed(window: Chunk, begin: int, last: bool, ends: list[int], chunks: list[Chunk], i: int) -> tuple[int, int, int] | None:
        """(ids of the window before the first word at which it agrees with a chunk, that chunk from ``i`` on, the word there)."""
        final = len(window.edges) - 1 if last else window.safe
        at = window.edges[: final + 1] + begin
        k = int(np.searchsorted(at, ends[i - 1]))
        while i < len(chunks) and k <= final:
            chunk, first = chunks[i], ends[i - 1]
            usable = chunk.edges[: (chunk.safe if i < len(chunks) - 1 else len(chunk.edges) - 1) + 1] + first
            mine = at[k:]
            place = np.minimum(np.searchsorted(usable, mine), len(usable) - 1)
            same = np.flatnonzero(usable[place] == mine)
            if len(same):
                return int(window.places[k + same[0]]), i, int(place[same[0]])
            k += int(np.searchsorted(mine, ends[i]))
            i += 1
        return (len(window.ids), len(chunks), 0) if last else None


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, so its memory outlives a task."""
    return Encoder(path)


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens in order of their ids, where each begins and the last ends)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    shown = [c for c in range(256) if chr(c).isprintable() and c not in (32, 0xA0, 0xAD)]
    hidden = [c for c in range(256) if c not in shown]  # these are written as the characters from 256 on
    as_byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
    held = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        held.append(bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode())
    return np.frombuffer(b"".join(held), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in held])))


def decoded(ids: np.ndarray, of: np.ndarray, path: str) -> list[str]:
    """The text of each sequence ``ids[of[i]:of[i + 1]]``; bytes that are no UTF-8 become U+FFFD."""
    data, edges = token_bytes(path)
    out = []
    begin = 0
    while begin < len(of) - 1:  # a stretch of sequences of bounded size at a time
        stop = max(int(np.searchsorted(of, of[begin] + GROUP_CHARS, "right")) - 1, begin + 1)
        part = ids[of[begin] : of[stop]]
        size = edges[part + 1] - edges[part]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = data[np.arange(total[-1]) - np.repeat(total[:-1] - edges[part], size)].tobytes()
        at = total[of[begin : stop + 1] - of[begin]].tolist()
        out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        begin = stop
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kept(df: DataFrame, keep: Sequence[str], taken: str) -> list[T.StructField]:
    if taken in keep:
        raise ValueError(f"a kept column can't be named {taken}")
    return [df.schema[c] for c in keep]


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``: the token ids of each whole text."""
    schema = T.StructType([*_kept(docs, keep, "ids"), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(encoder(tokenizer).encode(batch.column(0).to_pylist()))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids], names=schema.names)

    return map_arrow(docs.select(F.col(text_col).alias("__text"), *keep), run, schema)


def decode(encoded: DataFrame, tokenizer: str, *, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``: the decoded text of each row's ids; null ids are none."""
    schema = T.StructType([*_kept(encoded, keep, "text"), T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            of = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(decoded(lists.flatten().to_numpy(), of, tokenizer), pa.string())], names=schema.names)

    return map_arrow(encoded.select(F.col(ids_col).alias("__ids"), *keep), run, schema)


def round_trip_digest(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of ids and digests of the ids and of the text decoded from them."""
    encoded = encode(docs, tokenizer, text_col=text_col, keep=[id_col])
    sha = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    encoded = encoded.select(id_col, "ids", F.size("ids").cast("long").alias("n_tokens"), sha.alias("ids_sha256"))
    back = decode(encoded, tokenizer, keep=[id_col, "n_tokens", "ids_sha256"])
    return back.select(id_col, "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))

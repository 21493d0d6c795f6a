"""Token ids of many texts at once, exactly those of a given tokenizer file.

Handles tokenizers of one kind: BPE with an end-of-word suffix, texts
NFC-normalised and lower-cased, white space dropped, words split off by the
pattern below and encoded on their own.  As each word's ids do not depend on its
neighbours, words are found and hashed with numpy for a whole chunk, and only
words not met before go to the tokenizer.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from .textbytes import span_hashes

# What a supported tokenizer file states about splitting and normalising.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SUFFIXES_1 = "stmd"
SUFFIXES_2 = ("re", "ve", "ll")
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CHUNK_CHARS = 1 << 20
#: Words remembered by a worker from chunk to chunk; about 60 MB.  A chunk with more is held whole.
CACHE_WORDS = 1 << 20


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[SPACES] = SPACE
    return kinds


def normalized(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # a final sigma is not told apart


def word_spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's matches begin and end in the code points."""
    kind = _kinds()[code]
    new = np.empty(len(code), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == NUMBER
    edge = new.copy()
    new &= kind != SPACE
    # 's, 't, 'm, 'd, 're, 've, 'll: an apostrophe alone among the other characters takes these letters
    mark = np.flatnonzero((code == 39) & edge)
    if len(mark):
        padded = np.concatenate((code, np.zeros(3, code.dtype)))
        mark = mark[(mark + 1 < len(code))]
        mark = mark[edge[mark + 1] & (kind[mark + 1] == LETTER)]
        one = np.isin(padded[mark + 1], [ord(c) for c in SUFFIXES_1])
        two = np.zeros(len(mark), bool)
        for a, b in SUFFIXES_2:
            two |= (padded[mark + 1] == ord(a)) & (padded[mark + 2] == ord(b))
        two &= ~one
        for at, n in ((mark[one], 1), (mark[two], 2)):
            new[at + 1] = False
            after = at + 1 + n
            after = after[after < len(code)]
            new[after] |= kind[after] != SPACE
            edge[after] = True
        edge[mark[one | two] + 1] = False
    starts = np.flatnonzero(new)
    stops = np.flatnonzero(edge)
    at = np.searchsorted(stops, starts, "right")
    ends = np.append(stops, len(code))[at]
    return starts, ends


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if split != PATTERN or kinds != NORMALIZERS:
            raise ValueError(f"{path}: splits or normalises words otherwise than this module can")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of words
        self.slot = np.zeros(0, np.int64)  # of each, its place in begin and size
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes: sorted, none of them known."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(size.sum()))
        begin = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.ids = np.concatenate((self.ids, flat))
        at, new = np.searchsorted(self.known, hashes), len(self.begin) + np.arange(len(found))
        self.begin, self.size = np.concatenate((self.begin, begin)), np.concatenate((self.size, size))
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, new)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the known, -1 where it isn't there."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids (int32) of each text, in order; null counts as empty."""
        group: list[str] = []
        size = 0
        for t in texts:
            t = normalized(t or "")
            if group and size + len(t) > CHUNK_CHARS:
                yield from self._chunk(group)
                group, size = [], 0
            group.append(t)
            size += len(t) + 1
        if group:
            yield from self._chunk(group)

    def _chunk(self, group: list[str]) -> Iterator[np.ndarray]:
        text = "\n".join(group) + "\n"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in group])))
        starts, ends = word_spans(code)
        distinct, first, inverse = np.unique(span_hashes(code, starts, ends), return_index=True, return_inverse=True)
        new = self._place(distinct) < 0
        if len(self.known) + new.sum() > CACHE_WORDS:  # the chunk's words are all learned anew, however many they are
            self._forget()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(distinct[new], [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        place = self._place(distinct)
        assert (place >= 0).all()
        slot = self.slot[place]
        size = self.size[slot][inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[slot][inverse], size)]
        cut = total[np.searchsorted(starts, bounds)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield ids[a:b]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, so its memory outlives a task."""
    return Encoder(path)

"""Vectorised work on the UTF-8 bytes of a batch of texts.

An Arrow string column already holds its texts as one byte buffer with
offsets; these functions find words and hash them for all texts of a batch at
once with numpy, without a Python object per text or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Lower-cases A-Z, leaves the rest.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, CHUNK_BYTES * 2), np.uint64)
        have[0], filled = 1, 1
        with np.errstate(over="ignore"):
            while filled < len(have):
                step = min(filled, len(have) - filled)
                have[filled : filled + step] = have[:step] * np.uint64(pow(base, filled, 1 << 64))
                filled += step
        if len(have) <= CHUNK_BYTES * 8:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, wherever the span stands."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some consecutive texts: texts first..last of the batch."""

    first: int
    last: int
    data: np.ndarray  # lower-cased bytes with one blank after each text
    bounds: np.ndarray  # where each text begins in data, and the end
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # words of text i are of[i]:of[i + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def separated(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts i..j with a blank after each, and their bounds."""
    lengths = np.diff(offsets[i : j + 1])
    bounds = np.zeros(j - i + 1, np.int64)
    np.cumsum(lengths + 1, out=bounds[1:])
    data = np.full(bounds[-1], 32, np.uint8)
    part = raw[offsets[i] : offsets[j]]
    keep = np.ones(len(data), bool)
    keep[bounds[1:] - 1] = False
    data[keep] = LOWER[part] if lower else part
    return data, bounds


def words(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words ``[0-9a-z or non-ASCII]+`` of every text, A-Z lower-cased, chunk by chunk."""
    raw, offsets = text_buffer(column)
    for i, j in chunks(offsets, limit):
        data, bounds = separated(raw, offsets, i, j)
        inside = WORD[data].view(np.int8)
        step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            step = np.concatenate(([0], step))
        starts, ends = step[::2], step[1::2]
        yield Words(i, j, data, bounds, starts, ends, np.searchsorted(starts, bounds))


# Kinds of bytes of tokens: blank, of a word, a mark, the rest of a character that is a token by itself.
_BLANK, _WORD, _MARK, _REST = range(4)
_KIND = np.where(WORD, _WORD, _MARK).astype(np.uint8)
_KIND[65:91] = _WORD
_KIND[:33] = _KIND[127] = _BLANK


def tokens(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words as they are written, and marks.

    Each ASCII mark is a token, and so is each character of three or four bytes (most
    scripts that leave no blanks); capitals are kept.
    """
    raw, offsets = text_buffer(column)
    for i, j in chunks(offsets, limit):
        data, bounds = separated(raw, offsets, i, j, lower=False)
        kind = _KIND[data]
        wide = np.flatnonzero(data >= 0xE0)
        if len(wide):
            kind[wide] = _MARK
            kind[wide + 1] = kind[wide + 2] = _REST
            kind[wide[data[wide] >= 0xF0] + 3] = _REST
        goes_on = kind == _REST
        goes_on[1:] |= (kind[1:] == _WORD) & (kind[:-1] == _WORD)
        stops = np.flatnonzero(~goes_on)
        first = kind[stops] != _BLANK
        ends = np.append(stops[1:], len(data))[first]
        starts = stops[first]
        yield Words(i, j, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def segment_sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of values[of[i]:of[i + 1]], empty segments included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[of[1:]] - total[of[:-1]]

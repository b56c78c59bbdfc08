"""Words and word shingles of whole texts as 64-bit values, computed from an Arrow column's bytes with numpy.

A word is a run of anything but the bytes 0x20 and 0x09-0x0D. Its value is a sum of random numbers, one for each byte
and its place in the word, mixed with its length. No word becomes a Python object and nothing is kept from one batch to
the next; arrays that take many bytes for each of the text's are made a block at a time, so that a text of any length
needs a few times its own size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text for which wide arrays are made at a time.
BLOCK_BYTES = 1 << 19
#: Places in a word whose random numbers are kept in a table; those behind are mixed when they are needed.
_PLACES = 32

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalising permutation of splitmix64 over an array of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _random(place_and_byte: np.ndarray) -> np.ndarray:
    return mix64(mix64(place_and_byte.astype(np.uint64) * _MULT + np.uint64(0x632BE59BD9B4E019)))


_TABLE = _random(np.arange(_PLACES << 8))


@dataclass
class Words:
    """Of a column of texts: all bytes, where texts begin and end in them, and the words with the text that each is in."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # of each text, and the end of the last
    starts: np.ndarray  # of each word
    sizes: np.ndarray  # of each word, in bytes
    text: np.ndarray  # number of the text that a word is in
    values: np.ndarray  # uint64
    counts: np.ndarray  # words of each text

    def first(self) -> np.ndarray:
        """The number of each text's first word."""
        return np.cumsum(self.counts) - self.counts

    def raw(self, text: int) -> bytes:
        return self.data[self.offsets[text] : self.offsets[text + 1]].tobytes()


def text_bytes(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and each text's offset in them; nulls are empty."""
    col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    if not len(col):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return held, offsets - offsets[0]


def run_values(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of each run of bytes; ``inside`` marks the bytes of all runs, which follow each other."""
    values, n = np.zeros(len(starts), dtype=np.uint64), len(data)
    for p in range(0, n, BLOCK_BYTES):
        q = min(n, p + BLOCK_BYTES)
        i, j = int(np.searchsorted(ends, p, side="right")), int(np.searchsorted(starts, q, side="left"))
        if i < j:
            here = np.flatnonzero(inside[p:q])
            lengths = np.minimum(ends[i:j], q) - np.maximum(starts[i:j], p)
            place = here + p - np.repeat(starts[i:j], lengths)
            key = (place << 8) | data[p:q][here]
            if int(place.max()) < _PLACES:
                got = _TABLE[key]
            else:
                far = place >= _PLACES
                got = np.empty(len(key), dtype=np.uint64)
                got[~far], got[far] = _TABLE[key[~far]], _random(key[far])
            values[i:j] += np.add.reduceat(got, np.cumsum(lengths) - lengths)
    return mix64(values + (ends - starts).astype(np.uint64) * _MULT)


def words_of(texts: pa.Array | list[str | None], lower: bool = False) -> Words:
    """The words of each text; with ``lower`` A-Z are lower-cased first."""
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~SEPARATOR[data]
    held = np.flatnonzero(np.diff(offsets))  # texts that are not empty
    edge = np.ones(n, dtype=bool)
    np.logical_not(inside[:-1], out=edge[1:])
    edge[offsets[held]] = True
    starts = np.flatnonzero(inside & edge)
    edge[:] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[offsets[held + 1] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    del edge
    sizes, values = ends - starts, run_values(data, inside, starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return Words(data, offsets, starts, sizes, np.repeat(np.arange(len(counts)), counts), values, counts)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A value for each run of ``width`` values; the last ones run over the end of the array."""
    padded = np.concatenate((values, np.zeros(width, dtype=np.uint64)))
    h = padded[: len(values)].copy()
    for k in range(1, width):
        h *= _MULT
        h += padded[k : k + len(values)]
    return h


def shingle_sets(texts: pa.Array | list[str | None], width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sets of distinct shingles of many texts: (values, offsets), each text's values ascending.

    A-Z are lower-cased. A text with fewer than ``width`` words gives its whole sequence as one shingle; a null or
    wordless text gives none.
    """
    words = words_of(texts, lower=True)
    values, sizes = words.values, words.counts
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    ends = np.cumsum(counts)
    if not len(values):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(sizes) + 1, dtype=np.int64)
    # a window at every word of the batch, of which those that stay within their text are kept
    h = windows(values, width) + np.uint64(width)
    starts = words.first()
    inside = np.ones(len(values), dtype=bool)
    for k in range(1, width):
        last = starts + sizes - k
        inside[last[sizes >= width]] = False
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        s, n = starts[i], int(sizes[i])
        x = values[s : s + 1]
        for k in range(1, n):
            x = x * _MULT + values[s + k : s + k + 1]
        h[s] = x[0] + np.uint64(n)
        inside[s + 1 : s + n] = False
        inside[s] = True
    del words, values
    h = mix64(h[inside])
    keep = np.ones(len(h), dtype=bool)
    begin = 0
    for end in ends.tolist():
        if end > begin:
            part = h[begin:end]
            part.sort()
            keep[begin + 1 : end] = part[1:] != part[:-1]
        begin = end
    held = np.concatenate(([0], np.cumsum(keep)))
    return h[keep], held[np.concatenate(([0], ends))].astype(np.int64)

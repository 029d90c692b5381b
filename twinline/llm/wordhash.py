"""Words of whole Arrow text columns as 64-bit hashes, in numpy: no Python object per word."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_LONG = 64  # bytes; longer words are hashed one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.arange(256, dtype=np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words in order of all texts: ``counts[i]`` of them lie in text i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Index of each text's first word, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, eight bytes a step."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    step = 0
    while len(live):
        part = eight[starts[live] + step] & _MASK[np.minimum(size[live] - step, 8)]
        h[live] = mix((h[live] ^ part) * _M1)
        step += 8
        live = live[size[live] > step]
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each text's offsets, and where words ``[^\\x20\\x09-\\x0D]+`` begin and end."""
    raw, offsets = text_bytes(column)
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begin], last[end] = inside[begin], inside[end]
    # A word never runs over into the next text.
    return raw, offsets, np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(column: pa.Array, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased if asked."""
    raw, offsets, starts, ends = word_spans(column)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(hash_spans((_LOWER if lower else _PLAIN)[raw], starts, ends), starts, ends, counts)


def word_bytes(word: str) -> int:
    """The hash that :func:`words_of` gives one word, for tests and single lookups."""
    return int(words_of(pa.array([word])).hashes[0])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words; runs over a text's end are the caller's to drop."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = mix(h * _M1 + hashes[k : k + n])
    return h

"""Vectorized word and shingle hashes of whole Arrow batches of texts; a helper that runs inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE5A7 + 1)) | np.uint64(1)


_BYTE = keys(256, 1)
_PLACE = keys(SHINGLE + 1, 2)


@lru_cache(8)
def _weights(n: int) -> np.ndarray:
    return keys(n, 3)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and their n + 1 offsets."""
    texts = pa.array(texts.fill_null(""), pa.large_string()) if not pa.types.is_large_string(texts.type) else texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and n + 1 bounds of each text's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    first[cuts] = word[cuts]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    weights = _weights(1 << max(6, (longest - 1).bit_length()))
    values = (_BYTE[_LOWER] if lower else _BYTE)[data[starts[0] :]] * weights[place]
    values[~word[starts[0] :]] = 0
    return mix(np.add.reduceat(values, starts - starts[0])), bounds


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles; with fewer words the whole sequence is one; without words, none."""
    words, bounds = word_hashes(*buffers(texts))
    n = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE if n else 0):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _PLACE[SHINGLE:] * np.uint64(b - a)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Words of Arrow text columns, as arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on whole.
SLICE_BYTES = 4_000_000
#: Bytes of words hashed at a time.
HASH_BYTES = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for every byte, A-Z as a-z.
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
VALUES = mix((_FOLDED + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
_POWERS = np.cumprod(np.full(HASH_BYTES, BASE, np.uint64)) if HASH_BYTES else None
_INVERSE = np.cumprod(np.full(HASH_BYTES, pow(BASE, -1, 2**64), np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of about `limit` bytes of text."""
    _, offsets = texts(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; start and end of every word; number of words of every text."""
    data, offsets = texts(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    solid = np.concatenate(([False], ~SPACE[data], [False]))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, A-Z counting as a-z.

    Each is a polynomial in BASE over random values of the bytes, from one running
    sum for many words, made independent of the word's place and mixed.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        if to - at > HASH_BYTES:  # one very long word, in blocks
            out[i] = _long(data[at:to])
        else:
            run = np.zeros(to - at + 1, np.uint64)
            np.cumsum(VALUES[data[at:to]] * _POWERS[: to - at], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (run[e] - run[s]) * _INVERSE[s] * np.uint64(BASE)
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _long(word: np.ndarray) -> np.uint64:
    total, factor = 0, 1
    step = pow(BASE, HASH_BYTES, 2**64)
    for i in range(0, len(word), HASH_BYTES):
        block = VALUES[word[i : i + HASH_BYTES]]
        total += factor * int((block * _POWERS[: len(block)]).sum(dtype=np.uint64))
        factor = factor * step % 2**64
    return np.uint64(total % 2**64)

"""Vectorised word hashing over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All work is done on slices of a few
megabytes of UTF-8, so memory doesn't depend on the batch size; hashes are 64-bit polynomial sums with a
random value for each byte, finished by a multiply-xor mix.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_rng = np.random.default_rng(977)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _RADIX if kind == "up" else pow(_RADIX, -1, 2**64)
        steps = np.full(max(n, 2 * len(_powers[kind])), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents in order: byte ranges in ``data``, hashes, and where each document's begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # documents + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Free memory, which the allocators keep for a worker's next task otherwise, goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; memory that is free after them goes back to the system."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def split_words(texts: pa.Array, lower: bool) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    before[offsets] = False  # a document begins: no word goes on from the one before
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = inside[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n), out=total[1:])
    h = mix((total[end] - total[start]) * _power("down", n + 1)[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, h, np.searchsorted(start, offsets, "left"))


def ngram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; only the first len - size + 1 are whole."""
    n = max(0, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
    return mix(total)


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + counts[i] - 1 for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.repeat(np.asarray(first, np.int64) - begin, counts) + np.arange(total)

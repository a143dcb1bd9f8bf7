"""Vectorised word and n-gram hashing over Arrow string buffers.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters in
the lower-cased text.  Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once: bounds a worker's memory (about 40 bytes each).
SLICE_BYTES = 500_000
_MULT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_INV = np.uint64(pow(_MULT, -1, 1 << 64))

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _IS_WORD[_c] = True
_BYTE[~_IS_WORD] = 0


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work``, whose freed memory goes back to the system before each batch that it takes and at its end.

    Workers live on between tasks and, idle or busy with another operator, would hold the most that they ever took.
    """

    def taken(batches: Batches) -> Batches:
        for b in batches:
            release()
            yield b

    def run(batches: Batches) -> Batches:
        yield from work(taken(batches))
        release()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    if size not in _power_cache:
        up = np.full(size, np.uint64(_MULT))
        up[0] = 1
        down = np.full(size, _INV)
        down[0] = 1
        _power_cache.clear()
        _power_cache[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _power_cache[size]
    return up, down


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of the array, each part of about ``limit`` bytes and one row at least."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, texts.slice(row, end - row)
        row = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the row offsets into them; nulls are empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row where its words begin (rows + 1 entries)."""
    raw, offsets = utf8(pc.utf8_lower(texts))
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    hashes = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(begin, offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total = mix64(total) + words[k : len(words) - n + 1 + k]
    return mix64(total)

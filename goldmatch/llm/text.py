"""Words and hashes of Arrow text columns as numpy arrays.

A batch's texts are one byte buffer with offsets. Words, pieces and their hashes are
spans of that buffer, found and hashed for all texts of the batch at once; a text is
never cut short. Hashes have 64 bits: a polynomial over the bytes, times the inverse
power of the start, mixed. They are equal for equal bytes on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
CHUNK_BYTES = 16 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

# a word is a run of bytes outside 0x20 and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, made once per process."""
    for base in (_BASE, _BASE_INV)[len(_POWERS) :]:
        table = np.full(BLOCK + 1, _U(base), _U)
        table[0] = _U(1)
        _POWERS.append(np.cumprod(table, dtype=_U))
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each holds about ``size`` bytes of text.

    A longer text is a chunk of its own.
    """
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()))
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(n + 1, bool)
    after[n], after[:n] = False, inside
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span; spans ascend and don't overlap."""
    out = np.empty(len(starts), _U)
    power, inverse = powers()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:
            out[i] = np.frombuffer(hashlib.blake2b(data[base : ends[i]].tobytes(), digest_size=8).digest(), _U)[0]
            i += 1
            continue
        part = data[base : ends[j - 1]].astype(_U)
        part += _U(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every text the index of its first word."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and for every text the index of its first window.

    A text with fewer than k words, but at least one, has a single window of all of them.
    """
    counts = np.diff(first)
    windows = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(windows)])
    begin = np.repeat(first[:-1] - at[:-1], windows) + np.arange(at[-1])
    width = np.repeat(np.minimum(counts, k), windows)
    out = mix(width.astype(_U) + _U(0x51ED270B))
    last = max(len(hashes) - 1, 0)
    for i in range(k):
        word = hashes[np.minimum(begin + i, last)] if len(hashes) else np.zeros(len(begin), _U)
        out = np.where(i < width, mix(out * _U(0x9FB21C651E98DF25) + word), out)
    return out, at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For every text the ascending distinct hashes of its windows of k lower-cased words."""
    lowered = LOWER[data]
    starts, ends, first = words(lowered, offsets)
    hashed, at = shingles(span_hashes(lowered, starts, ends), first, k)
    return [np.unique(hashed[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

"""Vectorised work on ragged byte slices: word splitting, XXH64, gathers.

Everything here takes numpy arrays over one flat byte buffer (the value buffer
of an Arrow string column), so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
CHUNK_BYTES = 3 << 20
#: For work whose arrays take some hundred times a chunk's bytes; it is not slower for it.
SMALL_CHUNK_BYTES = 1 << 19
_LONG = 512
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_equal(buf: np.ndarray, s: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the slices [s, s + n) of a buffer padded by eight bytes."""
    u64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    u32 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    at, zero = 0, np.zeros(len(s), np.uint64)
    with np.errstate(over="ignore"):
        sd = np.uint64(seed)
        if n >= 32:
            acc = [zero + (sd + P1 + P2), zero + (sd + P2), zero + sd, zero + (sd - P1)]
            while at + 32 <= n:
                for j in range(4):
                    acc[j] = _round(acc[j], u64[s + (at + 8 * j)])
                at += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(zero, a)) * P1 + P4
        else:
            h = zero + (sd + P5)
        h += np.uint64(n)
        while at + 8 <= n:
            h = _rotl(h ^ _round(zero, u64[s + at]), 27) * P1 + P4
            at += 8
        if at + 4 <= n:
            h = _rotl(h ^ (u32[s + at].astype(np.uint64) * P1), 23) * P2 + P3
            at += 4
        while at < n:
            h = _rotl(h ^ (buf[s + at].astype(np.uint64) * P5), 11) * P1
            at += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        return h ^ (h >> np.uint64(32))


def tidy() -> None:
    """Gives what a finished task has freed back to the system: workers wait for their next task with it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice; ``buf`` must be ``padded``. Slices of one length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    short = np.minimum(lens, _LONG + 1).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    cuts = np.flatnonzero(np.diff(short[order])) + 1
    for idx in np.split(order, cuts) if len(order) else []:
        n = int(lens[idx[0]])
        if n <= _LONG:
            out[idx] = _xxh64_equal(buf, starts[idx], n, seed)
        else:
            for i in idx:
                out[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes(), seed)
    return out


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of an ordered pair of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (a ^ _rotl(np.atleast_1d(b) * P2 + P3, 29)) * P1
        h ^= h >> np.uint64(32)
        h *= P3
        h ^= h >> np.uint64(29)
        return h * P2 ^ (h >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``most`` bytes of text, or one row: (batch, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts_of(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the n + 1 word offsets by text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of each slice, one slice after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def joined(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices with one space after each, in one buffer, and their starts there."""
    at = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    out[gather(at, lens)] = data[gather(starts, lens)]
    return out, at

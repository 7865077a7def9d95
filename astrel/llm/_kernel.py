"""Vectorised text kernel shared by the operators of this subpackage.

Everything works on an Arrow string column as one byte buffer plus document
bounds, so no Python object is made per document or per word.  Words are maximal
runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; in UTF-8 that is the same as splitting code points.

A word's fingerprint is chained over its bytes, eight at a time, by a scrambling
bijection, so it depends on the word's bytes alone: not on the batch, the process
or the machine.  Sequences of words are fingerprinted from the words'
fingerprints by the same chain; no step is linear, so patterned words and
sequences don't meet.  All fingerprints have 64 bits.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes up to which words are hashed in numpy.
LONG_WORD = 128
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII signs.
SIGN = np.zeros(256, bool)
SIGN[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tidy() -> None:
    """Give memory that earlier batches freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; nulls become empty texts."""
    tidy()
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = pc.fill_null(values, "")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if len(values) == 0 or values.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    bounds = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    bounds = bounds[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes each, or one longer document."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each bound) of all words; no word crosses a bound.  space: the bytes between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    solid = ~space[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fingerprint of two fingerprints in order."""
    return scramble(a * np.uint64(_BASE) + b)


def _hash_piece(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Eight bytes at a time, each scrambled into what came before; words of over LONG_WORD bytes by a library hash."""
    size = end - start
    h = scramble(size.astype(np.uint64) + np.uint64((_BASE + seed) & (1 << 64) - 1))
    raw = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, step = start[left], size[left]
    while len(left):
        lane = eight[at] & _MASKS[np.minimum(step, 8)]
        h[left] = mix(h[left], lane)
        more = step > 8
        left, at, step = left[more], at[more] + 8, step[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprint of each word; another seed gives an independent one; long buffers are hashed in pieces that end between words."""
    if len(data) <= PIECE or not len(start):
        return _hash_piece(data, start, end, seed)
    parts, first = [], 0
    while first < len(start):
        base = start[first]
        last = max(int(np.searchsorted(end, base + PIECE, "right")), first + 1)
        parts.append(_hash_piece(data[base : end[last - 1]], start[first:last] - base, end[first:last] - base, seed))
        first = last
    return np.concatenate(parts)


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprint of h[i : i + k] for every i, put together from windows of powers of two; one entry fewer than k are cut at the end."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, block = None, 0, 1, h
    while True:
        if k & size:
            part = block[at : at + n]
            out, at = part if out is None else mix(out, part), at + size
        if 2 * size > k:
            return scramble(out ^ np.uint64(scramble_int(seed + k)))
        block, size = mix(block[:-size], block[size:]), 2 * size


def scramble_int(x: int) -> int:
    return int(scramble(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])


def starts_of_windows(per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of k words inside documents.

    per_doc: words before each bound.  Returns the index of each window's first
    word, and for each document the number of its windows.
    """
    count = np.maximum(np.diff(per_doc) - k + 1, 0)
    return runs(per_doc[:-1], count), count


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers for every i, concatenated."""
    if not len(count):
        return np.zeros(0, np.int64)
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(first - (np.cumsum(count) - count), count)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def split_owners(key: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each 64-bit key, stable order by owner): owners hold equal hash ranges."""
    owner = ((key >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    return owner.astype(np.int32), np.argsort(owner.astype(np.uint16 if owners < 65536 else np.uint32), kind="stable")

"""Vectorised tokenising of Arrow text columns: words, word hashes and shingles.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps that equal
to the same rule on code points. All functions take whole texts; long batches
are cut between rows, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: white space, controls and ASCII signs
SIGNS_AND_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


class Chunk(NamedTuple):
    """Rows ``start`` to ``stop`` of a batch: their bytes, and where each row begins."""

    start: int
    stop: int
    data: np.ndarray
    offsets: np.ndarray


def binary_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large binary, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return pc.fill_null(values.cast(pa.large_binary()), b"")


def chunks(values: pa.Array, limit: int = 1 << 19) -> Iterator[Chunk]:
    """Consecutive rows of about ``limit`` bytes; a longer row stands alone."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + n + 1]
    body = values.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield Chunk(start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


#: the longest powers so far, of up to 2^21 bytes; shorter ones are their beginning, and those of a longer text are not kept
_longest: list[np.ndarray] = []


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    if _longest and len(_longest[0]) >= n:
        return _longest[0][:n], _longest[1][:n]
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    for b in range(bits):
        k = 1 << b
        up[k : 2 * k] = up[:k] * U64(pow(_BASE, k, 2**64))
        down[k : 2 * k] = down[:k] * U64(pow(_BASE_INVERSE, k, 2**64))
    if bits <= 21:
        _longest[:] = [up, down]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_sums(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, and the powers that shift a span to 0."""
    up, down = _powers(max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U64(0xA24BAED4963EE407))


class Words(NamedTuple):
    """Spans of all words of a chunk; the words of row i are ``rows[i]`` to ``rows[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def words(chunk: Chunk, separators: np.ndarray = SPACE) -> Words:
    """Words between separators; ``separators`` says of each byte whether it is one."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    at = np.flatnonzero(starts)
    return Words(at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets))


def word_hashes(chunk: Chunk, lower: bool = False, separators: np.ndarray = SPACE) -> tuple[np.ndarray, Words]:
    w = words(chunk, separators)
    sums, down = prefix_sums(chunk.data, lower)
    return span_hashes(sums, down, w.starts, w.ends), w


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * _STEP[j]
    return mix(total)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; a shorter text is one shingle, none is empty."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(hashes, min(n, len(hashes))))

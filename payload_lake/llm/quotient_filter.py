"""Counting quotient filters of packed n-grams, as bytes.

A key is an n-gram of word ids of ``width`` bits each, packed into 64-bit lanes and
permuted invertibly, so that its leading bits are spread evenly. The leading bits
are the quotient, everything else is kept as the remainder: the filter loses
nothing, and keys come back by the inverse permutation.

A filter covers one slice, the keys with the same leading ``bits`` bits, and holds in
the order of the keys: for each quotient the length of its run in unary (a one for
each entry, a zero at the end), the remainders cut to whole bytes, and a counter of
one byte, or 255 and eight bytes in an own list.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np

from .words import U64, mix

_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = U64(pow(_FACTOR, -1, 2**64))
_ODD = np.random.default_rng(20_261_128).integers(1, 2**62, (4, 4), dtype=np.uint64) * U64(2) + U64(1)
_HEAD = struct.Struct("<IBB")
LARGE = 255

Lanes = list[np.ndarray]


def lane_bits(n: int, width: int) -> list[int]:
    """Bits of each lane of an n-gram; all but the last are full."""
    total = n * width
    return [min(64, total - low) for low in range(0, total, 64)]


def pack(ids: Sequence[np.ndarray], width: int) -> Lanes:
    """Ids (unsigned, below ``2 ** width``) one behind the other, from the top of the first lane."""
    lanes = [np.zeros(len(ids[0]), np.uint64) for _ in lane_bits(len(ids), width)]
    for i, x in enumerate(ids):
        lane, above = divmod(i * width, 64)
        shift = 64 - above - width
        if shift >= 0:
            lanes[lane] |= x << U64(shift)
        else:
            lanes[lane] |= x >> U64(-shift)
            lanes[lane + 1] |= x << U64(64 + shift)
    return lanes


def unpack(lanes: Lanes, n: int, width: int) -> list[np.ndarray]:
    mask, out = U64((1 << width) - 1), []
    for i in range(n):
        lane, above = divmod(i * width, 64)
        shift = 64 - above - width
        out.append((lanes[lane] >> U64(shift) if shift >= 0 else lanes[lane] << U64(-shift) | lanes[lane + 1] >> U64(64 + shift)) & mask)
    return out


def _unmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * _INVERSE
    h = (h ^ (h >> U64(32))) * _INVERSE
    return h ^ (h >> U64(32))


def _noise(lanes: Lanes, but: int, turn: int, bits: int) -> np.ndarray:
    """A hash of all lanes but one, as wide as that one."""
    total = np.full(len(lanes[0]), _ODD[turn, 3])
    for j, x in enumerate(lanes):
        if j != but:
            total = total + x * _ODD[turn, j]
    return mix(total) & U64((1 << 64) - (1 << 64 - bits))


def permute(lanes: Lanes, n: int, width: int) -> Lanes:
    """A bijection of the keys (two or more lanes): each lane in turn is changed by a hash of the others."""
    bits, lanes = lane_bits(n, width), [mix(lanes[0]), *lanes[1:]]
    for turn in range(2):
        for i in reversed(range(len(lanes))):
            lanes[i] = lanes[i] ^ _noise(lanes, i, turn, bits[i])
    return [mix(lanes[0]), *lanes[1:]]


def restore(lanes: Lanes, n: int, width: int) -> Lanes:
    """The inverse of ``permute``."""
    bits, lanes = lane_bits(n, width), [_unmix(lanes[0]), *lanes[1:]]
    for turn in reversed(range(2)):
        for i in range(len(lanes)):
            lanes[i] = lanes[i] ^ _noise(lanes, i, turn, bits[i])
    return [_unmix(lanes[0]), *lanes[1:]]


def summed(lanes: Lanes, counts: np.ndarray | None = None) -> tuple[Lanes, np.ndarray]:
    """Distinct keys in their order with the sums of their counts (one each if not given)."""
    order = np.argsort(lanes[0], kind="stable")
    lanes = [x[order] for x in lanes]
    same = lanes[0][1:] == lanes[0][:-1]
    rest = np.ones(len(same), bool)
    for x in lanes[1:]:
        rest &= x[1:] == x[:-1]
    if (same & ~rest).any():  # distinct keys with one leading lane
        again = np.lexsort(lanes[::-1])
        order, lanes = order[again], [x[again] for x in lanes]
        same = np.ones(len(rest), bool)
        for x in lanes:
            same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(lanes[0])), bool), ~same]))
    if counts is None:
        sums = np.diff(np.append(first, len(order)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return [x[first] for x in lanes], sums.astype(np.int64)


def _cut(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each entry in whole bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _uncut(body: memoryview, m: int, bits: int) -> tuple[np.ndarray, memoryview]:
    width = -(-bits // 8)
    out = np.zeros((m, 8), np.uint8)
    out[:, :width] = np.frombuffer(body[: m * width], np.uint8).reshape(m, width)
    return out.reshape(-1).view("<u8"), body[m * width :]


def encode(lanes: Lanes, counts: np.ndarray, bits: int, n: int, width: int) -> bytes:
    """The filter of sorted distinct keys of one slice."""
    m, sizes = len(counts), lane_bits(n, width)
    quotient_bits = min(m.bit_length(), 64 - bits)
    rest = 64 - bits - quotient_bits
    quotient = (lanes[0] >> U64(rest)) & U64((1 << quotient_bits) - 1) if rest < 64 else np.zeros(m, np.uint64)
    unary = np.zeros(m + (1 << quotient_bits), np.uint8)
    unary[np.arange(m) + quotient.astype(np.int64)] = 1
    parts = [_HEAD.pack(m, bits, quotient_bits), np.packbits(unary).tobytes(), _cut(lanes[0] & U64((1 << rest) - 1), rest)]
    parts += [_cut(x >> U64(64 - b), b) for x, b in zip(lanes[1:], sizes[1:], strict=True)]
    large = counts >= LARGE
    parts += [np.where(large, LARGE, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    return b"".join(parts)


def decode(blob: bytes, part: int, n: int, width: int) -> tuple[Lanes, np.ndarray]:
    """Keys and counts of the filter of slice ``part``."""
    m, bits, quotient_bits = _HEAD.unpack_from(blob)
    body, sizes = memoryview(blob)[_HEAD.size :], lane_bits(n, width)
    length = m + (1 << quotient_bits)
    unary = np.unpackbits(np.frombuffer(body[: -(-length // 8)], np.uint8), count=length)
    quotient = (np.flatnonzero(unary) - np.arange(m)).astype(np.uint64)
    rest = 64 - bits - quotient_bits
    first, body = _uncut(body[-(-length // 8) :], m, rest)
    head = U64(part << 64 - bits) if bits else U64(0)
    lanes = [head | quotient << U64(rest) | first if rest < 64 else first]
    for b in sizes[1:]:
        x, body = _uncut(body, m, b)
        lanes.append(x << U64(64 - b))
    counts = np.frombuffer(body[:m], np.uint8).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(body[m:], "<i8")
    return lanes, counts


def slices(lanes: Lanes, counts: np.ndarray, bits: int, n: int, width: int) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct keys as the filters of their slices."""
    part = (lanes[0] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(counts), np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    for a, b in zip(first, np.append(first[1:], len(part)), strict=True):
        yield int(part[a]), encode([x[a:b] for x in lanes], counts[a:b], bits, n, width)


def merge(blobs: list[bytes], part: int, n: int, width: int) -> tuple[Lanes, np.ndarray]:
    """Sorted filters of one slice as one: keys and summed counts."""
    keys, counts = zip(*(decode(b, part, n, width) for b in blobs), strict=True)
    return summed([np.concatenate(x) for x in zip(*keys, strict=True)], np.concatenate(counts))

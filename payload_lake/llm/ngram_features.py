"""Hashed byte and character n-gram counts of whole texts, for the trained text models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Chunk, binary_column, chunks

LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32
#: white space of any kind is one symbol, and digits are one symbol
SOFT = LOWER.copy()
SOFT[[9, 10, 11, 12, 13]] = 32
SOFT[48:58] = 48


def gram_buckets(symbols: np.ndarray, sizes: tuple[int, ...], buckets: int) -> list[np.ndarray]:
    """For each n-gram size, the hash bucket of the n-gram that starts at each symbol (32 bits)."""
    out = []
    for n in sizes:
        m = len(symbols) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        code = np.zeros(m, np.uint32)
        for j in range(n):
            code = code * np.uint32(0x01000193) + symbols[j : j + m] + np.uint32(1 + n)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        out.append((code >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64))
    return out


def counts(chunk: Chunk, sizes: tuple[int, ...], buckets: int, fold: np.ndarray = SOFT) -> np.ndarray:
    """Counts of byte n-grams per row and bucket; ``buckets`` is a power of two. n-grams never cross rows."""
    return _counted(fold[chunk.data], chunk.offsets, sizes, buckets)


def char_counts(chunk: Chunk, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Counts of character n-grams (code points, lower-cased) per row and bucket.

    White space of any kind is one symbol, and so are ASCII digits; bytes that are
    no UTF-8 are symbols of their own.
    """
    texts = [bytes(chunk.data[a:b]).decode("utf-8", "surrogateescape").lower() for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = symbols < 128
    symbols = np.where(low, SOFT[np.where(low, symbols, 0)], symbols)
    return _counted(symbols, np.cumsum([0, *map(len, texts)]), sizes, buckets)


def _counted(symbols: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    rows = len(offsets) - 1
    out = np.zeros((rows, buckets), np.float32)
    grams = gram_buckets(symbols, sizes, buckets)
    for i in range(rows):
        a, b = offsets[i], offsets[i + 1]
        for n, found in zip(sizes, grams, strict=True):
            if b - a >= n:
                out[i] += np.bincount(found[a : b - n + 1], minlength=buckets)
    return out


def row_blocks(chunk: Chunk, rows: int) -> Iterator[Chunk]:
    """The chunk in pieces of at most ``rows`` rows."""
    for start in range(0, len(chunk.offsets) - 1, rows):
        o = chunk.offsets[start : start + rows + 1]
        yield Chunk(chunk.start + start, chunk.start + start + len(o) - 1, chunk.data[o[0] : o[-1]], o - o[0])


def bounded_sample(rows: DataFrame, most: int, order: Column) -> DataFrame:
    """At most ``most`` rows, the same ones every time: the first in the order of a hash."""
    return rows.orderBy(order).limit(most)


def sparse_rows(rows: DataFrame, terms: Callable[[Chunk], np.ndarray]) -> DataFrame:
    """``rows`` (text and other columns) with text replaced by its non-zero terms and their amounts, made on the executors."""
    others = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), "buckets array<int>, amounts array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, amount = [], []
            for chunk in chunks(binary_column(batch, "text")):
                for block in row_blocks(chunk, 256):
                    for x in terms(block):
                        at.append(np.flatnonzero(x).astype(np.int32))
                        amount.append(x[at[-1]])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.list_(pa.int32())), pa.array(amount, pa.list_(pa.float32()))], [*others, "buckets", "amounts"])

    return rows.select(*others, "text").mapInArrow(run, schema)


def dense(found: pa.Table, buckets: int) -> np.ndarray:
    """The collected sparse counts as a matrix."""
    out = np.zeros((found.num_rows, buckets), np.float32)
    for i, (at, amount) in enumerate(zip(found["buckets"], found["amounts"], strict=True)):
        out[i, at.values.to_numpy()] = amount.values.to_numpy()
    return out


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the hold-out rule of the trained models."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus

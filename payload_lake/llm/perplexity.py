"""Quality rules by n-gram perplexity.

Every document gets its perplexity under a model of word bigrams of its language
(modified Kneser-Ney, interpolated); documents outside a band of their language,
below or above, are rejected.

The model is trained on the documents that pass the base rules, and no document
is judged by itself: documents fall into two folds by their smallest hash of
two words, so copies and most near copies are in one fold, and each fold is
judged by the counts of the other. Words are 48-bit hashes without ASCII case.

The model grows with the corpus. Bigrams are dealt by their hash to buckets of
about ``BUCKET`` words of text and kept in Parquet as sorted arrays; each task
counts before the shuffle. What a word adds to its bigrams (share of
continuations, total and back-off weight as a context) is summed in the bucket of
the word and goes back to the buckets that ask for it. A bigram or word stays in
the model if one fold has learned it and a text of the other has it: the rest can
meet no text.

The log-probability of a text is that of as many unseen words, plus gains of the
words and bigrams that the model has. Words and bigrams beyond 1 / ``HOT`` of all
training words, of which there are fewer than ``HOT`` of each kind, are broadcast
and scored where the texts are, so that no frequent one gathers in a task; the
others meet their texts in their bucket. Beside these bounded tables only counts
of counts of each language are collected.

The band of a language is the median of the log-perplexity of its documents,
plus and minus ``width`` times their interquartile range (``floor`` at least),
over all documents that pass the base rules, as exact percentiles of a fine
histogram; ``below`` widens the lower side, where near copies stand, and
``short`` the band of documents with few words.

Defined cases: a null text has no words; documents without text have no
perplexity and fail the base rules; a null lang is a language of its own; where
the other fold has no text of a language, its words are equally likely; repeated
rows are counted and judged one by one; an empty table stays empty; further
columns are passed on by ``keep_good``.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .stage import settled, small_side, staged, table, trimmed
from .words import U64, Chunk, Words, binary_column, chunks, gram_hashes, mix, span_hashes, prefix_sums, word_hashes

#: bytes looked at together, and rows that are passed on together
CHUNK, ROWS = 2 << 20, 1000
#: words are 48 bits of a hash, and so are bigrams where texts meet them: that is what makes them short when sorted
KEPT_BITS = U64(2**64 - 2**16)
#: words that a task packs at once, and words of text for each bucket of bigrams
PACK, BUCKET = 3 << 19, 2 << 20
#: the fewest buckets, the fewest tasks that score a round of them, buckets of such a task beyond that, and sums that it holds
BUCKETS, FEWEST, TOGETHER, HELD = 12, 6, 3, 1 << 20
#: texts whose numbers fit below the 48 bits of a hash and above one bit
TEXTS = 1 << 15
#: bigrams in a row of the table of bigrams
SLICE = 1 << 20
#: words and bigrams that make up more than 1 / HOT of all training words, of which there are fewer than HOT, are broadcast
HOT = 1 << 17
#: rounds of buckets in which bigrams are counted, and in which documents are judged: each reads the texts again and shuffles a part of their bigrams
ROUNDS = 2
#: band of the registered query and the pipeline
BAND = {"width": 2.25, "floor": 0.1}
SIDES = {"below": 2.7, "short": 0}
#: kinds of blobs, in the order in which a task wants them
WORDS, IDS, PARTS, GRAMS, DOCS, PLACES, PAIRS = range(7)
ZSTD = pa.Codec("zstd", compression_level=1)


def discounts(of: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts of the counts 0, 1, 2 and 3 or more, from the numbers of entries counted 1 to 4 times."""
    y = of[0] / max(1.0, of[0] + 2 * of[1])
    return np.array([0.0] + [min(k, max(0.01, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0.5 for k in (1, 2, 3)])


class Level(NamedTuple):
    """Discounted shares of the n-grams of one order and back-off weights of their contexts, both in sorted arrays."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


class KneserNey:
    """Interpolated modified Kneser-Ney over n-gram codes in memory: the plain form of the method, for comparison.

    Lower orders use continuation counts.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, bits: int):
        self.order, self.bits = order, bits
        by = np.argsort(grams, kind="stable")
        grams, counts = grams[by].astype(np.int64), counts[by].astype(np.float64)
        self.levels: list[Level] = []
        for n in range(order, 0, -1):
            self.levels.insert(0, self._level(grams, counts))
            if n > 1:  # of how many longer n-grams each shorter one is the end
                grams, counts = np.unique(grams & (1 << bits * (n - 1)) - 1, return_counts=True)
                counts = counts.astype(np.float64)

    def _level(self, grams: np.ndarray, counts: np.ndarray) -> Level:
        discount = discounts([float((counts == k).sum()) for k in (1, 2, 3, 4)])
        cut = discount[np.minimum(counts, 3).astype(np.int64)]
        contexts, inverse = np.unique(grams >> self.bits, return_inverse=True)
        total = np.bincount(inverse, counts, len(contexts))
        return Level(grams, (counts - cut) / total[inverse], contexts, np.bincount(inverse, cut, len(contexts)) / total)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing) if len(keys) else np.full(len(wanted), missing)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram code, given those before it."""
        p = np.full(len(grams), 1.0 / (1 << self.bits))
        for n, level in enumerate(self.levels, 1):
            own = grams & (1 << self.bits * n) - 1
            p = self._find(level.grams, level.share, own, 0.0) + self._find(level.contexts, level.backoff, own >> self.bits, 1.0) * p
        return p


def _lang_hash(lang: str | None) -> int:
    return 0 if lang is None else int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


class Read(NamedTuple):
    """Words of a chunk as hashes, and of each row its language and fold."""

    chunk: Chunk
    hashes: np.ndarray
    words: Words
    langs: list
    folds: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        """Of each row a key of text and language; its last bit is the fold."""
        data, offsets = self.chunk.data, self.chunk.offsets.tolist()
        whole = b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in pairwise(offsets))
        named = {x: _lang_hash(x) for x in set(self.langs)}
        return mix(np.frombuffer(whole, np.uint64) + np.array([named[x] for x in self.langs], np.uint64)) & ~U64(1) | self.folds


def read(chunk: Chunk, langs: list) -> Read:
    hashes, w = word_hashes(chunk, lower=True)
    hashes &= KEPT_BITS
    full = np.diff(w.rows) > 0
    least = np.zeros(len(full), np.uint64)
    if len(hashes):
        two = np.empty(len(hashes), np.uint64)
        two[:-1] = gram_hashes(hashes, 2)
        last = w.rows[1:][full] - 1
        two[last] = mix(hashes[last]) | U64(1 << 63)
        least[full] = np.minimum.reduceat(two, w.rows[:-1][full])
    return Read(chunk, hashes, w, langs, mix(least) & U64(1))


def _bigrams(r: Read) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (0 before the first of a row) and 48 bits of the hash of both."""
    before = np.zeros(len(r.hashes), np.uint64)
    before[1:] = r.hashes[:-1]
    before[r.words.rows[:-1][np.diff(r.words.rows) > 0]] = 0
    return before, _joined(before, r.hashes) & KEPT_BITS


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _order(x: np.ndarray) -> np.ndarray:
    """The places of 64-bit numbers in ascending order: their leading bits are sorted with the places below them, then what that left open."""
    low = U64((1 << len(x).bit_length()) - 1)
    by = x & ~low | np.arange(len(x), dtype=np.uint64)
    by.sort()
    by = (by & low).view(np.int64)
    ordered = x[by]
    return by[np.argsort(ordered, kind="stable")] if (ordered[1:] < ordered[:-1]).any() else by


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit numbers in ascending order, and the place of each number among them."""
    by = _order(x)
    x = x[by]
    at = _starts(x)
    place = np.empty(len(x), np.int64)
    place[by] = np.repeat(np.arange(len(at)), np.diff(at, append=len(x)))
    return x[at], place


def _squeeze(x: np.ndarray, ascending: bool = False) -> bytes:
    """The array in few bytes: differences if it ascends, integers (none below 0) as wide as the greatest, bytes of the same place together, compressed."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else x.ravel()
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))), copy=False)
    single = x.view(np.uint8).reshape(-1, x.itemsize)
    raw = np.empty(single.shape[::-1], np.uint8)
    for k in range(x.itemsize):
        raw[k] = single[:, k]
    return x.nbytes.to_bytes(8, "little") + x.itemsize.to_bytes(1, "little") + ZSTD.compress(raw, asbytes=True)


def _unsqueeze(body: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    size, wide = int.from_bytes(body[:8], "little"), body[8]
    raw = np.frombuffer(ZSTD.decompress(memoryview(body)[9:], size, asbytes=True), np.uint8).reshape(wide, -1)
    single = np.empty(raw.shape[::-1], np.uint8)
    for k in range(wide):
        single[:, k] = raw[k]
    x = single.view(kind if np.dtype(kind).kind == "f" else f"u{wide}").ravel()
    return np.cumsum(x, dtype=kind) if ascending else x.astype(kind, copy=False)


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) + word)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return (hashes >> U64(32)) * U64(buckets) >> U64(32)


def _inside(hashes: np.ndarray, buckets: int, low: int, high: int) -> np.ndarray:
    """Which hashes are of the buckets from ``low`` to before ``high``."""
    first, end = (-(-(b << 32) // buckets) << 32 for b in (low, high))
    return hashes - U64(first) <= U64(end - first - 1)


def _ranges(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Bucket and place of each range of sorted hashes."""
    cuts = np.searchsorted(_bucket_of(hashes, buckets), np.arange(buckets + 1).astype(np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(int(cuts[b]), int(cuts[b + 1]))


#: columns of the blobs of all kinds; what they hold is said where they are made
BLOB = "lang string, bucket int, kind int, source int, a binary, b binary, c binary, d binary, `of` array<long>"
ARROW_BLOB = pa.schema([("lang", pa.string()), *((c, pa.int32()) for c in ("bucket", "kind", "source")), *((c, pa.binary()) for c in "abcd"), ("of", pa.list_(pa.int64()))])


def _blob(lang: str | None, bucket: int, kind: int, bodies: list[bytes], source: int = 0, of: list[int] | None = None) -> dict:
    return {"lang": lang, "bucket": bucket, "kind": kind, "source": source, "of": of} | dict(zip("abcd", bodies, strict=False))


def _passed_on(make):
    """``make``, with its blobs in batches of some megabytes."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for blob in make(batches):
            waiting.append(blob)
            size += sum(len(blob.get(c) or b"") for c in "abcd")
            if len(waiting) >= ROWS or size >= CHUNK:
                yield pa.RecordBatch.from_pylist(waiting, schema=ARROW_BLOB)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=ARROW_BLOB)

    return run


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            yield {c: x[i].as_py() for c, x in columns.items()}


def _of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, Iterator[dict]]]:
    for (lang, bucket), rows in groupby(_blobs(batches), lambda r: (r["lang"], r["bucket"])):
        yield lang, bucket, rows


def _dealt(df: DataFrame, low: int, high: int, tasks: int) -> DataFrame:
    """The blobs of the buckets from ``low`` to before ``high``: neighbouring buckets to each task, sorted by language, bucket and kind."""
    task = F.floor((F.col("bucket") - low) * tasks / (high - low)).cast("int")
    return df.repartitionById(tasks, task).sortWithinPartitions("lang", "bucket", "kind")


def _rounds(buckets: int) -> list[tuple[int, int]]:
    """Ranges of buckets that are worked on one after the other."""
    rounds = min(ROUNDS, buckets)
    return [(i * buckets // rounds, (i + 1) * buckets // rounds) for i in range(rounds)]


def _grams(ids: np.ndarray, first: np.ndarray, second: np.ndarray, numbers: list[np.ndarray], kind: type = np.int64) -> list[bytes]:
    """Bigrams of sorted words: the words, places of both words in them, and numbers of each."""
    wide = len(ids).bit_length()
    by = _order((first << wide | second).astype(np.uint64) << U64(64 - 2 * wide))
    return [_squeeze(ids, True), _squeeze(first[by].astype(np.int32), True), _squeeze(second[by].astype(np.int32)), _squeeze(np.stack([x[by] for x in numbers]).astype(kind))]


def _ungrams(rows: list[dict], numbers: int, kind: type = np.int64) -> list[np.ndarray]:
    """First and second words of all blobs and their numbers, sorted by the hash of both words, which comes first."""
    parts = []
    for r in rows:
        ids, first, second = _unsqueeze(r["a"], np.uint64, True), _unsqueeze(r["b"], np.int32, True), _unsqueeze(r["c"], np.int32)
        parts.append((ids[first], ids[second], *_unsqueeze(r["d"], kind).reshape(numbers, -1)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    parts.clear()  # each column is held once from here on
    gram = _joined(*columns[:2])
    by = _order(gram)
    columns.insert(0, gram)
    del gram
    for k, c in enumerate(columns):
        columns[k] = c[by]
    return columns


def _by_language(batches: Iterator[pa.RecordBatch], of_chunk, flush) -> Iterator[dict]:
    """``flush`` of what ``of_chunk`` gives for the rows of each language, once about ``PACK`` words have come together."""
    parts, waiting = defaultdict(list), 0
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for chunk in chunks(binary_column(batch, "text"), CHUNK):
            r = read(chunk, langs[chunk.start : chunk.stop])
            number_of = {x: i for i, x in enumerate(dict.fromkeys(r.langs))}
            names = np.array([number_of[x] for x in r.langs])
            found = of_chunk(chunk, r)
            for lang, i in number_of.items():
                own = found(lang, names == i)
                parts[lang].append(own)
                waiting += len(own[0])
            if waiting >= PACK:
                for lang, own in parts.items():
                    yield from flush(lang, own)
                parts, waiting = defaultdict(list), 0
    for lang, own in parts.items():
        yield from flush(lang, own)


def _counts(buckets: int, low: int, high: int):
    """Bigrams of texts by language and bucket, from ``low`` to before ``high``: training counts of both folds, and bits for the folds of which a text has it."""

    def of_chunk(chunk: Chunk, r: Read):
        before, gram = _bigrams(r)
        wanted = _inside(gram, buckets, low, high)
        size = np.diff(r.words.rows)
        code = np.repeat(r.folds.astype(np.uint8) << 1 | passing(r).astype(np.uint8), size)

        def own(_, rows: np.ndarray) -> tuple[np.ndarray, ...]:
            at = np.flatnonzero(np.repeat(rows, size) & wanted)
            return before[at], r.hashes[at], code[at]

        return own

    def flush(lang, parts: list) -> Iterator[dict]:
        before, word, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()  # the columns are held once from here on
        gram = _joined(before, word)
        by = _order(gram)
        gram, code = gram[by], code[by]
        at = _starts(gram)
        if not len(at):
            return
        gram = gram[at]
        numbers = [np.add.reduceat(code == k, at, dtype=np.int32) for k in (1, 3)] + [np.bitwise_or.reduceat(np.uint8(1) << (code >> 1), at).astype(np.int32)]
        by = by[at]
        before, word = before[by], word[by]
        for b, own in _ranges(gram, buckets):
            ids, place = _distinct(np.concatenate([before[own], word[own]]))
            half = own.stop - own.start
            yield _blob(lang, b, GRAMS, _grams(ids, place[:half], place[half:], [x[own] for x in numbers], np.int32))

    return _passed_on(lambda batches: _by_language(batches, of_chunk, flush))


def _merge(buckets: int):
    """Of each bucket of bigrams: those that some text can meet (GRAMS), counts of counts, and what all of them say about their words (WORDS).

    A bigram is of use where one fold has learned it and a text of the other has it.
    WORDS go to the buckets of the words: continuations, totals and numbers of small
    counts as a context for both folds, folds seen, and whether the bucket asks back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lang, bucket, rows in _of_bucket(batches):
            gram, before, word, n0, n1, folds = _ungrams(list(rows), 3, np.int32)
            at = _starts(gram)
            before, word = before[at], word[at]
            n = [np.add.reduceat(x, at, dtype=np.int64) for x in (n0, n1)]
            folds = np.bitwise_or.reduceat(folds, at)
            seen = [folds & 1 > 0, folds & 2 > 0]
            used = (n[0] > 0) & seen[1] | (n[1] > 0) & seen[0]
            ids, place = _distinct(np.concatenate([before, word]))
            first, second = place[: len(before)], place[len(before) :]
            asked = np.zeros(len(ids), bool)
            asked[first[used]] = asked[second[used]] = True
            count = lambda where, weight: np.bincount(where, weight, len(ids))  # noqa: B023, E731
            about = [count(second, x > 0) for x in n] + [count(first, x) for x in n]
            about += [count(first, hit) for x in n for hit in (x == 1, x == 2, x >= 3)]
            about += [count(second, x) > 0 for x in seen] + [asked]
            about = np.stack(about).astype(np.int64)
            of = [int((x == k).sum()) for x in n for k in (1, 2, 3, 4)]
            for k, start in enumerate(range(0, max(1, int(used.sum())), SLICE)):
                own = np.flatnonzero(used)[start : start + SLICE]
                names, spot = _distinct(np.concatenate([before[own], word[own]]))
                yield _blob(lang, bucket, GRAMS, _grams(names, spot[: len(own)], spot[len(own) :], [x[own] for x in n]), of=None if k else of)
            for b, own in _ranges(ids, buckets):
                yield _blob(lang, b, WORDS, [_squeeze(ids[own], True), _squeeze(about[:, own])], source=bucket)

    return _passed_on(run)


#: rows of the numbers of a word
M, TOTAL, SMALL, SEEN, ASKED = slice(0, 2), slice(2, 4), slice(4, 10), slice(10, 12), 12


@_passed_on
def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Words of each bucket with the sums of their numbers: those that texts can meet (IDS), and answers to the buckets that asked (PARTS).

    ``of``: numbers of words with 1 to 4 and 3 or more continuations and all continuations, of both folds; the words; the numbers of the start.
    """
    for lang, bucket, rows in _of_bucket(batches):
        found = [(r["source"], _unsqueeze(r["a"], np.uint64, True), _unsqueeze(r["b"], np.int64).reshape(13, -1)) for r in rows]
        ids, place = _distinct(np.concatenate([f[1] for f in found]))
        parts = np.concatenate([f[2] for f in found], axis=1)
        sums = np.stack([np.bincount(place, x, len(ids)) for x in parts]).astype(np.int64)
        m, total, seen = sums[M], sums[TOTAL], sums[SEEN] > 0
        of = [int(x) for k in m for x in (*((k == c).sum() for c in (1, 2, 3, 4)), (k >= 3).sum(), k.sum())] + [len(ids)]
        of += sums[2:10, 0].tolist() if len(ids) and ids[0] == 0 else [0] * 8
        met = ((m + total)[::-1] > 0) & seen
        kept = met.any(axis=0) & (ids != 0)
        yield _blob(lang, bucket, IDS, [_squeeze(ids[kept], True), _squeeze(sums[:10, kept])], of=of)
        for source, own, numbers in found:
            asked = own[numbers[ASKED] > 0]
            if len(asked):
                yield _blob(lang, source, PARTS, [_squeeze(asked, True), _squeeze(sums[:10, np.searchsorted(ids, asked)])])


class Law(NamedTuple):
    """Of a language and a fold: discounts of bigrams and of continuations, all continuations, the share of an unseen word, and the back-off of the start."""

    grams: np.ndarray
    words: np.ndarray
    all: float
    unseen: float
    start: float


def _laws(of_grams: dict, of_words: dict) -> dict:
    """The laws of both folds of each language, from counts of counts."""
    out = {}
    for lang, of in of_words.items():
        laws = []
        for f in (0, 1):
            d2 = discounts([float(x) for x in of_grams[lang][4 * f : 4 * f + 4]])
            n1, n2, n3, n4, more, total = of[6 * f : 6 * f + 6]
            d1 = discounts([float(x) for x in (n1, n2, n3, n4)])
            rest = float(np.dot(d1[1:], [n1, n2, more]) / total) if total else 1.0
            begun, small = of[13 + f], of[15 + 3 * f : 18 + 3 * f]
            laws.append(Law(d2, d1, max(1.0, total), rest / (of[12] + 1), float(np.dot(d2[1:], small) / begun) if begun else 1.0))
        out[lang] = laws
    return out


def _of_words(law: Law, numbers: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of continuations with that of an unseen word, back-off weight and total of words in fold f."""
    m, total = numbers[M][f], numbers[TOTAL][f]
    low = (m - law.words[np.minimum(m, 3)]) / law.all + law.unseen
    kept = law.grams[1:] @ numbers[SMALL][3 * f : 3 * f + 3]
    return low, np.where(total > 0, kept / np.maximum(total, 1), 1.0), total


def _finish(laws: dict, least: float):
    """Gains in log-probability over an unseen word after an unseen context, for texts of both folds: of words, as the last one and as the context (WORDS), and of bigrams over their words (GRAMS); with the places of the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for lang, bucket, rows in _of_bucket(batches):
            by_kind = defaultdict(list)
            for r in rows:
                by_kind[r["kind"]].append(r)
            for r in by_kind[IDS]:
                ids, numbers = _unsqueeze(r["a"], np.uint64, True), _unsqueeze(r["b"], np.int64).reshape(10, -1)
                gains = np.zeros((4, len(ids)))
                for f in (0, 1):  # a text of fold f is judged by the other
                    law = laws[lang][1 - f]
                    low, back, _ = _of_words(law, numbers, 1 - f)
                    gains[f], gains[2 + f] = np.log(low / law.unseen), np.log(back)
                hot = np.flatnonzero(numbers[TOTAL].sum(axis=0) >= least).astype(np.int32)
                if len(ids):
                    yield _blob(lang, bucket, WORDS, [_squeeze(ids, True), _squeeze(gains), _squeeze(hot)])
            if not by_kind[PARTS]:
                continue
            ids = np.concatenate([_unsqueeze(r["a"], np.uint64, True) for r in by_kind[PARTS]])
            numbers = np.concatenate([_unsqueeze(r["b"], np.int64).reshape(10, -1) for r in by_kind[PARTS]], axis=1)
            by = _order(ids)
            ids, numbers = ids[by], numbers[:, by]
            gram, before, word, *n = _ungrams(by_kind[GRAMS], 2)
            context, last = np.searchsorted(ids, before), np.searchsorted(ids, word)
            gains = np.zeros((2, len(gram)))
            for f in (0, 1):
                law = laws[lang][1 - f]
                low, back, total = _of_words(law, numbers, 1 - f)
                share = (n[1 - f] - law.grams[np.minimum(n[1 - f], 3)]) / np.maximum(total[context], 1)
                gains[f] = np.log1p(share / (back[context] * low[last]))
            hot = np.flatnonzero(n[0] + n[1] >= least).astype(np.int32)
            yield _blob(lang, bucket, GRAMS, [_squeeze(gram & KEPT_BITS, True), _squeeze(gains), _squeeze(hot)])

    return _passed_on(run)


@trimmed
def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frequent words and bigrams of the finished blobs, one row for each."""
    for r in _blobs(batches):
        hot = _unsqueeze(r["c"], np.int32)
        hashes, gains = _unsqueeze(r["a"], np.uint64, True)[hot], _unsqueeze(r["b"], np.float64)
        gains = gains.reshape(-1, len(gains) // (4 if r["kind"] == WORDS else 2))[:, hot]
        gains = np.concatenate([gains, np.zeros((4 - len(gains), len(hot)))])
        yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(hot), pa.string()), pa.array([r["kind"]] * len(hot), pa.int32()), pa.array(hashes.view(np.int64)), *(pa.array(g) for g in gains)], ["lang", "kind", "hash", "g0", "g1", "g2", "g3"])


class Table(NamedTuple):
    """Sorted hashes and their gains; a hash that is not there gains nothing. ``leads``: the places of the first hash with each leading bits, for hashes that are looked up in no order."""

    hashes: np.ndarray
    gains: np.ndarray
    leads: np.ndarray | None = None

    def with_leads(self) -> Table:
        bits = len(self.hashes).bit_length() + 1
        leads = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << U64(64 - bits))
        return self._replace(leads=np.minimum(leads, len(self.hashes) - 1))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted are there, and their places."""
        if not len(self.hashes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        end = len(self.hashes) - 1
        if self.leads is None:
            at = np.minimum(np.searchsorted(self.hashes, wanted), end)
            return self.hashes[at] == wanted, at
        at = self.leads[wanted >> U64(65 - len(self.leads).bit_length())]
        behind = np.flatnonzero(self.hashes[at] < wanted)
        while len(behind):
            behind = behind[at[behind] < end]
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < wanted[behind]]
        return self.hashes[at] == wanted, at


class Model(NamedTuple):
    """Gains of words and bigrams by language and bucket (BLOB), the frequent ones of each language and kind, laws of each language, number of buckets."""

    gains: DataFrame
    hot: dict
    laws: dict
    buckets: int


def _written(df: DataFrame, name: str) -> DataFrame:
    """``staged``, after which the shuffle files of that write are removed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(key, before)


def _added(df: DataFrame) -> dict:
    """The sums of ``of`` by language."""
    size = df.select(F.size("of")).where(F.col("of").isNotNull()).first()
    if size is None:
        return {}
    rows = df.where(F.col("of").isNotNull()).groupBy("lang").agg(*(F.sum(F.col("of")[k]).alias(f"c{k}") for k in range(size[0]))).collect()
    return {r["lang"]: [int(x) for x in r[1:]] for r in rows}


def train(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> Model:
    """A model of the texts of ``docs`` that pass the base rules; it has what the other texts of ``docs`` can meet of it."""
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(BUCKETS, math.ceil(total / 6 / bucket))
    laws: dict = {}

    def finished() -> DataFrame:
        parts = []
        for low, high in _rounds(buckets):
            packed = docs.select("text", "lang").mapInArrow(_counts(buckets, low, high), BLOB)
            parts.append(_written(_dealt(packed, low, high, high - low).mapInArrow(_merge(buckets), BLOB), "bigram-counts"))
        counted = reduce(DataFrame.unionByName, parts)
        words = _written(_dealt(counted.where(F.col("kind") == WORDS), 0, buckets, buckets).mapInArrow(_merge_words, BLOB), "word-counts")
        of_grams = _added(counted.where(F.col("kind") == GRAMS))
        of_words = _added(words.where(F.col("kind") == IDS))
        laws.update(_laws(of_grams, of_words))
        tokens = sum(x[13] + x[14] for x in of_words.values()) and words.where(F.col("kind") == IDS).select(F.sum(F.col("of")[5] + F.col("of")[11])).first()[0]
        least = max(64.0, (tokens or 0) / hot)
        parts = words.unionByName(counted.where(F.col("kind") == GRAMS))
        return _dealt(parts, 0, buckets, buckets).mapInArrow(_finish(laws, least), BLOB)

    gains = settled(finished, "gains")
    rows = gains.mapInArrow(_hot_rows, "lang string, kind int, hash long, g0 double, g1 double, g2 double, g3 double").toArrow().to_pandas()
    frequent = {}
    for (lang, kind), own in rows.groupby(["lang", "kind"], dropna=False, sort=False):
        hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(hashes)
        frequent[lang if isinstance(lang, str) else None, int(kind)] = Table(hashes[by], own[["g0", "g1", "g2", "g3"]].to_numpy().T[:, by])
    return Model(gains, frequent, laws, buckets)


NO_TABLE = Table(np.zeros(0, np.uint64), np.zeros((4, 0)))


def _pairs(hot, buckets: int, low: int, high: int):
    """Of texts by language: gains of frequent words and bigrams (DOCS, in the first round), and the other words (PLACES) and bigrams (PAIRS) of the buckets from ``low`` to before ``high`` with their texts."""

    tables: dict = {}

    def of_chunk(chunk: Chunk, r: Read):
        if not tables:
            tables.update({k: t.with_leads() for k, t in hot.value.items()})
        _, gram = _bigrams(r)
        size = np.diff(r.words.rows)
        row = np.repeat(np.arange(len(size)), size)
        context = np.ones(len(row), bool)
        context[r.words.rows[1:][size > 0] - 1] = False
        inside = [_inside(x, buckets, low, high) for x in (gram, r.hashes)]
        keys = r.keys

        def own(lang, rows: np.ndarray) -> tuple[np.ndarray, ...]:
            mine, number = rows[row], np.cumsum(rows) - 1
            gain, out = np.zeros(int(rows.sum())), []
            for kind, hashes, here in ((GRAMS, gram, inside[0]), (WORDS, r.hashes, inside[1])):
                table = tables.get((lang, kind), NO_TABLE)
                at = np.flatnonzero(mine if low == 0 else mine & here)
                known, spot = table.find(hashes[at])
                if low == 0:
                    hit, spot = at[known], spot[known]
                    f, doc = r.folds[row[hit]].astype(np.int64), number[row[hit]]
                    gain += np.bincount(doc, table.gains[f, spot], len(gain))
                    if kind == WORDS:
                        gain += np.bincount(doc, table.gains[2 + f, spot] * context[hit], len(gain))
                rare = at[~known & here[at]]
                out += [hashes[rare], number[row[rare]]]
            return *out, context[rare], keys[rows], gain

        return own

    def flush(lang, parts: list) -> Iterator[dict]:
        before = np.cumsum([0, *(len(p[5]) for p in parts)])
        keys, gain = (np.concatenate([p[k] for p in parts]) for k in (5, 6))
        if low == 0 and len(keys):
            yield _blob(lang, int(_bucket_of(keys[:1], high)[0]), DOCS, [_squeeze(keys), _squeeze(gain)])
        for kind, h, d in ((PAIRS, 0, 1), (PLACES, 2, 3)):
            hashes = np.concatenate([p[h] for p in parts])
            doc = np.concatenate([p[d] + n for p, n in zip(parts, before, strict=False)])
            follows = np.concatenate([p[4] for p in parts]) if kind == PLACES else np.zeros(len(doc), bool)
            for first in range(0, len(keys), TEXTS):  # a hash of 48 bits, its text and whether a word follows are sorted as one number
                of = slice(None) if len(keys) <= TEXTS else np.flatnonzero((doc >= first) & (doc < first + TEXTS))
                packed = hashes[of] | (doc[of] - first).astype(np.uint64) << U64(1) | follows[of].astype(np.uint64)
                packed.sort()
                at = _starts(packed >> U64(1))
                if not len(at):
                    continue
                many = [np.diff(at, append=len(packed))]
                if kind == PLACES:
                    many.append(np.add.reduceat((packed & U64(1)).astype(np.int64), at))
                packed = packed[at]
                found, text = packed & KEPT_BITS, (packed >> U64(1)).astype(np.int64) & TEXTS - 1
                for b, own in _ranges(found, buckets):
                    begin = _starts(found[own])
                    sizes = np.diff(begin, append=own.stop - own.start)
                    met = np.zeros(min(TEXTS, len(keys)), bool)
                    met[text[own]] = True
                    local = (np.cumsum(met) - 1)[text[own]]
                    yield _blob(lang, b, kind, [_squeeze(found[own][begin], True), _squeeze(sizes), _squeeze(np.stack([local, *(x[own] for x in many)])), _squeeze(keys[first + np.flatnonzero(met)])])

    return _passed_on(lambda batches: _by_language(batches, of_chunk, flush))


@trimmed
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of each text, gain, and number of texts with that key, summed over the buckets of a task as far as it holds them."""
    waiting: list[tuple[np.ndarray, ...]] = []

    def summed() -> tuple[np.ndarray, ...]:
        keys, gain, copies = (np.concatenate(x) for x in zip(*waiting, strict=True))
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, gain, len(keys)).astype(np.float64), np.bincount(place, copies, len(keys)).astype(np.int64)

    def out() -> pa.RecordBatch:
        keys, gain, copies = summed()
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(gain), pa.array(copies)], ["__own", "gain", "copies"])

    for _, _, rows in _of_bucket(batches):
        tables = {GRAMS: NO_TABLE, WORDS: NO_TABLE}
        for r in rows:
            kind = r["kind"]
            if kind in (WORDS, GRAMS):
                hashes, gains = _unsqueeze(r["a"], np.uint64, True), _unsqueeze(r["b"], np.float64)
                tables[kind] = Table(hashes, gains.reshape(4 if kind == WORDS else 2, -1))
                continue
            if kind == DOCS:
                keys = _unsqueeze(r["a"], np.uint64)
                waiting.append((keys, _unsqueeze(r["b"], np.float64), np.ones(len(keys), np.int64)))
            else:
                table = tables[GRAMS if kind == PAIRS else WORDS]
                keys = _unsqueeze(r["d"], np.uint64)
                doc, *many = _unsqueeze(r["c"], np.int32).reshape(2 if kind == PAIRS else 3, -1)
                known, at = table.find(_unsqueeze(r["a"], np.uint64, True))
                sizes = _unsqueeze(r["b"], np.int32)
                known, at = np.repeat(known, sizes), np.repeat(at, sizes)
                doc, at, many = doc[known], at[known], [x[known] for x in many]
                f = (keys & U64(1)).astype(np.int64)[doc]
                gain = np.bincount(doc, sum((table.gains[2 * k + f, at] * x for k, x in enumerate(many)), np.zeros(len(doc))), len(keys)).astype(np.float64)
                met = gain != 0
                waiting.append((keys[met], gain[met], np.zeros(int(met.sum()), np.int64)))
            if sum(len(w[0]) for w in waiting) > 4 * HELD:
                waiting[:] = [summed()]
                if len(waiting[0][0]) > HELD:
                    yield out()
    if waiting:
        yield out()


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """__own (key of a text and its language), gain and copies; ``docs`` must be those of the model."""
    hot = docs.sparkSession.sparkContext.broadcast(model.hot)
    sums = []
    for low, high in _rounds(model.buckets):
        pairs = docs.select("text", "lang").mapInArrow(_pairs(hot, model.buckets, low, high), BLOB)
        own = model.gains.where(F.col("bucket").between(low, high - 1))
        found = _dealt(own.unionByName(pairs), low, high, max(min(FEWEST, high - low), math.ceil((high - low) / TOGETHER))).mapInArrow(_sums, "__own long, gain double, copies long")
        sums.append(_written(found.groupBy("__own").agg(F.sum("gain").alias("gain"), F.sum("copies").alias("copies")), "document-sums"))
    whole = reduce(DataFrame.unionByName, sums).groupBy("__own")
    return whole.agg(F.sum("gain").alias("gain"), F.sum("copies").alias("copies"))


SIGN = np.zeros(256, bool)
SIGN[list(b"#*$%&|<>")] = True


def _repeated(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row, how many words are in windows of three that it has twice; ``rows`` says where the words of each begin."""
    size = np.diff(rows)
    if len(hashes) < 3:
        return np.zeros(len(size), np.int64)
    inside = np.ones(len(hashes), bool)
    inside[rows[1:][size > 0] - 1] = False
    inside[rows[1:][size > 1] - 2] = False
    of = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(inside)
    windows = gram_hashes(hashes, 3)[inside] + mix(np.arange(len(size), dtype=np.uint64) + U64(1))[of[inside]]  # equal windows of different rows are different
    by = _order(windows)
    ordered = windows[by]
    same = np.zeros(len(by) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice = inside[by[same[1:] | same[:-1]]]
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[twice + j] = True
    return np.bincount(of[covered], minlength=len(size))


def passing(r: Read) -> np.ndarray:
    """Which rows pass the base rules. No row has fewer repeated words without case, so only those that fail so are looked at as they are written."""
    size = np.diff(r.words.rows)
    failed = base_failed(size, _repeated(r.hashes, r.words.rows))
    doubted = np.flatnonzero(failed & (size >= 50))
    if len(doubted):
        own = [r.chunk.data[a:b] for a, b in zip(r.chunk.offsets[doubted], r.chunk.offsets[doubted + 1], strict=True)]
        hashes, w = word_hashes(Chunk(0, len(own), np.concatenate(own), np.cumsum([0, *map(len, own)])))
        failed[doubted] = base_failed(size[doubted], _repeated(hashes, w.rows))
    return ~failed


def base_features(chunk: Chunk, w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    data, offsets = chunk.data, chunk.offsets
    rows = len(offsets) - 1
    sums, down = prefix_sums(data)
    begins_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(begins_char[w.ends] - begins_char[w.starts])])
    signs = np.concatenate([[0], np.cumsum(SIGN[data])])
    salt = mix(np.arange(rows, dtype=np.uint64) + U64(1))  # equal lines of different rows are different
    # lines with a word that equal an earlier one of their row
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    by = np.lexsort([starts, row])
    starts, row = starts[by], row[by]
    last = np.append(row[1:] != row[:-1], True) if rows else np.zeros(0, bool)
    ends = np.where(last, offsets[1:][row], np.append(starts[1:], 1) - 1)
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    row = row[full]
    lines = span_hashes(sums, down, starts[full], ends[full]) + salt[row]
    _, first = np.unique(lines, return_index=True)
    dup = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    repeated = _repeated(span_hashes(sums, down, w.starts, w.ends), w.rows)
    return {"n_words": np.diff(w.rows), "word_chars": chars[w.rows[1:]] - chars[w.rows[:-1]], "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]], "n_dup_lines": dup, "n_repeat_words": repeated}


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def features(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs`` plus the base features, base_failed and __key; without text unless ``keep_text``."""
    own = [*(T.StructField(c, T.LongType()) for c in FEATURES), T.StructField("base_failed", T.BooleanType()), T.StructField("__key", T.LongType())]
    passed = [f for f in docs.schema.fields if f.name not in {*(f.name for f in own), "log_perplexity"}]
    shown = [f for f in passed if keep_text or f.name != "text"]
    schema = T.StructType([*shown, *own])
    arrow = to_arrow_schema(schema)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {c: [] for c in (*FEATURES, "__key")}
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for chunk in chunks(binary_column(batch, "text"), CHUNK):
                r = read(chunk, langs[chunk.start : chunk.stop])
                for c, values in (base_features(chunk, r.words) | {"__key": r.keys.view(np.int64)}).items():
                    parts[c].append(values)
            found = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in parts.items()}
            found["base_failed"] = base_failed(found["n_words"], found["n_repeat_words"])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in shown]
            made = [pa.array(found[f.name]).cast(arrow.field(f.name).type) for f in own]
            yield pa.RecordBatch.from_arrays(columns + made, schema=arrow)

    return docs.select(*(F.col(f"`{f.name}`") for f in passed)).mapInArrow(run, schema)


def with_perplexity(found: DataFrame, docs: DataFrame, model: Model) -> DataFrame:
    """``found`` (features of ``docs``, which are those of the model) plus log_perplexity; __key stays."""
    named = [(lang, f, float(-np.log(laws[1 - f].unseen)), float(np.log(laws[1 - f].start))) for lang, laws in model.laws.items() for f in (0, 1)]
    limits = docs.sparkSession.createDataFrame(named, "__lang string, __fold int, __unseen double, __start double")
    gains = perplexities(docs, model)
    fold = (F.col("__key").bitwiseAND(F.lit(1))).cast("int")
    rows = found.join(gains, F.col("__key") == F.col("__own"), "left").join(small_side(limits), F.col("lang").eqNullSafe(F.col("__lang")) & (fold == F.col("__fold")), "left")
    n = F.col("n_words")
    cost = n * F.col("__unseen") - F.col("__start") - F.coalesce(F.col("gain") / F.col("copies"), F.lit(0.0))
    return rows.withColumn("log_perplexity", F.when(n > 0, cost / n)).drop("__own", "gain", "copies", "__lang", "__fold", "__unseen", "__start")


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` (those of the model) plus the base features, base_failed and log_perplexity; without text unless ``keep_text``."""
    return with_perplexity(staged(features(docs, keep_text), "features"), docs, model).drop("__key")


def bands(scored: DataFrame, width: float = 3.5, floor: float = 0.02, bins: int = 1000) -> DataFrame:
    """lang, middle and spread: middle +- spread is the band of log-perplexity of a long text.

    Percentiles come from counts per language and 1/``bins`` of a nat, which are
    summed before the shuffle: a language with most rows costs no more than one
    with few.
    """
    counts = (
        scored.where("not base_failed and log_perplexity is not null")
        .groupBy("lang", F.floor(F.col("log_perplexity") * bins).alias("bin")).agg(F.count("*").alias("n"))
    )
    at = F.expr("percentile(bin, array(0.25, 0.5, 0.75), n)")
    quartiles = counts.groupBy("lang").agg(at.alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / bins, F.lit(floor)) * width
    middle = (F.col("q")[1] + 0.5) / bins
    return quartiles.select("lang", middle.alias("middle"), spread.alias("spread"))


def with_verdict(scored: DataFrame, limits: DataFrame, short: int = 200, below: float = 1.0) -> DataFrame:
    """``scored`` plus kept: false if the base rules fail or the perplexity is outside the band of its language, ``below`` times as wide on the lower side."""
    sides = small_side(staged(limits.select(F.col("lang").alias("__lang"), F.col("middle").alias("__middle"), F.col("spread").alias("__spread")), "bands"))
    wide = F.col("__spread") * F.sqrt(1 + short / F.greatest(F.col("n_words"), F.lit(1)))
    off = F.col("log_perplexity") - F.col("__middle")
    inside = (off <= wide) & (-off <= below * wide)
    joined = scored.drop("kept").join(sides, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("__lang", "__middle", "__spread")


def keyed(docs: DataFrame) -> DataFrame:
    """__row, the columns of ``docs`` as one struct, and __key."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    schema = T.StructType([rows.schema["__row"], T.StructField("__key", T.LongType())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):  # the texts of few rows are held twice
                row = whole.column(0).slice(start, ROWS)
                batch = pa.RecordBatch.from_arrays(row.flatten(), [f.name for f in row.type])
                langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
                keys = [read(chunk, langs[chunk.start : chunk.stop]).keys.view(np.int64) for chunk in chunks(binary_column(batch, "text"), CHUNK)]
                yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(keys))], ["__row", "__key"])

    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` (text, lang and any others) that pass base rules and perplexity bands."""

    def good() -> DataFrame:
        scored = _written(with_perplexity(staged(features(docs.select("text", "lang")), "features"), docs, train(docs)), "perplexities")
        return with_verdict(scored, bands(scored, **BAND), **SIDES).where("kept").select(F.col("__key").alias("__good")).distinct()

    kept = settled(good, "kept")
    return keyed(docs).join(kept, F.col("__key") == F.col("__good"), "left_semi").select("__row.*")


def op5_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = settled(lambda: score(docs, train(docs)), "perplexities")
    return with_verdict(scored, bands(scored, **BAND), **SIDES).select("doc_id", *FEATURES, "base_failed", "kept", "log_perplexity")

"""Suffix dedup: remove every byte covered by a long string that also starts earlier.

A string of ``LENGTH`` bytes counts as starting earlier if it does so in a
document of a smaller doc_id, or further left in the same one. Texts are judged
as they are given; matches never cross documents.

Sorting the suffixes of all bytes would move the corpus a hundred times over.
Each window of ``LENGTH`` bytes therefore names one suffix in it: the one whose
first ``GRAM`` bytes have the smallest hash. Equal windows name equal suffixes at
equal places, so it is enough to sort the named suffixes, about one in 35 bytes,
and each stands for the whole run of windows that name it:

1. Sampled splitters range-partition the named suffixes by their leading bytes
   into buckets of about ``BUCKET`` bytes of text; each bucket sorts them by
   multikey quicksort, eight bytes at a time, those with equal leading bytes by the
   hash of their run and their place. Neighbours with an equal run are copies: all
   but the first are removed as a whole. Runs with equal leading bytes that differ
   otherwise are contested, as they may share part of their windows.
2. Contested suffixes, and those at the border of a bucket, are compared again
   across buckets.
3. The windows of contested runs are range-partitioned by the leading bytes and
   sorted in their buckets; equal windows but the first are removed. Leading bytes
   of more than ``CROWD`` different runs are not kept together: their windows are
   counted one by one, with the first found before the shuffle.

Defined cases: null and empty texts, and those shorter than ``LENGTH``, lose
nothing; equal texts lose all in all but the smallest doc_id; rows that share a
doc_id are one document, judged each on its own text, and equal places of it are
no copies of each other; a row with a null doc_id loses nothing and counts for
nothing; doc_id may be of any type that orders and stays as it is; very long texts are
read whole; further columns are not read; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import numbered_ids, staged, table
from .words import binary_column, mix, prefix_sums, span_hashes

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
PIECE = 4 << 20
CROWD = 5000
BUCKET = 16 << 20
_PLACE = np.uint64((1 << 28) - 1)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def named_suffixes(text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that name one suffix: its leading bytes, run hash, first window, windows, and the suffix's place in the first."""
    for begin in range(0, len(text) - LENGTH + 1, PIECE):
        data = text[begin : begin + PIECE + LENGTH - 1]
        sums, down = prefix_sums(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = span_hashes(sums, down, at, at + GRAM)
        least = sliding_minimum((grams & ~_PLACE) | at.astype(np.uint64), WINDOW)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        place = (least[first] & _PLACE).astype(np.int64)
        runs = mix(span_hashes(sums, down, first, last + LENGTH) + (place - first).astype(np.uint64))
        yield np.lib.stride_tricks.sliding_window_view(data, GRAM)[place], runs, first + begin, last - first + 1, place - first


SUFFIX_SCHEMA = "lead binary, run long, doc_id long, start long, windows short, place short"


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of ``GRAM`` bytes as an Arrow column."""
    offsets = np.arange(0, GRAM * len(rows) + 1, GRAM, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _leading_words(column: pa.Array) -> np.ndarray:
    """The leading bytes as rows of 64-bit words that sort as the bytes do."""
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + GRAM * len(column)]
    return body.reshape(-1, GRAM).view(">u8").astype(np.uint64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
        texts = binary_column(batch, "text")
        for low in range(0, len(ids), 500):
            parts = []
            for doc_id, text in zip(ids[low : low + 500], texts[low : low + 500], strict=True):
                for lead, run, start, n, place in named_suffixes(np.frombuffer(text.as_buffer(), np.uint8)):
                    parts.append((lead, run.view(np.int64), np.full(len(run), doc_id), start, n.astype(np.int16), place.astype(np.int16)))
            if parts:
                lead, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([_binary(lead), *map(pa.array, rest)], ["lead", "run", "doc_id", "start", "windows", "place"])


def multikey_order(keys: list[np.ndarray], small: int = 256) -> np.ndarray:
    """The order of rows by their key words: three-way partitions on one word, equal parts go on with the next."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(keys):
            continue
        part = order[a:b].copy()
        if b - a <= small:
            order[a:b] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        word = keys[depth][part]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        less, more = word < pivot, word > pivot
        low, high = part[less], part[more]
        order[a : a + len(low)] = low
        order[a + len(low) : b - len(high)] = part[~(less | more)]
        order[b - len(high) : b] = high
        todo += [(a, a + len(low), depth), (a + len(low), b - len(high), depth + 1), (b - len(high), b, depth)]
    return order


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket: copies (is_copy), and the first of each contested run or run at the bucket's border."""
    names = ["lead", "run", "doc_id", "start", "windows", "place"]
    rows = [b.select(names) for b in batches if b.num_rows]
    if not rows:
        return
    leads = np.concatenate([_leading_words(b.column(0)) for b in rows])
    run, doc, start, windows, place = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(1, 6))
    rows.clear()
    order = multikey_order([*leads.T, run, doc, start])
    leads = leads[order]
    run, doc, start, windows, place = (c[order] for c in (run, doc, start, windows, place))
    new_lead = np.concatenate([[True], (leads[1:] != leads[:-1]).any(axis=1)])
    new_run = new_lead | np.concatenate([[True], run[1:] != run[:-1]])
    head = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
    copy = (doc != doc[head]) | (start != start[head])
    group = np.cumsum(new_lead) - 1
    contested = np.bincount(group[new_run])[group] > 1
    border = (group == 0) | (group == group[-1])
    shown = np.flatnonzero(copy | new_run & (contested | border))
    lead = leads[shown].astype(">u8").view(np.uint8).reshape(-1, GRAM)
    yield pa.RecordBatch.from_arrays([_binary(lead), *(pa.array(c[shown]) for c in (run, doc, start, windows, place, copy))], [*names, "is_copy"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contested runs of each document, with the suffix's leading gram."""
    for batch in batches:
        at = batch.schema.get_field_index
        texts, runs, ids = binary_column(batch, "text"), batch.column(at("runs")), batch.column(at("doc_id"))
        for low in range(0, batch.num_rows, 500):
            rows: list[tuple] = []
            for text, own, doc_id in zip(texts[low : low + 500], runs[low : low + 500], ids[low : low + 500].to_pylist(), strict=True):
                body = text.as_py()
                for r in own.as_py():
                    s, n, p = r["start"], r["windows"], r["place"]
                    rows.append((body[s + p : s + p + GRAM], doc_id, s, n, body[s : s + n - 1 + LENGTH], r["rivals"]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int16(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lead", "doc_id", "start", "windows", "body", "rivals"])


def _window_hashes(bodies: list[bytes], doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, doc_id and start of every window of the runs."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begins = np.cumsum([0, *map(len, bodies)])[:-1]
    sums, down = prefix_sums(data)
    origin = np.repeat(np.arange(len(bodies)), windows)
    step = np.arange(len(origin)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[origin] + step
    return span_hashes(sums, down, at, at + LENGTH), doc[origin], start[origin] + step


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        get = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
        if b.num_rows:
            yield get("body").to_pylist(), get("doc_id").to_numpy(), get("start").to_numpy(), get("windows").to_numpy().astype(np.int64)


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket of contested runs: runs of windows that are not the first of their kind."""
    parts = [_window_hashes(*p) for p in _bodies(batches)]
    if not parts:
        return
    word, doc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = multikey_order([word, doc, start])
    word, doc, start = word[order], doc[order], start[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    copy = (doc != doc[head]) | (start != start[head])
    doc, start = doc[copy], start[copy]
    order = np.lexsort([start, doc])
    doc, start = doc[order], start[order]
    if len(doc):
        fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]))
        length = start[np.append(fresh[1:], len(doc)) - 1] - start[fresh] + 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[fresh]), pa.array(start[fresh]), pa.array(length)], ["doc_id", "start", "windows"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _bodies(batches):
        word, doc, start = _window_hashes(*part)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(doc), pa.array(start)], ["word", "doc_id", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text, and the maximal runs that go."""
    for batch in batches:
        at = batch.schema.get_field_index
        texts, runs = binary_column(batch, "text"), batch.column(at("runs"))
        for low in range(0, batch.num_rows, 500):
            kept, sizes, spans = [], [], []
            for text, own in zip(texts[low : low + 500], runs[low : low + 500], strict=True):
                body = text.as_py()
                sizes.append(len(body))
                found: list[list[int]] = []
                for s, n in sorted((r["start"], r["windows"]) for r in own.as_py() or ()):
                    end = s + n - 1 + LENGTH
                    if found and s <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], end)
                    else:
                        found.append([s, end])
                borders = [0, *(x for span in found for x in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)) if found else body)
                spans.append([{"start": a, "end": b} for a, b in found])
            ids = batch.column(at("doc_id")).slice(low, 500)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run) and kept (the bytes that stay) of every row."""
    docs, back = numbered_ids(docs.select("doc_id", "text"))
    suffixes = docs.where("doc_id is not null").mapInArrow(_suffixes, SUFFIX_SCHEMA)
    # buckets follow the size of the texts, so that a task holds as much at every size
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    buckets = suffixes.repartitionByRange(number, "lead", "run", "doc_id", "start").mapInArrow(_bucket, f"{SUFFIX_SCHEMA}, is_copy boolean")
    marked = staged(buckets, "suffix-buckets")
    heads = marked.where("not is_copy")
    firsts = staged(heads.groupBy("lead", "run").agg(F.min(F.struct("doc_id", "start", "windows", "place")).alias("first")), "suffix-firsts")
    across = heads.join(firsts, ["lead", "run"]).where("doc_id <> first.doc_id or start <> first.start")
    rivals = staged(firsts.groupBy("lead").agg(F.count("*").alias("rivals")).where("rivals > 1"), "suffix-rivals")
    contested = firsts.join(rivals, "lead").select("first.*", "rivals")
    runs = contested.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "place", "rivals")).alias("runs"))
    contexts = docs.hint("merge").join(runs, "doc_id").mapInArrow(_contexts, "lead binary, doc_id long, start long, windows short, body binary, rivals long")
    contexts = staged(contexts, "suffix-contexts")
    gone = [marked.where("is_copy").select("doc_id", "start", F.col("windows").cast("long").alias("windows")), across.select("doc_id", "start", F.col("windows").cast("long").alias("windows"))]
    gone.append(contexts.where(F.col("rivals") <= CROWD).repartitionByRange("lead").mapInArrow(_equal_windows, "doc_id long, start long, windows long"))
    singles = contexts.where(F.col("rivals") > CROWD).mapInArrow(_single_windows, "word long, doc_id long, start long")
    first = singles.groupBy("word").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    gone.append(singles.join(staged(first, "crowded-windows"), "word").where("doc_id <> first.doc_id or start <> first.start").select("doc_id", "start", F.lit(1).cast("long").alias("windows")))
    ranges = gone[0].unionByName(gone[1]).unionByName(gone[2]).unionByName(gone[3])
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return back(docs.hint("merge").join(lists, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"), "doc_id")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

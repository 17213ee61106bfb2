"""Line dedup: drop lines that many documents share, keep them in one document.

Lines are exploded as 128-bit hashes of their normalised key, distinct documents
are counted per hash, and each document is put together again from the lines
that stay, in their order.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased. A key of at least ``min_chars`` code points held by at least
``min_docs`` documents loses all its lines except those of the largest doc_id
that holds it.

Defined cases: a null or empty text is one empty line and stays (a null text
becomes ``""``); rows that share a doc_id count as one document; a row with a
null doc_id is passed on untouched and is not counted; bytes that are no UTF-8
stay as they are, and each counts as one code point; very long texts are split whole;
doc_id may be of any type that orders and stays as it is; an empty table gives an
empty table; further columns, whatever their names, are passed on.

Only hashes are shuffled for the count, aggregated before the shuffle, so a line
in a third of all documents costs each task one row. Both joins are plain
equi-joins whose hot keys Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .stage import staged, table, trimmed

SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key, or None if it is too short to be judged."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _line_hashes(min_chars: int, schema: pa.Schema):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, highs, lows = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                keys = {line_key(x, min_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}
                for high, low in map(_halves, keys):
                    ids.append(doc_id)
                    highs.append(high)
                    lows.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, highs, lows), schema, strict=True)], schema=schema)

    return run


def _reassemble(min_chars: int, out_schema: pa.Schema):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            texts, totals, dropped = [], [], []
            for text, drops in zip(batch.column(at("text")).cast(pa.large_binary()), batch.column(at("__drops")), strict=True):
                lines = (text.as_py() or b"").split(b"\n")
                totals.append(len(lines))
                gone = drops.as_py()
                if gone:
                    gone = {(d["high"], d["low"]) for d in gone}
                    lines = [x for x in lines if (key := line_key(x, min_chars)) is None or _halves(key) not in gone]
                dropped.append(totals[-1] - len(lines))
                texts.append(b"\n".join(lines))
            own = {"text": pa.array(texts, pa.binary()).view(pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else batch.column(at(f.name)) for f in out_schema], schema=out_schema)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, plus n_lines and n_dropped.

    ``docs`` has doc_id and text; its other columns are passed on, and
    columns named n_lines or n_dropped are replaced.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    judged = lines_judged(docs.select("doc_id", "text", _row(rest)), min_chars, min_docs)
    kept = [F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return judged.select(*kept, "n_lines", "n_dropped")


def dedup_texts(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay; all other columns are passed on."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = lines_judged(docs.select("doc_id", "text", _row(rest)), min_chars, min_docs)
    return judged.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


def _row(columns: list[str]) -> Column:
    """Columns carried along in one struct, so that their names do not matter."""
    return (F.struct(*(f"`{c}`" for c in columns)) if columns else F.struct(F.lit(None).alias("none"))).alias("__row")


def lines_judged(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, text, __row, n_lines and n_dropped of ``docs`` (doc_id, text, __row)."""
    hashes = T.StructType([docs.schema["doc_id"], T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    lines = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_line_hashes(min_chars, to_arrow_schema(hashes)), hashes)
    per_doc = staged(lines.distinct(), "lines")
    counted = per_doc.groupBy("high", "low").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    common = staged(counted.where(F.col("n") >= min_docs).select("high", "low", "keeper"), "common-lines")
    drops = (
        per_doc.join(common, ["high", "low"]).where("doc_id <> keeper")
        .groupBy("doc_id").agg(F.collect_list(F.struct("high", "low")).alias("__drops"))
    )
    # one strategy at every size: the list of drops grows with the corpus, so it is never broadcast
    joined = docs.hint("merge").join(staged(drops, "dropped-lines"), "doc_id", "left").select("doc_id", "text", "__row", "__drops")
    schema = T.StructType([*joined.drop("__drops").schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_reassemble(min_chars, to_arrow_schema(schema)), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, CASE WHEN length(key) >= 40 THEN key END AS key FROM (
    SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

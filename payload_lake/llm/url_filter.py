"""URL filters: glob rules over canonical URLs, all matched at once bit by bit.

Every rule is compiled to symbols; each symbol owns one bit of a row of 64-bit
words, so the state of all rules for one URL is a few machine words. A character
moves all rules on with a shift, an and with the mask of the bits whose symbol
accepts it, and an or with the bits that a wildcard lets wait. A batch of URLs
is moved on one character column at a time.

Glob syntax: ``*`` is a run of characters without ``/``, ``**`` any run, ``?``
one character but ``/``; all else stands for itself, byte by byte in UTF-8.

The canonical URL is ``.`` + host + path. Host: after the first ``://`` up to
``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
``#`` or the end. Null or no ``://``: both empty. A rule (host, path) becomes the
glob ``*.host`` + path + ``**``, so it fits the host and its subdomains if the
path starts with the rule's. The longest rule that fits wins; of equally long
ones the first. Without a rule the verdict is ``default``.

The scan is a map: no shuffle, whatever share of the rows one host holds. Rules
are configuration; their masks hold at most ``MAX_BITS`` bits, and a task moves at
most ``MAX_STATE`` words of state at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import table

#: bits of all rules together (two tables of 256 such rows, 64 MB), and words of state that are moved at once
MAX_BITS, MAX_STATE = 1 << 20, 1 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


class Automaton:
    """Bit masks of many globs: ``step[c]`` bits that accept c, ``wait[c]`` bits that may stay on c."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._symbols(g.encode()) for g in globs]
        bits = sum(len(symbols) + 1 for symbols, _ in parsed)
        if bits > MAX_BITS:
            raise ValueError(f"{bits} bits of rules; the automaton is broadcast and holds at most {MAX_BITS}")
        self.words = max(1, -(-bits // 64))
        self.step, self.wait = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.finals = np.zeros(len(globs), np.int64)
        at = 0
        bit = lambda k: np.uint64(1 << (k & 63))
        for i, (symbols, stars) in enumerate(parsed):
            self.start[at >> 6] |= bit(at)
            for j, accepted in enumerate(symbols):
                self.step[accepted, at + j + 1 >> 6] |= bit(at + j + 1)
            for j, accepted in stars.items():
                self.wait[accepted, at + j >> 6] |= bit(at + j)
            at += len(symbols) + 1
            self.finals[i] = at - 1

    @staticmethod
    def _symbols(glob: bytes) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
        """Accepted bytes of each symbol, and of the wildcard that stands after the j-th symbol."""
        any_byte, segment = np.arange(256), np.array([b for b in range(256) if b != 47])
        symbols: list[np.ndarray] = []
        stars: dict[int, np.ndarray] = {}
        i = 0
        while i < len(glob):
            if glob[i : i + 2] == b"**":
                stars[len(symbols)] = any_byte
                i += 2
                continue
            if glob[i] == 42:
                stars.setdefault(len(symbols), segment)
            else:
                symbols.append(segment if glob[i] == 63 else np.array([glob[i]]))
            i += 1
        return symbols, stars

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and glob, whether the glob fits the whole text."""
        most = max(1, MAX_STATE // self.words)
        parts = [self._matches(texts[i : i + most]) for i in range(0, len(texts), most)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.finals)), bool)

    def _matches(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        body = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[None], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(texts)
        for j in range(int(lengths[0]) if len(lengths) else 0):
            while live and lengths[live - 1] <= j:
                live -= 1
            now = state[:live]
            c = body[begins[:live] + j]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = moved & self.step[c] | now & self.wait[c]
        out = np.empty((len(texts), len(self.finals)), bool)
        out[order] = (state[:, self.finals >> 6] >> (self.finals & 63).astype(np.uint64) & one).astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a canonical URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring_index(F.substring_index(url.substr(at + 3, F.length(url)), "?", 1), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), rest.substr(F.length(host) + 1, F.length(rest))


def escaped(text: str) -> str:
    if set(text) & set("*?"):
        raise ValueError(f"a wildcard character in a host or path prefix: {text!r}")
    return text


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and verdict; columns of these names are replaced, others, whatever their names, are passed on.

    Null and odd URLs have an empty host and path, no rule and the default
    verdict; a very long URL costs a step for each of its bytes; repeated rows are
    judged alike; an empty table stays empty.
    """
    rules = sorted(rules, key=lambda r: -len(r.host + r.path))
    names = [r.host + r.path for r in rules]
    automaton = Automaton([f"*.{escaped(r.host)}{escaped(r.path)}**" for r in rules])
    made = ("host", "path", "rule", "verdict")
    kept = [f for f in pages.schema.fields if f.name not in made]
    host, path = host_and_path(F.col(f"`{url}`"))
    row = F.struct(*(F.col(f"`{f.name}`") for f in kept)) if kept else F.struct(F.lit(None).alias("none"))
    split = pages.select(host.alias("host"), path.alias("path"), row.alias("row"))
    schema = T.StructType([*split.schema.fields, *(T.StructField(c, T.StringType()) for c in ("rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [b"." + h + p for h, p in zip(*(batch.column(k).cast(pa.large_binary()).to_pylist() for k in (0, 1)), strict=True)]
            hits = automaton.matches(urls)
            found = hits.any(axis=1) & np.array([len(u) > 1 for u in urls], bool)
            first = hits.argmax(axis=1)
            rule = [names[k] if ok else None for k, ok in zip(first, found, strict=True)]
            verdict = [rules[k].verdict if ok else default for k, ok in zip(first, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [f.name for f in schema.fields])

    judged = split.mapInArrow(run, schema)
    return judged.select(*(F.col(f"row.`{f.name}`").alias(f.name) for f in kept), *made)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""

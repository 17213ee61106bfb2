"""SentencePiece encoding and decoding with a given model.

The pieces are compiled to an Aho-Corasick automaton. One pass over the text
reports, at each position, all pieces that end there (the output links), and
each relaxes the best score of that position: the path with the largest sum of
piece scores wins, of equal ones the one whose last piece is longest. A character
without a piece becomes its UTF-8 bytes, at a cost below every piece.

As in SentencePiece, spaces become ``U+2581`` and one is put before the text. No
piece has that sign after another character, so a text falls into units (signs,
then other characters), and these into parts between characters that no piece
joins. Their best paths are independent; those met last are remembered, at most
``REMEMBER`` units and parts in each of two generations, whatever the texts hold.
A literal ``U+2581`` in a text is written as bytes, so that decoding gives back
every text exactly.

Scores come from the model file. For a model trained by merges the best path is
not the order of merges; see the README.

Defined cases: null and empty texts give no pieces and decode to ``""``; bytes
that are no UTF-8 become byte pieces and come back as they were; repeated rows are
encoded one by one; an empty table stays empty; further columns, whatever their
names, are passed on. The model (bounded by its vocabulary) is broadcast; encoding
is a map.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import table, trimmed
from .words import binary_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"
#: entries of a generation of remembered units or parts, the longest that is remembered, and rows encoded at once
REMEMBER, LONGEST, ROWS = 100_000, 48, 500
UNIT = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
PROBE = "ﬁ①  A b "
#: a character of no piece, and the key of a sign that the text itself has
GAP, LITERAL = "\0", "l" + 2 * SIGN


class Vocabulary(NamedTuple):
    """Pieces with ids and scores; the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    size: int


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file that has byte pieces and no normalising but that of spaces; other models are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(PROBE) != SIGN + PROBE.replace(" ", SIGN):
        raise ValueError(f"the model normalises texts or puts no sign before them: {path}")
    n = model.get_piece_size()
    kinds = [(i, model.id_to_piece(i)) for i in range(n)]
    bytes_of = {p: i for i, p in kinds if model.is_byte(i)}
    plain = [(i, p) for i, p in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(SIGN in p.lstrip(SIGN) for _, p in plain):
        raise ValueError(f"a piece crosses a space: {path}")
    return Vocabulary(tuple(p for _, p in plain), tuple(i for i, _ in plain), tuple(float(model.get_score(i)) for i, _ in plain), tuple(bytes_of[f"<0x{b:02X}>"] for b in range(256)), n)


class Memory:
    """What was worked out last. A young generation that is full becomes the old one, and the old one goes."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def __len__(self) -> int:
        return len(self.young) + len(self.old)


class Encoder:
    """Ids are kept as the bytes of 32-bit numbers, so that a text is one join.

    The key of a unit is what follows its sign; a unit without one has a sign after it.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, number, score in zip(vocabulary.pieces, vocabulary.ids, vocabulary.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score, number))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.scores) - 10
        self.byte_ids = vocabulary.byte_ids
        self.units, self.parts = Memory(REMEMBER), Memory(REMEMBER)
        self._number_pairs({p[k : k + 2] for p in vocabulary.pieces for k in range(len(p) - 1)})
        if any(GAP in p for p in vocabulary.pieces):
            raise ValueError("a piece has the character that keeps parts apart")

    def _number_pairs(self, pairs: set[str]) -> None:
        """Which characters stand side by side in a piece, as a table over numbers of the characters."""
        chars = sorted({c for p in pairs for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.joined[number[a], number[b]] = True

    def best_path(self, part: str) -> list[int]:
        """Ids of one part, which may have characters without a piece."""
        n = len(part)
        best = [0.0] + [float("-inf")] * n
        back, number = [0] * (n + 1), [-1] * (n + 1)
        foreign, done = [c not in self.single for c in part], 0
        for end, (length, score, piece) in self.automaton.iter(part):
            done = self._unknowns(done, end, foreign, best, back, number)
            begin = end + 1 - length
            score += best[begin]
            if score > best[end + 1]:
                best[end + 1], back[end + 1], number[end + 1] = score, begin, piece
        self._unknowns(done, n, foreign, best, back, number)
        out: list[int] = []
        while n:
            if number[n] >= 0:
                out.append(number[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(_bytes(part[back[n] : n])))
            n = back[n]
        return out[::-1]

    def _unknowns(self, done: int, to: int, foreign: list[bool], best: list[float], back: list[int], number: list[int]) -> int:
        """Relax the positions up to ``to`` by the unknown characters before them."""
        for k in range(done + 1, to + 1):
            if foreign[k - 1] and best[k - 1] + self.unknown > best[k]:
                best[k], back[k], number[k] = best[k - 1] + self.unknown, k - 1, -1
        return max(done, to)

    def best_paths(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts whose characters all have pieces, in one pass over all of them; no piece reaches over the gaps between them."""
        text = GAP + GAP.join(parts)
        best = [float("-inf")] * len(text)
        chosen: list = [None] * len(text)
        at = 0
        for part in parts:
            best[at] = 0.0
            at += len(part) + 1
        for end, entry in self.automaton.iter(text):
            score = best[end - entry[0]] + entry[1]
            if score > best[end]:
                best[end] = score
                chosen[end] = entry
        at = 0
        for part in parts:
            end, out = at + len(part), []
            while end > at:
                length, _, piece = chosen[end]
                out.append(piece)
                end -= length
            yield array("i", out[::-1]).tobytes()
            at += len(part) + 1

    def _cuts(self, units: list[str]) -> list[list[str]]:
        """The units, cut between characters that stand side by side in no piece: no path crosses there."""
        text = "".join(units)
        number = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        borders = np.zeros(len(text) + 1, bool)
        borders[1:-1] = ~self.joined[number[:-1], number[1:]]
        borders[np.cumsum([0, *map(len, units)])] = True
        at = np.flatnonzero(borders).tolist()
        pieces = [text[a:b] for a, b in zip(at, at[1:])]
        out, k = [], 0
        for unit in units:
            own, size = [], len(unit)
            while size:
                own.append(pieces[k])
                size -= len(pieces[k])
                k += 1
            out.append(own)
        return out

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """The ids of units, by key."""
        fresh = {}
        wanted = []
        for key in keys:
            found = self.units.get(key)
            if found is None:
                wanted.append(key)
            else:
                fresh[key] = found
        cuts = self._cuts([key[:-1] if key[-1:] == SIGN and key.strip(SIGN) else SIGN + key for key in wanted])
        known = {part: self.parts.get(part) for part in dict.fromkeys(part for own in cuts for part in own)}
        new = [part for part, ids in known.items() if ids is None]
        plain = [part for part in new if self.single.issuperset(part)]
        made = dict(zip(plain, self.best_paths(plain), strict=True))
        for part in new:
            ids = made[part] if part in made else array("i", self.best_path(part)).tobytes()
            known[part] = ids
            if len(part) <= LONGEST:
                self.parts.put(part, ids)
        for key, own in zip(wanted, cuts, strict=True):
            fresh[key] = b"".join([known[part] for part in own])
            if len(key) <= LONGEST:
                self.units.put(key, fresh[key])
        return fresh

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as bytes. The units that are not at hand are worked out together."""
        rows, missing = [], {}
        for text in texts:
            keys = _keys(text)
            found = list(map(self.units.young.get, keys))
            if None in found:
                missing.update((key, None) for key, ids in zip(keys, found, strict=True) if ids is None)
            rows.append((keys, found))
        missing.pop(LITERAL, None)
        fresh = self._learn(list(missing)) if missing else {}
        fresh[LITERAL] = array("i", [self.byte_ids[b] for b in SIGN.encode()]).tobytes()
        return [b"".join([fresh[key] if ids is None else ids for key, ids in zip(keys, found, strict=True)] if None in found else found) for keys, found in rows]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded([text or ""])[0], np.int32).tolist()


def _keys(text: str) -> list[str]:
    """The keys of the units of a text, in order."""
    if not text:
        return []
    if SIGN not in text:
        words = text.split(" ")
        if "" not in words:
            return words
    out = []
    for k, part in enumerate(text.split(SIGN)):
        if k:
            out.append(LITERAL)
        out += [unit[1:] if unit[0] == SIGN else unit + SIGN for unit in UNIT.findall((SIGN if not k else "") + part.replace(" ", SIGN))]
    return out


def _bytes(text: str) -> bytes:
    """UTF-8; what stands for a byte that was no UTF-8 is that byte again."""
    return text.encode("utf-8", "surrogateescape")


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        parts = [b""] * vocabulary.size
        for piece, i in zip(vocabulary.pieces, vocabulary.ids, strict=True):
            parts[i] = piece.replace(SIGN, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            parts[i] = bytes([b])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.body = np.frombuffer(b"".join(parts), np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts of ``counts`` ids each, and where each text begins and the last one ends; the space put before a text is taken off."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.body[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        spaces = begins[data[begins] == 32]
        cut = np.searchsorted(spaces, offsets)
        return np.delete(data, spaces), offsets - cut

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.array(list(ids), np.int64)
        return self.texts(ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _with_column(df: DataFrame, column: str, to: str, kind: T.DataType, convert, carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) plus ``to``, made by ``convert`` of Arrow arrays of ``column``; a column of that name is replaced. Rows travel as one struct, so names do not matter."""
    kept = [f for f in df.schema.fields if f.name != to and (carry is None or f.name in carry)]
    row = F.struct(*(F.col(f"`{f.name}`") for f in kept)) if kept else F.struct(F.lit(None).alias("none"))
    rows = df.select(F.col(f"`{column}`").alias("x"), row.alias("row"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = convert()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # a worker holds few texts and ids at once
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([work(part), part.column(1)], ["made", "row"])

    made = rows.mapInArrow(run, T.StructType([T.StructField("made", kind), rows.schema["row"]]))
    return made.select(*(F.col(f"row.`{f.name}`").alias(f.name) for f in kept), F.col("made").alias(to))


def encode(docs: DataFrame, model: str = MODEL, column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` plus ``to``, the piece ids of ``column``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def convert():
        encoder = _encoder(shared.value)

        def work(part: pa.RecordBatch) -> pa.Array:
            found = encoder.encoded([x.decode("utf-8", "surrogateescape") for x in binary_column(part, "x").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))

        return work

    return _with_column(docs, column, to, T.ArrayType(T.IntegerType()), convert)


def decode(rows: DataFrame, model: str = MODEL, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` plus ``to``, the text of the piece ids in ``column``; null ids give ``""``."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def convert():
        decoder = Decoder(shared.value)

        def work(part: pa.RecordBatch) -> pa.Array:
            ids = part.column(0)
            data, offsets = decoder.texts(ids.flatten().to_numpy(), ids.value_lengths().fill_null(0).to_numpy())
            return pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.large_binary()).cast(pa.binary()).view(pa.string())

        return work

    return _with_column(rows, column, to, T.StringType(), convert)


def round_trips(docs: DataFrame, carry: list[str], model: str = MODEL, column: str = "text", to: str = "pieces") -> DataFrame:
    """The columns ``carry`` of ``docs`` plus ``to``: the piece ids of ``column``, and whether decoding them gives its bytes back. Both ways in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def convert():
        encoder, decoder = _encoder(shared.value), Decoder(shared.value)

        def work(part: pa.RecordBatch) -> pa.Array:
            texts = binary_column(part, "x").to_pylist()
            found = encoder.encoded([x.decode("utf-8", "surrogateescape") for x in texts])
            counts = np.array([len(x) // 4 for x in found], np.int64)
            flat = np.frombuffer(b"".join(found), np.int32)
            data, offsets = decoder.texts(flat, counts)
            body = data.tobytes()
            same = [body[a:b] == x for x, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

        return work

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return _with_column(docs, column, to, kind, convert, carry)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_ids, sha256 of the ids joined by commas, and whether decoding gives the text back."""
    both = round_trips(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "pieces.*")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_sha256"), "round_trip")

"""Speech recognisers over a column of audio or over files, one recogniser for each Python worker."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Answer(NamedTuple):
    text: str
    language: str
    duration: float
    model: str
    tokens: int


#: (content, language) -> answer
Recogniser = Callable[[bytes, str], Answer]

ANSWER = [
    T.StructField("text", T.StringType()), T.StructField("language", T.StringType()), T.StructField("duration", T.DoubleType()),
    T.StructField("model", T.StringType()), T.StructField("tokens", T.LongType()),
]
ERROR = T.StructField("error", T.StringType())


def _mock() -> Recogniser:
    """Fixed text, 16,000 bytes a second, Chinese unless a language is named."""
    return lambda content, language: Answer("mock transcription", "zh" if language == "auto" else language, len(content) / 16000, "mock", 0)


#: what makes a recogniser, by name; called once in a worker
BACKENDS: dict[str, Callable[[], Recogniser]] = {"mock": _mock}

#: the recogniser of this worker and the call it was made for
_made: dict[str, Recogniser] = {}


def _recogniser(key: str, make: Callable[[], Recogniser]) -> Recogniser:
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def transcribe(audio: DataFrame, backend: str | Callable[[], Recogniser] = "mock", language: str = "auto", keep_errors: bool = False) -> DataFrame:
    """``audio`` (key columns and binary ``content``) with the recogniser's answer; null content is empty.

    ``backend`` is a name of ``BACKENDS`` or a function that makes a recogniser (loads its
    model, opens its session); it is called once in each Python worker and the
    recogniser serves all tasks of the query there. With ``keep_errors``, content at
    which it fails gives a row with ``error``, class and message, and no answer.
    """
    if isinstance(backend, str) and backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}")
    make = BACKENDS[backend] if isinstance(backend, str) else backend
    keys = [f for f in audio.schema.fields if f.name != "content"]
    schema = T.StructType([*keys, *ANSWER, *([ERROR] if keep_errors else [])])
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def answers(content: pa.Array, recogniser: Recogniser) -> Iterator[tuple]:
        for x in content:
            try:
                yield (*recogniser(x.as_py() or b"", language), *([None] if keep_errors else []))
            except Exception as e:
                if not keep_errors:
                    raise
                yield None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = _recogniser(key, make)
        for batch in batches:
            at = batch.schema.get_field_index
            found = list(zip(*answers(batch.column(at("content")), recogniser), strict=True)) or [()] * (len(arrow) - len(keys))
            own = [batch.column(at(f.name)) for f in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(found, list(arrow)[len(keys) :], strict=True))], schema=arrow)

    return audio.mapInArrow(run, schema)


#: folder of packs in a folder of files; its name keeps it out of the listing of loose files
PACKS = "_packs"

#: a row group of a pack, and so a batch read from it, has about 16 MB or one file: sizes are looked at from the first row on and are those of the contents (sound does not compress)
GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "compression": "none"}


def pack_files(files: DataFrame, folder: str) -> None:
    """Add files to the packs of ``folder``: ``path`` below it and ``content``; Parquet tables of many files each.

    To make, list and open a file costs more than the few bytes of a short clip, so clips
    that come in great numbers are packed. A path added twice is read twice.
    """
    content = F.coalesce("content", F.lit(b""))
    files.select("path", F.octet_length(content).cast("long").alias("length"), content.alias("content")).write.mode("append").options(**GROUPS).parquet(f"{folder}/{PACKS}")


def _packed(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """path, length and content of the packed files, as Spark's source of loose ones gives them; None if there are no packs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(root, PACKS)):
        return None
    fits = F.substring_index("path", "/", -1).rlike(f"^(?:{hadoop.GlobPattern.compile(pattern).pattern()})$")
    files = spark.read.schema("path string, length long, content binary").parquet(f"{folder}/{PACKS}").where(fits & (F.col("length") > 0))
    return files.withColumn("path", F.concat(F.lit(f"{fs.makeQualified(root).toString().rstrip('/')}/"), "path"))


def transcribe_files(spark: SparkSession, folder: str, backend: str | Callable[[], Recogniser] = "mock", language: str = "auto", pattern: str = "*") -> DataFrame:
    """path, length, answer and error of every file under ``folder``, loose or in a pack, whose name fits ``pattern``; files without a byte give no row.

    Spark lists the loose files and packs and deals them into tasks by size, up to
    ``spark.sql.files.maxPartitionBytes``, so a batch holds no more than that or one file;
    no other columns of the source are read, and contents do not leave their task.
    """
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")
    packed = _packed(spark, folder, pattern)
    return transcribe(loose if packed is None else loose.unionByName(packed), backend, language, keep_errors=True)

"""A table that a stream upserts into, in levels: batches are appended, merged level by level, and read at a version.

Every micro-batch writes the last row of each of its keys as one set of files of level 0
and commits them. When a level holds ``fan_in`` sets, they are merged into one
of the next level, so a row is written again once for each level and a reader finds
a number of sets that grows with the logarithm of the batches. A version is a list of
sets, and merging replaces none of their files: whoever reads a version
reads it to the end, until ``vacuum`` removes what no kept version lists.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.upserts import upsert
from ..sources import commits

TABLE = "rows"


def _level(path: str) -> int:
    return int(re.search(r"-L(\d+)-", path)[1])


def _write(rows: DataFrame, root: str, keys: list[str], level: int) -> str:
    """The last row of each key as one set of files; rows of a key are in one of them."""
    path = f"data/{TABLE}-L{level}-{uuid.uuid4().hex}"
    upsert(rows.limit(0), rows, keys).write.parquet(f"{root}/{path}")
    return path


def _commit(spark: SparkSession, root: str, change) -> int:
    """Commit ``change(manifest)``, again from the newest manifest if another commit came first."""
    while True:
        manifest = change(commits.read_manifest(spark, root))
        if manifest is None:
            return commits.newest_version(spark, root)
        try:
            return commits.commit_manifest(spark, root, manifest)
        except commits.CommitConflict:
            continue


def stream_upsert(changes: DataFrame, root: str, keys: list[str], checkpoint: str, fan_in: int = 8):
    """Upsert a stream of changes (with ``seq``) into the table at ``root``; returns the started query.

    A batch that is run again after a failure is committed once: the manifest holds the
    last batch of each checkpoint.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if commits.read_manifest(spark, root).get("batches", {}).get(checkpoint, -1) >= number:
            return
        path, schema = _write(batch, root, keys, 0), json.loads(batch.schema.json())

        def add(manifest: dict) -> dict:
            paths = manifest["tables"].get(TABLE, {"paths": []})["paths"]
            return manifest | {"tables": {TABLE: {"schema": schema, "paths": [*paths, path]}}, "batches": manifest.get("batches", {}) | {checkpoint: number}}

        _commit(spark, root, add)
        merge_levels(spark, root, keys, fan_in)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, root: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The last row per key of the newest version, or of a given one."""
    rows = commits.read_tables(spark, root, version)[TABLE]
    return upsert(rows.limit(0), rows, keys)


def merge_levels(spark: SparkSession, root: str, keys: list[str], fan_in: int = 8) -> None:
    """Merge each level that holds ``fan_in`` sets or more into one set of the next."""
    while True:
        paths = commits.read_manifest(spark, root)["tables"].get(TABLE, {"paths": []})["paths"]
        levels = {x: [p for p in paths if _level(p) == x] for x in map(_level, paths)}
        full = [x for x, sets in levels.items() if len(sets) >= fan_in]
        if not full:
            return
        _merge(spark, root, keys, levels[min(full)], min(full) + 1)


def compact(spark: SparkSession, root: str, keys: list[str]) -> None:
    """Merge all sets of the newest version into one; batches that are committed meanwhile stay as they are."""
    paths = commits.read_manifest(spark, root)["tables"].get(TABLE, {"paths": []})["paths"]
    if len(paths) > 1:
        _merge(spark, root, keys, paths, max(map(_level, paths)) + 1)


def _merge(spark: SparkSession, root: str, keys: list[str], sets: list[str], level: int) -> None:
    schema = commits.read_manifest(spark, root)["tables"][TABLE]["schema"]
    rows = spark.read.schema(T.StructType.fromJson(schema)).parquet(*(f"{root}/{p}" for p in sets))
    path = _write(rows, root, keys, level)

    def replace(manifest: dict) -> dict | None:
        left = manifest["tables"][TABLE]["paths"]
        if not set(sets) <= set(left):  # another merge took some of them
            return None
        return manifest | {"tables": manifest["tables"] | {TABLE: manifest["tables"][TABLE] | {"paths": [path, *(p for p in left if p not in sets)]}}}

    _commit(spark, root, replace)

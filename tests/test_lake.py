"""Numbering, commits, gated merges, pruned scans, streamed logs and run reports, against plain expectations."""

import random
import shutil
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from payload_lake.operators import listing, numbering, recognise, runs, upserts
from payload_lake.plans import registered
from payload_lake.sources import commits, tables
from payload_lake.streaming import events as streams
from payload_lake.streaming import upserted

# ---------------------------------------------------------------- numbering


def test_a_hot_account_is_numbered_by_all_tasks(spark):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.9 else rng.choice([2, 3, None]), i) for i in rng.sample(range(100_000), 6000)]
    frame = spark.createDataFrame(rows, "uid long, ts long").repartition(7)
    got = numbering.numbered(frame, ["uid"], ["ts"])
    expected = set()
    for uid in {u for u, _ in rows}:
        expected |= {(uid, ts, i + 1) for i, ts in enumerate(sorted(t for u, t in rows if u == uid))}
    assert {tuple(r) for r in got.select("uid", "ts", "place").collect()} == expected
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are joined into one
    try:
        tasks = numbering.numbered(frame, ["uid"], ["ts"]).where("uid = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 0.6 * sum(r["count"] for r in tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbers_by_descending_order_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 2), (1, "a", 2)], "uid long, kind string, ts long")
    got = numbering.numbered(frame, ["uid", "kind"], [F.desc("ts")], "n")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, 3), (1, "a", 2, 2), (1, "a", 3, 1), (1, "b", 2, 1)]
    assert numbering.numbered(frame.limit(0), ["uid"], ["ts"]).collect() == []


def test_ids_go_on_from_the_largest(spark):
    log = spark.createDataFrame([(1, 7), (1, 9), (2, 4)], "uid long, id long")
    rows = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (3, 1, "z")], "uid long, ts long, what string")
    assert sorted((r.uid, r.what, r.id) for r in upserts.append_with_ids(log, rows, ["ts"]).collect()) == [(1, "x", 11), (1, "y", 10), (3, "z", 1)]


def test_pages_of_a_hot_listing(spark):
    fresh = [(1, p, [f"i{p}", f"i{p + 1}"]) for p in range(1, 200)] + [(2, 1, []), (2, 2, ["a"])]
    stored = [(1, p, [f"i{p}"]) for p in range(100, 300)] + [(2, 1, ["a"]), (2, 2, [])]
    schema = "uid long, page_no long, ids array<string>"
    got = {(r.uid, r.is_stored, r.page_no) for r in listing.merge_listing(spark.createDataFrame(fresh, schema), spark.createDataFrame(stored, schema)).collect()}
    expected, seen = set(), set()
    for is_stored, pages in ((0, fresh), (1, stored)):
        for uid, page, ids in pages:
            if not ids or {(uid, i) for i in ids} - seen:
                expected.add((uid, is_stored, page))
            seen |= {(uid, i) for i in ids}
    assert got == expected


# ---------------------------------------------------------------- commits and merges


def of_uid(spark, *rows):
    return spark.createDataFrame(rows, "uid long, v string")


def test_tables_of_a_commit_change_together(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert commits.newest_version(spark, root) == 0 and commits.read_tables(spark, root) == {}
    assert commits.commit_tables(spark, root, 0, {"a": of_uid(spark, (1, "x")), "b": of_uid(spark, (1, "y")), "none": of_uid(spark, (9, "z")).limit(0)}) == 1
    old = commits.read_tables(spark, root)
    assert commits.commit_tables(spark, root, 1, {"b": of_uid(spark, (2, "w"))}, {"a": of_uid(spark, (2, "x2"))}) == 2
    new = commits.read_tables(spark, root)
    values = lambda df: sorted((r.uid, r.v) for r in df.collect())
    assert values(new["a"]) == [(1, "x"), (2, "x2")] and values(new["b"]) == [(2, "w")] and values(new["none"]) == []
    assert values(old["b"]) == [(1, "y")] and values(commits.read_tables(spark, root, 1)["a"]) == [(1, "x")]
    # rows that are added do not write again what is there
    first, second = (commits.read_manifest(spark, root, v)["tables"]["a"]["paths"] for v in (1, 2))
    assert second[:1] == first and len(second) == 2


def test_of_two_commits_from_one_version_one_succeeds(spark, tmp_path):
    root = str(tmp_path / "lake")
    commits.commit_tables(spark, root, 0, {"a": of_uid(spark, (1, "x"))})
    commits.commit_tables(spark, root, 1, {"a": of_uid(spark, (1, "won"))})
    with pytest.raises(commits.CommitConflict):
        commits.commit_tables(spark, root, 1, {"a": of_uid(spark, (1, "lost"))})
    with pytest.raises(commits.CommitConflict):  # one that saw version 1 and comes to its manifest late
        commits._put(spark, root, 2, "{}")
    assert commits.read_tables(spark, root)["a"].first().v == "won" and commits.newest_version(spark, root) == 2
    assert sorted(p.name for p in (tmp_path / "lake/_commits").iterdir() if p.suffix != ".crc") == ["000000000001.json", "000000000002.json"]


def test_a_broken_off_commit_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "lake")
    commits.commit_tables(spark, root, 0, {"a": of_uid(spark, (1, "x")), "b": of_uid(spark, (1, "y"))})
    bad = of_uid(spark, (1, "x")).select("uid", F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        commits.commit_tables(spark, root, 1, {"a": of_uid(spark, (1, "new")), "b": bad})
    assert {n: df.first().v for n, df in commits.read_tables(spark, root).items()} == {"a": "x", "b": "y"}
    assert commits.commit_tables(spark, root, 1, {"a": of_uid(spark, (1, "again"))}) == 2


def stores(spark):
    meta = lambda rows: spark.createDataFrame(rows, "uid long, key string, value string")
    current = {
        "meta": meta([(1, "schema_version", "2"), (2, "schema_version", "9"), (3, "schema_version", "3"), (2, "last_fetched_at_ms", "5"), (1, "other", "o")]),
        "stage_task": spark.createDataFrame([(1, "asr", "SUCCESS"), (2, "asr", "SUCCESS")], "uid long, stage string, status string"),
    }
    legacy = {
        "meta": meta([(1, "schema_version", "4"), (1, "last_fetched_at_ms", "7"), (2, "schema_version", "4"), (2, "last_fetched_at_ms", "8"), (3, "schema_version", "5"), (4, "schema_version", "4")]),
        "stage_task": spark.createDataFrame([(u, s, "OLD") for u in (1, 2, 3, 4, 5) for s in ("asr", "fetching", "parsing")], "uid long, stage string, status string"),
        "stage_error": spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (2, 1, "c"), (1, 2, None)], "uid long, id long, message string"),
    }
    return current, legacy


def test_blocked_accounts_stay_as_they_are(spark):
    added, meta, report = upserts.merge_store(*stores(spark))
    assert sorted((r.uid, r.stage, r.status) for r in added["stage_task"].collect()) == [(1, "fetching", "OLD")]
    assert sorted((r.uid, r.id, r.message) for r in added["stage_error"].collect()) == [(1, 1, "a"), (1, 2, None)]
    marks = {(r.uid, r.key): r.value for r in meta.collect()}
    assert marks == {(1, "schema_version"): "3", (1, "last_fetched_at_ms"): "7", (1, "other"): "o", (2, "schema_version"): "9", (2, "last_fetched_at_ms"): "5", (3, "schema_version"): "3"}
    told = {(r.uid, r.table): (r.copied, r.existing, r.dropped, r.refused, r.blocked) for r in report.collect()}
    assert told == {
        (1, "stage_task"): (1, 1, 1, 0, None), (2, "stage_task"): (0, 0, 0, 3, "current version"), (3, "stage_task"): (0, 0, 0, 3, "legacy version"), (4, "stage_task"): (0, 0, 0, 3, "no current store"),
        (5, "stage_task"): (0, 0, 0, 3, "no current store"), (1, "stage_error"): (2, 0, 0, 0, None), (2, "stage_error"): (0, 0, 0, 1, "current version"),
    }


def test_a_merge_is_committed_once_and_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "lake")
    current, legacy = stores(spark)
    version = commits.commit_tables(spark, root, 0, current)
    for _ in range(2):
        added, meta, _ = upserts.merge_store(commits.read_tables(spark, root), legacy)
        version = commits.commit_tables(spark, root, version, {"meta": meta}, added)
    assert version == 3
    assert sorted((r.uid, r.stage, r.status) for r in commits.read_tables(spark, root)["stage_task"].collect()) == [(1, "asr", "SUCCESS"), (1, "fetching", "OLD"), (2, "asr", "SUCCESS")]
    rows = {(r.uid, r.table): r.n for r in commits.account_rows(commits.read_tables(spark, root)).collect()}
    assert rows[(1, "meta")] == 3 and rows[(1, "stage_error")] == 2


# ---------------------------------------------------------------- pruned scans


def leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_a_list_of_accounts_prunes_partitions_at_run_time(spark, tmp_path):
    rows = [(u, "k", f"v{u}") for u in range(1, 41)]
    tables.write_table(spark.createDataFrame(rows, "uid long, key string, value string"), str(tmp_path), "meta")
    wanted = spark.createDataFrame([("7",), ("9",), ("-3",), ("x",), ("9",), ("77",)], "uid string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = tables.read_accounts(spark, str(tmp_path), "meta", wanted)
        assert sorted(r.uid for r in got.collect()) == [7, 9]
        plan = got._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        read = [s.metrics().get("numFiles").get().value() for s in leaves(plan) if s.metrics().contains("numFiles")]
        assert read and read[0] == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    long = tables.read_accounts(spark, str(tmp_path), "meta", wanted, small=1)
    assert sorted(r.uid for r in long.collect()) == [7, 9]


def test_one_account_lists_one_folder(spark, tmp_path):
    tables.write_table(spark.createDataFrame([(u, "k", "v") for u in (1, 2)], "uid long, key string, value string"), str(tmp_path), "meta")
    one = tables.read_table(spark, str(tmp_path), "meta", 2)
    assert [tuple(r) for r in one.select("uid", "key", "value").collect()] == [(2, "k", "v")] and all("uid=2" in f for f in one.inputFiles())
    assert tables.read_table(spark, str(tmp_path), "meta", 3).collect() == []


def test_many_accounts_share_a_bounded_number_of_folders(spark, tmp_path):
    n, schema = tables.BUCKETS, "uid long, key string, value string"
    write = lambda rows: tables.write_table(spark.createDataFrame(rows, schema), str(tmp_path), "meta")
    everything = lambda: sorted((str(r.uid), r.key, r.value) for r in tables.read_table(spark, str(tmp_path), "meta").collect())
    rows = [(u, k, f"{k}{u}") for u in [*range(1, 4 * n), -5, None] for k in "ab"]
    write(rows)
    assert len([p for p in (tmp_path / "meta").iterdir() if p.is_dir()]) == n + 1  # of null, one more
    assert everything() == sorted((str(u), k, v) for u, k, v in rows)
    for uid in (7, 7 + n, -5):
        assert sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path), "meta", uid).select("uid", "key", "value").collect()) == [(uid, k, f"{k}{uid}") for k in "ab"]
    assert tables.read_table(spark, str(tmp_path), "meta", 7 + 9 * n).collect() == []  # its folder is there
    wanted = spark.createDataFrame([(7,), (7 + n,), (7 + 9 * n,)], "uid long")
    for small in (100_000, 1):
        assert sorted((r.uid, r.value) for r in tables.read_accounts(spark, str(tmp_path), "meta", wanted, small=small).collect()) == [(u, f"{k}{u}") for u in (7, 7 + n) for k in "ab"]
    # accounts that share a folder with those replaced stay as they are
    fresh = [(7, "c", "new"), (None, "c", "new"), (5 * n, "c", "new")]
    write(fresh)
    expected = sorted((str(u), k, v) for u, k, v in [*(r for r in rows if r[0] not in (7, None)), *fresh])
    assert everything() == expected
    own = tables.read_table(spark, str(tmp_path), "meta", 7)  # read from the table that it goes to
    tables.write_table(own.withColumn("value", F.lit("again")), str(tmp_path), "meta")
    assert everything() == sorted((u, k, "again" if u == "7" else v) for u, k, v in expected)
    write([])
    assert len(everything()) == len(expected)


# ---------------------------------------------------------------- typed views


def odd_values(rng, depth):
    """Any JSON value, often of a shape that no field expects."""
    kinds = ["1", "-7", "1.5", "true", "null", '"12"', '"x"', '"{no object"', '"[no list"', "12345678901234567890", '""']
    if depth and rng.random() < 0.3:
        return "[" + ", ".join(odd_values(rng, depth - 1) for _ in range(rng.randint(0, 2))) + "]"
    if depth and rng.random() < 0.3:
        return "{" + ", ".join(f'"{k}": {odd_values(rng, depth - 1)}' for k in rng.sample(["text", "view", "mid", "type"], 2)) + "}"
    return rng.choice(kinds)


def test_one_cast_reads_what_single_paths_read(spark):
    from payload_lake.operators import work_items
    from payload_lake.sources.views import LISTINGS, SINGLE

    rng = random.Random(17)

    def entry(fields):
        tree = {}
        for f in fields:
            path = rng.choice(f.paths)
            if rng.random() < 0.85 and path and "[" not in path:
                node, parts = tree, path.split(".")
                for part in parts[:-1]:
                    node = node.setdefault(part, {}) if isinstance(node, dict) else {}
                if isinstance(node, dict):
                    node[parts[-1]] = odd_values(rng, 2)
        text = lambda node: node if isinstance(node, str) else "{" + ", ".join(f'"{k}": {text(v)}' for k, v in node.items()) + "}"
        return text(tree)

    for view in ("user_info", "overview_stat", "up_stat", "video_detail", "videos", "dynamics"):
        fields = SINGLE[view] if view in SINGLE else LISTINGS[view].fields
        values = [entry(fields) for _ in range(120)] + ["[]", "3", '"t"', "null", "{}"]
        rows = spark.createDataFrame(list(enumerate(values)), "i long, p string").select("i", F.try_parse_json("p").alias("v"))
        plain = rows.select("i", *(F.coalesce(*(work_items._scalar(F.col("v"), path, f.type) for path in f.paths)).alias(f.name) for f in fields))
        assert sorted(map(str, work_items._typed(rows, "v", fields).collect())) == sorted(map(str, plain.collect()))


# ---------------------------------------------------------------- streams


def run_to_end(stream, folder, spark):
    started = streams.ingest_events(stream, f"{folder}/out", f"{folder}/checkpoint")
    started.awaitTermination(120)
    assert started.exception() is None
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_every_silence_is_an_alert(spark, tmp_path):
    minute = lambda m: 1_700_000_000 + 60 * m
    rows = [("pauses", "item.saved", m) for m in (-300, -290, -200, -186, -172, -100)] + [("pauses", "run.completed", -99)]
    rows += [("exact", "item.saved", -60), ("exact", "item.saved", -45), ("within", "item.saved", -60), ("within", None, -46), ("within", "run.completed", -32), ("closing", "run.completed", 0)]
    frame = spark.createDataFrame([(r, e, minute(m)) for r, e, m in rows], "run_id string, event string, s long").selectExpr("run_id", "event", "timestamp_seconds(s) AS ts")
    frame.write.parquet(f"{tmp_path}/in")
    found = run_to_end(streams.stream_stale_runs(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")), tmp_path, spark)
    assert sorted((r.run_id, r.last_ts_ms) for r in found) == sorted([("pauses", minute(-290) * 1000), ("pauses", minute(-172) * 1000), ("exact", minute(-60) * 1000), ("exact", minute(-45) * 1000)])


def test_ends_that_come_before_late_or_never(spark, tmp_path):
    day = 86_400_000
    files = [
        [("run.completed", "early", None, day + 5, "SUCCESS"), ("run.started", "late", 2, day, None)],
        [("run.started", "early", 1, day + 1, None), ("run.started", "open", 3, day, None), ("run.started", "too late", 4, day, None)],
        [("run.completed", "late", None, 2 * day, "PARTIAL"), ("run.completed", "too late", None, 6 * day, "FAILED"), ("run.completed", "orphan", None, 2 * day, "FAILED"), ("event", "late", 2, day, None)],
        [("run.started", "closing", 9, 90 * day, None), ("run.completed", "closing", None, 90 * day, "SUCCESS")],
    ]
    for rows in files:
        spark.createDataFrame(rows, "type string, run_id string, uid long, ts_ms long, status string").coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    log = tables.read_run_log(spark, f"{tmp_path}/log", streaming=True, files_at_once=1)
    found = run_to_end(streams.stream_runs(log, within="2 days", watermark="20 days"), tmp_path, spark)
    got = sorted(((r.run_id, r.uid, r.started_at_ms, r.status, r.ended_at_ms) for r in found if r.run_id != "closing"), key=repr)
    assert got == sorted([
        ("early", 1, day + 1, "SUCCESS", day + 5), ("late", 2, day, "PARTIAL", 2 * day), ("open", 3, day, None, None), ("too late", 4, day, None, None),
        ("too late", None, None, "FAILED", 6 * day), ("orphan", None, None, "FAILED", 2 * day)], key=repr)


def test_broken_and_repeated_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    good = '{"type":"event","run_id":"r","id":%d,"ts_ms":1700000000000,"event":"e"}'
    (tmp_path / "log/a.json").write_text("\n".join([good % 1, good % 2, "{broken", '{"type":"noise"}', '{"type":"event","id":3}', '{"type":"run.started","run_id":"r"}', "[]"]) + "\n")
    (tmp_path / "log/b.json").write_text("\n".join([good % 2, good % 4, good % 2]) + "\n")
    log = tables.read_run_log(spark, f"{tmp_path}/log", streaming=True, broken=True, files_at_once=1)
    for started in streams.ingest_event_log(log, f"{tmp_path}/out", f"{tmp_path}/checkpoint"):
        started.awaitTermination(120)
        assert started.exception() is None
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/events").collect()) == [1, 2, 4]
    lines = sorted(r.line for r in spark.read.schema("line string").parquet(f"{tmp_path}/out/rejects").collect())
    assert "{broken" in lines and '{"type":"noise"}' in lines and any('"id":3' in x for x in lines) and len(lines) == 3  # an empty list is no record


def test_levels_are_merged_under_a_reader(spark, tmp_path):
    root, keys = str(tmp_path / "table"), ["k"]
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, seq long")
    for batch in range(7):
        frame([(k, f"{batch}", 10 * batch + k) for k in range(batch % 3, 5)] + [(0, "lost", -1)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = frame([]).schema
    start = lambda fan_in: upserted.stream_upsert(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), root, keys, f"{tmp_path}/checkpoint", fan_in)
    started = start(3)
    started.awaitTermination(120)
    assert started.exception() is None
    found = lambda df: sorted((r.k, r.v) for r in df.collect())
    expected = sorted({k: str(max(b for b in range(7) if b % 3 <= k)) for k in range(5)}.items())
    sets = commits.read_manifest(spark, root)["tables"]["rows"]["paths"]
    assert sorted(upserted._level(p) for p in sets) == [0, 1, 1]  # seven batches: two merges of three and one left
    reader = upserted.read_upserts(spark, root, keys)
    upserted.compact(spark, root, keys)
    assert len(commits.read_manifest(spark, root)["tables"]["rows"]["paths"]) == 1
    assert found(reader) == expected == found(upserted.read_upserts(spark, root, keys))
    gone = commits.vacuum(spark, root, keep=1)
    assert set(sets) <= set(gone) and found(upserted.read_upserts(spark, root, keys)) == expected
    version = commits.newest_version(spark, root)
    again = start(3)  # nothing new
    again.awaitTermination(120)
    assert commits.newest_version(spark, root) == version


def test_a_batch_is_committed_once_and_merges_give_way(spark, tmp_path):
    root, keys = str(tmp_path / "table"), ["k"]
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, seq long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second time with an empty checkpoint of the same name: the manifest knows the batch
        started = upserted.stream_upsert(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), root, keys, f"{tmp_path}/checkpoint")
        started.awaitTermination(120)
        assert started.exception() is None
        shutil.rmtree(f"{tmp_path}/checkpoint")
    manifest = commits.read_manifest(spark, root)
    assert len(manifest["tables"]["rows"]["paths"]) == 1
    sets = manifest["tables"]["rows"]["paths"]
    upserted._merge(spark, root, keys, sets, 1)
    upserted._merge(spark, root, keys, sets, 1)  # these are merged already: nothing is committed
    assert commits.newest_version(spark, root) == manifest["version"] + 1
    assert sorted((r.k, r.v) for r in upserted.read_upserts(spark, root, keys).collect()) == [(1, "a"), (2, "b")]


# ---------------------------------------------------------------- recognisers


def test_one_recogniser_for_each_worker_and_errors_as_rows(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for i in range(20):
        (tmp_path / f"a/b/{i}.mp3").write_bytes(bytes(16000 * (i % 4 + 1)))
    (tmp_path / "a/notes.txt").write_text("no audio")
    (tmp_path / "a/empty.mp3").write_bytes(b"")
    calls = str(tmp_path / "made")

    def make():
        import os
        import uuid

        with open(f"{calls}-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def answer(content, language):
            if len(content) == 16000:
                raise ValueError("short")
            return recognise.Answer(f"{len(content)}", language, len(content) / 16000, "own", 3)

        return answer

    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = recognise.transcribe_files(spark, str(tmp_path / "a"), make, "fr", "*.mp3").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20 and {(r.length, r.duration, r.error) for r in rows} == {(16000, None, "ValueError: short"), *((16000 * i, float(i), None) for i in (2, 3, 4))}
    made = [p.name.split("-")[1] for p in tmp_path.glob("made-*")]
    assert len(made) == len(set(made))  # at most one in each process
    with pytest.raises(ValueError, match="unknown backend"):
        recognise.transcribe(spark.createDataFrame([(1, bytearray(b""))], "id long, content binary"), "nope")


def test_files_in_packs_are_read_as_loose_ones(spark, tmp_path):
    folder = tmp_path / "a"
    (folder / "b").mkdir(parents=True)
    (folder / "b/1.mp3").write_bytes(bytes(16000))
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).select(F.lit("c/2.mp3").alias("path"), "content")  # what was found loose
    recognise.pack_files(loose, str(folder))
    rows = [("3.mp3", bytearray(32000)), ("d=1/4.wav", bytearray(5)), ("d=1/5.mp3x", bytearray(5)), ("6.mp3", bytearray()), ("7.mp3", None), ("6xmp3", bytearray(5))]
    recognise.pack_files(spark.createDataFrame(rows, "path string, content binary"), str(folder))
    base = f"file:{folder}/"
    read = lambda pattern: sorted((r.path.removeprefix(base), r.length, r.duration, r.error) for r in recognise.transcribe_files(spark, f"{folder}/", pattern=pattern).collect())
    assert read("*.mp3") == [("3.mp3", 32000, 2.0, None), ("b/1.mp3", 16000, 1.0, None), ("c/2.mp3", 16000, 1.0, None)]
    assert read("?.{mp3,wav}") == [*read("*.mp3")[:3], ("d=1/4.wav", 5, 5 / 16000, None)]
    assert len(read("*")) == 6
    # large files stand in row groups of a few, so that no batch holds many of them
    large = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("ab"), 1_000_000).cast("binary").alias("content"))
    recognise.pack_files(large, f"{tmp_path}/large")
    (pack,) = (tmp_path / "large" / recognise.PACKS).glob("*.parquet")
    groups = pq.ParquetFile(pack).metadata
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 10


def test_turns_do_not_become_files_of_their_own(spark, tmp_path):
    rows = [(c, t, "user", f"é{c}\n" * t) for c in range(-2, 20) for t in range(5)] + [(3, 1, "user", "the same turn again")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "payload-lake"
    before = set(shared.glob("audio-*"))
    got = sorted((r.conv_id, r.turn, r.length, r.text, r.duration, r.error) for r in registered.QUERIES["transcribe_files"](spark, str(tmp_path)).collect())
    assert got == sorted((c, t, n, "mock transcription", n / 16000, None) for c, t, _, text in rows for n in [len(text.encode()) + 1])
    (folder,) = set(shared.glob("audio-*")) - before
    assert len([p for p in folder.rglob("*") if p.suffix != ".crc" and p.is_file()]) <= 3


# ---------------------------------------------------------------- run reports


def report_of(spark, **options):
    found = spark.createDataFrame(
        [("old", 66, "fetch", "SUCCESS", 10, 1, 20, "{}", None), ("new", 66, "asr", "PARTIAL", 30, 2, None, '{"limit": 3}', "{}"), ("else", 88, "fetch", "SUCCESS", 5, 3, 6, "{}", "{}")],
        "run_id string, uid long, command string, status string, started_at long, seq long, ended_at long, args_json string, summary_json string",
    )
    events = spark.createDataFrame(
        [(1, "old", "INFO", "fetch.endpoint.completed", 11, "fetching", "videos", None), (2, "new", "INFO", "asr.discovery.completed", 31, "asr", None, None), (3, "new", "WARNING", "asr.item.failed", 32, "asr", None, "b2"), (4, "gone", "ERROR", "x", 1, None, None, None)],
        "id long, run_id string, level string, event string, ts_ms long, stage string, endpoint string, item_id string",
    ).withColumn("data_json", F.lit('{"candidate_count": 3}'))
    tasks = spark.createDataFrame([(66, "fetching", "SUCCESS", "{}", 1), (66, "asr", "RUNNING", '{"pipelines": {"audio": {"status": "PARTIAL"}}}', 2), (77, "asr", "FAILED", '{"pipelines": []}', 3)], "uid long, stage string, status string, payload string, updated_at_ms long")
    states = spark.createDataFrame([(66, "videos", "SUCCESS", 2, '{"done": 1}'), (66, "articles", "PARTIAL_ITEM", 0, None)], "uid long, endpoint string, status string, retry_count long, item_progress string")
    expected = spark.createDataFrame([(66, f"b{i}") for i in range(1, 7)] + [(66, "b1")], "uid long, item_id string")
    results = spark.createDataFrame([(66, "b1", "success"), (66, "b2", "failed"), (66, "b3", "running"), (66, "b4", "odd"), (66, "zz", "failed")], "uid long, item_id string, status string")
    rows = runs.run_report(found, events, tasks, states, expected, results, **options).collect()
    return {r.uid: r for r in rows}, sorted((r.item_id, r.state) for r in runs.open_items(expected, results).collect())


def test_run_report_of_all_accounts(spark):
    found, opened = report_of(spark)
    assert set(found) == {66, 77, 88} and opened == [("b2", "failed"), ("b5", "missing"), ("b6", "missing")]
    r = found[66]
    assert (r.run.run_id, r.run.command, r.run.ended_at, r.run.args_json) == ("new", "asr", None, '{"limit": 3}') and not r.coverage_applicable
    assert (r.fetch_status, r.asr_status, found[77].asr_status, found[77].run, found[77].coverage_applicable) == ("SUCCESS", "PARTIAL", None, None, True)
    assert [(e.endpoint, e.status, e.retry_count, e.item_progress, e.progress) for e in r.endpoints] == [("articles", "PARTIAL_ITEM", 0, None, None), ("videos", "SUCCESS", 2, '{"done": 1}', None)]
    assert (r.expected, r.success, r.failed, r.running, r.pending, r.skipped, r.missing, r.candidate_count) == (6, 1, 1, 1, 0, 0, 2, 3)
    assert [(s.status, s.n) for s in r.status_counts] == [("failed", 2), ("odd", 1), ("running", 1), ("success", 1)]
    assert [(e.id, e.ts_ms, e.stage, e.item_id, e.message) for e in r.recent_events] == [(2, 31, "asr", None, None), (3, 32, "asr", "b2", None)] and [e.id for e in r.attention_events] == [3]
    assert found[77].endpoints == [] and found[77].expected == 0 and found[88].recent_events == []


def test_run_report_of_one_account(spark):
    unknown, _ = report_of(spark, uid=66, run_id="gone")
    assert set(unknown) == {66} and unknown[66].run is None and unknown[66].recent_events == [] and len(unknown[66].tasks) == 2 and unknown[66].coverage_applicable
    named, _ = report_of(spark, uid=66, run_id="old")
    assert named[66].run.run_id == "old" and [e.endpoint for e in named[66].recent_events] == ["videos"] and named[66].candidate_count is None
    nobody, _ = report_of(spark, uid=5)
    assert set(nobody) == {5} and nobody[5].run is None and nobody[5].tasks == [] and nobody[5].expected == 0
    every, _ = report_of(spark, uid=66, only_run=False, n=None)
    assert [e.id for e in every[66].recent_events] == [1, 2, 3]
    assert set(report_of(spark, run_id="old")[0]) == {66} and report_of(spark, n=0)[0][66].recent_events == []

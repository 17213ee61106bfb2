"""Edge cases of the operators, against plain expectations."""

import os
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from payload_lake.functions import jsonx, scalars
from payload_lake.operators import aggregates, joins, listing, recognise, rules, runs, selects, sequences, upserts, work_items
from payload_lake.sources import registry, tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "kind"), [("{}", "object"), ("[1]", "array"), ('"a"', "string"), ("3", "integer"), ("1.5", "number"), ("true", "boolean"), ("null", "null"), ("", None), ("{", None), (None, None)])
def test_kinds(spark, text, kind):
    assert one(spark, jsonx.kind(jsonx.parsed(F.col("t"))), t=text) == kind


@pytest.mark.parametrize(
    ("payload", "path", "ids"),
    [
        ('{"a": {"b": [{"c": 1}, {"c": "x"}, {"c": null}, {}]}}', "a.b[*].c", ["1", "x"]),
        ('{"a": {"b": {"c": 1}}}', "a.b[*].c", []),
        ('{"a": ["p", "q"]}', "a", ["p", "q"]),
        ('{"a": "p"}', "a", ["p"]),
        ('{"b": 1}', "a", []),
        ("[]", "a[*].c", []),
        ('{"a": ["中文"]}', "a[*]", ["中文"]),
        ("{", "a", []),
    ],
)
def test_path_values(spark, payload, path, ids):
    assert (one(spark, jsonx.path_values(jsonx.parsed(F.col("t")), path), t=payload) or []) == ids


def test_find_items_and_total(spark):
    text = '{"list": {"vlist": [1, 2]}, "page": {"count": 1.5, "total": 7}}'
    assert one(spark, F.size(jsonx.find_items(jsonx.parsed(F.col("t")), "list")), t=text) == 2
    assert one(spark, jsonx.find_total(jsonx.parsed(F.col("t"))), t=text) == 7
    assert one(spark, jsonx.find_total(jsonx.parsed(F.col("t"))), t='{"total": true}') == 1
    assert one(spark, F.size(jsonx.find_items(jsonx.parsed(F.col("t")))), t='{"data": {"items": [1, 2, 3]}}') == 3
    assert one(spark, F.size(jsonx.find_items(jsonx.parsed(F.col("t")))), t="{}") == 0


@pytest.mark.parametrize(
    ("payload", "strategy", "page", "size", "last", "following"),
    [
        ('{"list": [1], "total": 61}', "page", 2, 30, False, "3"),
        ('{"list": [1], "total": 60}', "page", 2, 30, True, None),
        ('{"list": []}', "page", 1, 30, True, None),
        ('{"list": [1], "page": {"count": 0}, "total_count": 30}', "page", 1, 30, True, None),
        ('{"list": [1], "page": {"count": 0}, "total_count": "30"}', "page", 1, 30, False, "2"),
        ('{"has_more": "1", "offset": "z"}', "cursor", 1, 30, True, None),
        ('{"has_more": true, "offset": "z"}', "cursor", 1, 30, False, "z"),
        ('{"has_more": 0, "offset": "z"}', "cursor", 1, 30, True, None),
        ('{"anchor": 0}', "anchor", 1, 30, True, None),
        ('{"anchor": 9}', "anchor", 1, 30, False, "9"),
        ('{"has_more": 1, "next_offset": 5}', "legacy_offset", 1, 30, False, "5"),
        ('{"list": [{"aid": 0, "id": 8}]}', "oid", 1, 1, False, "8"),
        ('{"list": [{"aid": 4}]}', "oid", 1, 2, True, None),
        ("{}", "none", 1, 1, True, None),
    ],
)
def test_next_page(spark, payload, strategy, page, size, last, following):
    is_last, param = jsonx.next_page(jsonx.parsed(F.col("t")), strategy, F.lit(page), F.lit(size))
    row = spark.createDataFrame([(payload,)], "t string").select(is_last.alias("a"), param.alias("b")).first()
    assert (row.a, row.b) == (last, following)


def test_wrap_and_tolerant_decode(spark):
    assert one(spark, jsonx.wrap_result(jsonx.parsed(F.col("t"))), t="[1]") == '{"data":[1]}'
    assert one(spark, F.to_json(jsonx.object_or_empty(F.col("t"))), t="[1]") == "{}"
    assert one(spark, F.to_json(jsonx.object_or_empty(F.col("t"))), t=None) == "{}"


def test_scalars(spark):
    assert one(spark, scalars.redact(F.col("t")), t="my COOKIE") == "[REDACTED secret]"
    assert one(spark, scalars.redact(F.col("t")), t="plain") == "plain"
    assert one(spark, scalars.absolute_url(F.col("t")), t="//a/b") == "https://a/b"
    assert one(spark, scalars.norm_ns(F.col("t")), t=None) == ""
    assert one(spark, scalars.segment_seconds(F.col("d"), 650), d=100) is None
    assert one(spark, scalars.segment_seconds(F.col("d"), 650), d=101) == 100
    assert one(spark, scalars.doubling(F.lit(3), F.col("d")), d=20) == [3, 6, 12, 20]
    assert one(spark, scalars.doubling(F.lit(3), F.col("d")), d=2) == [2]
    for text, delays in [("30,60,120", [30, 60, 120]), ("60,30,120", [30, 60, 120]), ("", [30, 60, 120]), ("a,b", [30, 60, 120]), ("1.5,3", [30, 60, 120]), (" 10, 2 ,", [2, 10])]:
        assert one(spark, scalars.parse_delays(F.col("t")), t=text) == delays
    assert one(spark, scalars.parse_delays(F.col("t"), (1, 2)), t="") == [1, 2]
    assert one(spark, scalars.doubling(F.col("d"), F.lit(9)), d=0) == [] and one(spark, scalars.doubling(F.lit(1), F.col("d")), d=0) == []
    assert one(spark, scalars.is_attention(F.lit("INFO"), F.col("t")), t="x.FAILED") is True
    assert one(spark, scalars.is_stale(F.col("d"), 8 * scalars.DAY_MS, 7), d=scalars.DAY_MS) is True
    assert one(spark, F.size(scalars.fixed_ranges(F.col("d"), F.lit(60))), d=0) == 0
    assert one(spark, scalars.event_detail(F.col("t")), t='{"error": "", "retry": 2, "failed": 1}') == "retry=2 failed=1"


def clip(spark, duration, regions):
    clips = spark.createDataFrame([("a", float(duration))], "clip string, duration_s double")
    return clips, spark.createDataFrame([("a", float(s), float(e)) for s, e in regions], "clip string, start_s double, end_s double")


@pytest.mark.parametrize(
    ("duration", "regions", "most", "least", "spans"),
    [
        (300, [(0, 85), (95, 165), (175, 390)], 100, 60, [(0, 90), (90, 170), (170, 270), (267.5, 300)]),
        (80, [(0, 80)], 100, 60, [(0, 80)]),
        (0, [], 100, 60, []),
        (150, [], 100, 200, [(0, 75), (75, 150)]),
    ],
)
def test_plan_splits(spark, duration, regions, most, least, spans):
    clips, frame = clip(spark, duration, regions)
    found = sequences.plan_splits(clips, frame, most, least).orderBy("part").collect()
    assert [(r.start_s, r.end_s) for r in found] == spans


def test_gaps_of_overlapping_regions(spark):
    clips, frame = clip(spark, 10, [(1, 4), (2, 3), (6, 20), (-1, 0)])
    assert sorted((r.start_s, r.end_s) for r in sequences.gaps(frame, clips).collect()) == [(0, 1), (4, 6)]


def test_islands(spark):
    flags = [1, 1, 0, 1, 1, 0, 0, 0, 1, 0]
    frames = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "clip string, frame long, is_speech int")
    found = sequences.speech_regions(frames, 0.1, 0.2, 0.2).collect()
    assert [(r["first"], r["last"]) for r in found] == [(0, 4)]


def join_texts(left, right, probe=200, least=20):
    """Two transcripts as one, by the longest text that the end of the left and the beginning of the right share."""
    if not left or not right:
        return (left or right).strip()
    best = SequenceMatcher(None, left[-probe:], right[:probe], autojunk=False).find_longest_match()
    return (left + (right[best.b + best.size :] if best.size >= least else f" {right}")).strip()


def stitched(spark, *texts):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "item long, pos long, text string")
    return sequences.stitch(rows, ["item"]).first().text


@pytest.mark.parametrize(("size", "joined"), [(19, False), (20, True)])
def test_stitch_overlap(spark, size, joined):
    shared = "abcdefghijklmnopqrstuvwxyz"[:size]
    out = stitched(spark, "left " + shared, shared + " right")
    assert out == (f"left {shared} right" if joined else f"left {shared} {shared} right")


def test_stitch_keeps_all_of_the_left_text(spark):
    shared = "LEFT END of twenty and more"
    assert stitched(spark, f"start {shared}, tail", f"noise {shared}; right rest") == f"start {shared}, tail; right rest"
    assert stitched(spark, "", " b ") == "b" and stitched(spark, "a", "") == "a" and stitched(spark, "\u2003a\x1c\n", "\u3000b\x85") == "a b"


def test_stitch_takes_the_first_of_equal_matches(spark):
    """Few letters, long repeats and characters beyond 16 bits: many matches are equally long."""
    import random

    rng = random.Random(11)
    for alphabet in ("ab", "a", "ab\U0001f600", "abc "):
        for _ in range(12):
            core = "".join(rng.choice(alphabet) for _ in range(rng.randint(15, 60)))
            left = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 260))) + core + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
            right = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + core + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 260)))
            assert stitched(spark, left.strip() or "x", right.strip() or "y") == join_texts(left.strip() or "x", right.strip() or "y")


def test_stitch_is_a_fold_of_pairs(spark):
    import random

    rng, rows, expected = random.Random(3), [], {}
    for item in range(12):
        body = "".join(rng.choice("abcdef ") for _ in range(900))
        cuts = sorted(rng.sample(range(1, 899), 5))
        parts = [body[max(0, a - rng.randint(0, 60)) : b] for a, b in zip([0, *cuts], [*cuts, 900])] + ["", "x"]
        rows += [(item if item else None, pos, text) for pos, text in enumerate(parts)]
        out = ""
        for text in (p.strip() for p in parts):
            out = join_texts(out, text) if text else out
        expected[item if item else None] = out
    frame = spark.createDataFrame(rows, "item long, pos long, text string").repartition(5)
    assert {r.item: r.text for r in sequences.stitch(frame, ["item"]).collect()} == expected


def test_stitch_skips_blank(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (1, 2, "b"), (2, 0, None)], "item long, pos long, text string")
    assert {r.item: r.text for r in sequences.stitch(rows, ["item"]).collect()} == {1: "a b", 2: ""}


def test_cache_merge_is_a_fold(spark):
    old = spark.createDataFrame([(1, 0.0, 1.0, "N ", "o")], "item long, start_s double, end_s double, ns string, text string")
    new = spark.createDataFrame([(1, 0.08, 1.08, "n", "p", 1), (1, 0.16, 1.16, "n", "q", 2), (1, 0.0, 1.0, "m", "r", 3)], "item long, start_s double, end_s double, ns string, text string, seq long")
    assert [(r.start_s, r.ns, r.text) for r in sequences.cache_merge(old, new, ["item"]).orderBy("start_s").collect()] == [(0.0, "m", "r"), (0.16, "n", "q")]


def test_cache_merge_equals_the_fold(spark):
    import random

    rng = random.Random(8)
    row = lambda: (rng.randint(0, 1), round(rng.uniform(0, 1.5), 2), round(rng.uniform(0, 0.4), 2), rng.choice(["a", "B ", None]), str(rng.random()))
    old, new = [row() for _ in range(60)], [(*row(), i) for i in range(80)]
    kept = list(old)
    near = lambda x, y: x[0] == y[0] and (x[3] or "").strip().lower() == (y[3] or "").strip().lower() and abs(x[1] - y[1]) <= 0.1 and abs(x[2] - y[2]) <= 0.1
    for r in new:
        kept = [k for k in kept if not near(k, r)] + [r[:5]]
    schema = "item long, start_s double, end_s double, ns string, text string"
    found = sequences.cache_merge(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema + ", seq long"), ["item"]).collect()
    assert sorted(r.text for r in found) == sorted(k[4] for k in kept)


def test_cache_lookup_at_the_tolerance(spark):
    schema = "uid long, id long, start_s double, end_s double, ns string"
    wanted = spark.createDataFrame([(1, 1, 10.0, 20.0, " A"), (1, 2, 10.5, 20.0, "a")], schema)
    cached = spark.createDataFrame([(1, 7, 10.05, 20.05, "a"), (1, 8, 9.95, 20.0, "a"), (1, 9, 10.0, 20.0, "b")], schema)
    assert [(r.wanted_id, r.cached_id) for r in joins.cache_lookup(wanted, cached, ["uid"], ["ns"]).collect()] == [(1, 8)]


def test_work_items_cases(spark):
    payloads = [
        ('{"info": {"cid": 5, "duration": 9, "pages": [{"cid": 1, "duration": 2, "part": "x"}, 3, {"cid": "7"}]}}', [(0, 1, 2), (2, 7, 0)]),
        ('{"info": {"cid": 5, "duration": 9, "pages": [3]}}', [(0, 5, 9)]),
        ('{"info": {}}', [(0, 0, 0)]),
        ("[]", []),
        ("{", []),
        (None, []),
    ]
    rows = spark.createDataFrame([(1, str(i), p) for i, (p, _) in enumerate(payloads)], "uid long, item_id string, payload string")
    found = work_items.work_items(rows).collect()
    for i, (_, expected) in enumerate(payloads):
        assert sorted((r.page_index, r.cid, r.duration_s) for r in found if r.item_id == str(i)) == expected


def test_subtitle_rejects(spark):
    payload = '{"subtitle": [{"page_index": 0, "result": {"subtitles": [{"lan": "zh"}, {"lan": "en"}]}, "content": [{"body": [{"from": 0.5, "to": 1, "content": "hi"}]}, {"lan": "en", "_fetch_error": "x"}]}]}'
    cues, bad = work_items.subtitle_rows(spark.createDataFrame([(1, "a", payload)], "uid long, item_id string, payload string"))
    assert [(r.lan, r.from_s, r.content) for r in cues.collect()] == [("zh", 0.5, "hi")]
    assert [(r.lan, r.error) for r in bad.collect()] == [("en", "x")]


@pytest.mark.parametrize(
    ("payload", "error"),
    [
        ('{"choices": [{"finish_reason": "stop", "message": {"content": " hi "}}], "usage": {"seconds": 3, "prompt_tokens_details": {"audio_tokens": 20}}}', None),
        ('{"choices": []}', "ASRAPIError"),
        ('{"error": {"code": "x"}}', "ASRAPIError"),
        ('{"choices": [{"finish_reason": "length", "message": {"content": "hi"}}]}', "LengthTruncatedError"),
        ('{"choices": [{"message": {"content": 3}}]}', "ASRAPIError"),
        ('{"choices": [{"message": {"content": " "}}]}', "EmptyTranscriptError"),
        ('{"choices": [{"message": {"content": "The request was rejected because it was considered high risk"}}]}', "ASRAPIError"),
    ],
)
def test_parse_responses(spark, payload, error):
    good, bad = sequences.parse_responses(spark.createDataFrame([(payload,)], "payload string"), scalars.REFUSAL)
    if error is None:
        row = good.first()
        assert (row.text, row.seconds, row.audio_tokens, row.model) == ("hi", 3.0, 20, "mimo-v2.5-asr")
    else:
        assert [r.error_class for r in bad.collect()] == [error]


@pytest.mark.parametrize(
    ("states", "status"),
    [
        (["SUCCESS", "PARTIAL_ITEM"], "SUCCESS"), (["SUCCESS", "FAILED_PERMANENT"], "PARTIAL"), (["FAILED_PERMANENT", "FAILED_EXHAUSTED"], "FAILED_PERMANENT"),
        (["FAILED_EXHAUSTED", "PENDING"], "FAILED_EXHAUSTED"), (["FAILED_RETRYABLE", "SUCCESS"], "FAILED_RETRYABLE"), (["PENDING", "SUCCESS"], "PARTIAL"), ([None], "PENDING"),
    ],
)
def test_task_status(spark, states, status):
    rows = spark.createDataFrame([(1, s) for s in states], "uid long, status string")
    assert aggregates.derive_task_status(rows, ["uid"]).first().task_status == status


@pytest.mark.parametrize(
    ("states", "stage", "run"),
    [
        (["SUCCESS", "SUCCESS"], "SUCCESS", "SUCCESS"), (["FAILED_PERMANENT", "PARTIAL"], "FAILED_PERMANENT", "FAILED"), (["FAILED_PERMANENT", "SUCCESS"], "PARTIAL", "PARTIAL"),
        (["RUNNING", "FAILED_PERMANENT"], "RUNNING", "RUNNING"), (["odd", "SUCCESS"], "PARTIAL", "PARTIAL"), ([], "SUCCESS", "SUCCESS"),
    ],
)
def test_stage_status(spark, states, stage, run):
    rows = spark.createDataFrame([(1, s) for s in states], "uid long, status string")
    row = aggregates.derive_stage_status(rows, spark.createDataFrame([(1, True)], "uid long, complete boolean"), ["uid"]).first()
    assert (row.stage_status, row.run_status) == (stage, run)


@pytest.mark.parametrize(("buckets", "status"), [([(2, 1, 1, 0)], "PARTIAL"), ([(3, 1, 0, 0), (0, 2, 0, 0)], "RUNNING"), ([(0, 0, 1, 0)], "FAILED_PERMANENT"), ([(0, 0, 0, 0)], "SUCCESS"), ([(1, 0, 0, 1)], "SUCCESS")])
def test_pipeline_rollup_asks_each_bucket(spark, buckets, status):
    rows = spark.createDataFrame([(1, *b) for b in buckets], "uid long, total long, completed long, failed long, skipped long")
    assert aggregates.pipeline_rollup(rows, ["uid"]).first().status == status


@pytest.mark.parametrize(("kinds", "skipped"), [((4, 5, 41, 2), True), ((4, 5, 42, 0), True), ((4, 5, 41, 1), False), ((0, 0, 0, 0), False), ((4, 5, None, 2), False), ((4, 6, 41, 2), False)])
def test_skip_needs_all_four_kinds(spark, kinds, skipped):
    row = spark.createDataFrame([kinds], "a long, b long, c long, d long").select(selects.skip_reason(*map(F.col, "abcd")).isNotNull().alias("x")).first()
    assert row.x is skipped


def test_run_summary_without_runs_and_of_a_named_run(spark):
    schema = "run_id string, uid long, command string, status string, started_at long, seq long, args_json string, summary_json string"
    found = spark.createDataFrame([("old", 66, "fetch", "SUCCESS", 1, 1, "{}", None), ("new", 66, "asr", "PARTIAL", 2, 2, '{"limit": 3}', "{}")], schema)
    events = spark.createDataFrame([(1, "old", "INFO", "fetch.endpoint.completed", "{}"), (2, "new", "INFO", "asr.discovery.completed", '{"candidate_count": 3}'), (3, "new", "WARNING", "asr.coverage.partial", "{}")], "id long, run_id string, level string, event string, data_json string")
    tasks = spark.createDataFrame([(77, "asr", "PARTIAL")], "uid long, stage string, status string")
    states = spark.createDataFrame([(66, "videos", "SUCCESS")], "uid long, endpoint string, status string")
    coverage = spark.createDataFrame([(77, 2, 1, False)], "uid long, expected long, success long, complete boolean")
    summary = lambda **rest: {r.uid: r for r in runs.run_summary(found, events, tasks, states, coverage, **rest).collect()}
    both = summary(n=1)
    assert set(both) == {66, 77} and both[77].run_id is None and both[77].coverage_applicable and both[77].expected == 2 and [tuple(x) for x in both[77].tasks] == [("asr", "PARTIAL")]
    assert (both[66].run_id, both[66].candidate_count, both[66].coverage_applicable) == ("new", 3, False) and [e.event for e in both[66].recent_events] == ["asr.coverage.partial"]
    named = summary(run_id="old")
    assert set(named) == {66} and [e.event for e in named[66].recent_events] == ["fetch.endpoint.completed"]
    assert len(summary(only_run=False)[66].recent_events) == 3 and set(summary(uid=77)) == {77}


def test_task_status_and_marks(spark):
    tasks = spark.createDataFrame([(1, "asr", "RUNNING", 3), (2, "asr", "odd", 3)], "uid long, stage string, status string, updated_at_ms long")
    meta = spark.createDataFrame([(1, "last_processed_at_ms", "2"), (1, "x", "y")], "uid long, key string, value string")
    changes = spark.createDataFrame([(1, "asr", "RUNNING", 7, 1), (1, "asr", "FAILED", 8, 2), (1, "asr", "RUNNING", 9, 3)], "uid long, stage string, status string, at_ms long, seq long")
    new_tasks, new_meta = upserts.update_task_status(tasks, meta, changes)
    assert {(r.uid, r.status, r.updated_at_ms) for r in selects.task_states(new_tasks, "asr").collect()} == {(1, "RUNNING", 9), (2, "PENDING", 3)}
    assert {(r.key, r.value) for r in new_meta.collect()} == {("last_processed_at_ms", "8"), ("x", "y")}
    assert [r.value for r in selects.meta_value(new_meta, "x").collect()] == ["y"]


def test_subset_errors_and_profiles(spark):
    rows = registry.endpoint_registry(spark)
    assert [r.name for r in selects.checked_subset(rows, profile="minimal").orderBy("place").collect()] == ["user_info", "videos", "articles", "opus", "dynamics"]
    with pytest.raises(ValueError, match="unknown names: nope"):
        selects.checked_subset(rows, exclude=spark.createDataFrame([("nope",)], "name string"))
    with pytest.raises(ValueError, match="nothing is left"):
        selects.checked_subset(rows, exclude=rows.select("name"))
    with pytest.raises(ValueError, match="unknown profile"):
        selects.resolve_subset(rows, profile="nope")


def test_declared_rules_ask_for_values(spark):
    rows = spark.createDataFrame([(None, "{}", 1), ("odd", "{}", 1), ("success", None, -1)], "status string, payload string, processed_at_ms long")
    own = {k: v for k, v in rules.table_rules("audio_transcription").items() if k in ("status", "status_given", "payload_given", "processed_at", "processed_at_ms_given")}
    assert {r.rule: r.violations for r in rules.check_rules(rows, own).collect()} == {"status": 1, "status_given": 1, "payload_given": 1, "processed_at": 1, "processed_at_ms_given": 0}
    for table in rules.REQUIRED:
        frame = spark.createDataFrame([], f"uid long, {tables.SCHEMAS[table]}")
        assert all(r.violations == 0 for r in rules.check_rules(frame, rules.table_rules(table)).collect())


def test_entry_works_without_the_packages_of_the_llm_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'coverage_report' in q and 'op8_sentencepiece' not in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_run_guard_at_the_threshold(spark):
    rows = spark.createDataFrame([(1, "asr", "RUNNING", 100), (2, "asr", "RUNNING", 101), (3, "asr", "RUNNING", None), (4, "asr", "SUCCESS", 101)], "uid long, stage string, status string, updated_at_ms long")
    assert {r.uid: r.guard for r in runs.run_guard(rows, 200, 100).collect()} == {1: "takeover", 2: "blocked", 3: "takeover", 4: "free"}


def test_merge_listing_keeps_empty_and_new_pages(spark):
    schema = "uid long, page_no long, ids array<string>"
    fresh = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, [])], schema)
    stored = spark.createDataFrame([(1, 1, ["b"]), (1, 2, ["b", "c"])], schema)
    assert sorted((r.is_stored, r.page_no) for r in listing.merge_listing(fresh, stored).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_incremental_boundary_safety_page(spark):
    pages = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b"]), (1, 3, ["c"]), (1, 4, ["d"])], "uid long, page_no long, ids array<string>")
    known = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d")], "uid long, item_id string")
    none = spark.createDataFrame([], "uid long")
    assert sorted(r.page_no for r in listing.incremental_boundary(pages, known, none).collect()) == [1, 2, 3]
    assert sorted(r.page_no for r in listing.incremental_boundary(pages, known, spark.createDataFrame([(1,)], "uid long")).collect()) == [1, 2, 3, 4]


def test_recent_events_of_none(spark):
    events = spark.createDataFrame([(1,)], "id long")
    assert runs.recent_events(events, 0).count() == 0


def test_empty_manifest(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    meta = spark.createDataFrame([(1, "schema_version", "3")], "uid long, key string, value string")
    row = aggregates.manifest_summary(empty("uid long, endpoint string"), empty("uid long, status string, audio_tokens long, seconds double, cache_hits long"), empty("uid long, stage string"), meta).first()
    assert (row.schema_version, row.raw_payload_count, row.total_audio_seconds, row.asr_error_count) == ("3", 0, 0, 0)


def test_patch_map_entry(spark):
    rows = spark.createDataFrame([({"a": ("RUNNING", 1, "c")},)], "p map<string, struct<status: string, items: long, coverage: string>>")
    out = upserts.patch_map_entry(rows, "p", "a", F.lit("DONE"), F.lit(None).cast("long"), F.lit("d")).first().p
    assert tuple(out["a"]) == ("DONE", 1, "d")


def test_derived_rows_go_when_an_item_fails(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b")], "uid long, item_id string")
    results = spark.createDataFrame([(1, "a", "failed", "{}")], "uid long, item_id string, status string, payload string")
    full = upserts.explode_pages(results).select(*upserts.PAGE_COLUMNS)
    kept = upserts.materialise_pages(results, stored.join(full.limit(0), ["uid", "item_id"], "left").select(*upserts.PAGE_COLUMNS))
    assert [r.item_id for r in kept.collect()] == ["b"]


def test_subset_unknown_names(spark):
    registry_rows = spark.createDataFrame([("a",), ("b",)], "name string")
    chosen, unknown = selects.resolve_subset(registry_rows, include=spark.createDataFrame([("b", 0), ("z", 1)], "name string, place long"))
    assert [r.name for r in chosen.collect()] == ["b"]
    assert [r.name for r in unknown.collect()] == ["z"]


def test_rules_pass_on_null(spark):
    rows = spark.createDataFrame([(None,), (-1,), (2,)], "seconds long")
    assert {r.rule: r.violations for r in rules.check_rules(rows, {"s": "seconds >= 0"}).collect()} == {"s": 1}
    assert [r.seconds for r in rules.violations(rows, {"s": "seconds >= 0"}).collect()] == [-1]


def test_registry_and_uids(spark):
    rows = endpoint = registry.endpoint_registry(spark)
    assert (rows.count(), rows.where("scope = 'account'").count(), rows.select("name").distinct().count()) == (63, 33, 63)
    assert endpoint.where("source_endpoint = 'videos'").count() == 24
    assert sorted(r.uid for r in tables.list_uids(spark.createDataFrame([("7",), ("x",), ("0",), ("7",)], "uid string")).collect()) == [7]


def test_table_round_trip_replaces_one_account(spark, tmp_path):
    write = lambda rows: tables.write_table(spark.createDataFrame(rows, "uid long, key string, value string"), str(tmp_path), "meta")
    write([(1, "a", "x"), (2, "a", "y")])
    write([(2, "a", "z")])
    assert sorted((r.uid, r.value) for r in tables.read_table(spark, str(tmp_path), "meta").collect()) == [(1, "x"), (2, "z")]
    assert [r.value for r in tables.read_table(spark, str(tmp_path), "meta", 2).collect()] == ["z"]


def test_mock_recogniser(spark):
    rows = spark.createDataFrame([(1, bytearray(32000)), (2, None)], "id long, content binary")
    assert {r.id: (r.duration, r.language, r.tokens) for r in recognise.transcribe(rows).collect()} == {1: (2.0, "zh", 0), 2: (0.0, "zh", 0)}


VIEW_CASES = [
    ("overview_stat", '{"video": {"video_count": 3}, "article": 2, "opus_count": 1}', {"videos": 3, "articles": 2, "opus": 1}),
    ("space_notice", '"hello"', {"text": "hello"}),
    ("user_info", '{"mid": 1, "vip": {"label": "old"}}', {"mid": 1, "vip_label": "old", "name": None}),
    ("dynamics", '{"pages": [{"items": [{"id_str": "9", "modules": [{"module_author": {"mid": 4, "pub_ts": "77"}}]}]}]}', {"id": "9", "author_mid": 4, "published_s": 77}),
    ("channel_list_series", '{"pages": [{"items_lists": {"series_list": [{"meta": {"series_id": 5, "name": "s"}}]}}]}', {"series_id": "5", "name": "s"}),
    ("article_list", '{"lists": [{"id": 8, "words": 10}]}', {"id": 8, "words": 10}),
    ("channel_videos_season", '{"archives": [{"bvid": "B", "play": 2}]}', {"bvid": "B", "play": 2}),
    ("opus_detail", '{"info": {"item": {"basic": {"rid_str": "r"}}}, "markdown": "m"}', {"rid": "r", "markdown": "m"}),
]


@pytest.mark.parametrize(("view", "payload", "expected"), VIEW_CASES)
def test_typed_views(spark, view, payload, expected):
    from payload_lake.sources.views import OF_ENDPOINT

    rows = spark.createDataFrame([(1, "", OF_ENDPOINT.get(view, view), p) for p in (payload, "[", "{}", "3", None)], "uid long, item_id string, endpoint string, payload string")
    found = [r.asDict() for r in work_items.typed_view(rows, view).collect()]
    assert any(all(f[k] == v for k, v in expected.items()) for f in found)


def test_every_view_parses(spark):
    from payload_lake.sources.views import LISTINGS, SINGLE

    rows = spark.createDataFrame([], "uid long, item_id string, endpoint string, payload string")
    assert all(work_items.typed_view(rows, view).columns[:2] == ["uid", "item_id"] for view in [*SINGLE, *LISTINGS])


def test_stale_runs_follow_the_exact_threshold(spark, tmp_path):
    from payload_lake.streaming import events as streams

    minutes = {"old": -2000, "two days": -2879, "just stale": -16, "just alive": -14, "ended": -500, "closing": 0}
    rows = [(run, "run.completed" if run == "ended" else "item.saved", 1_700_000_000 + 60 * m) for run, m in minutes.items()]
    frame = spark.createDataFrame(rows, "run_id string, event string, s long").selectExpr("run_id", "event", "timestamp_seconds(s) AS ts")
    frame.write.parquet(f"{tmp_path}/in")
    alerts = streams.stream_stale_runs(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    started = alerts.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination(60)
    found = {r.run_id: r.last_ts_ms for r in spark.read.schema(alerts.schema).parquet(f"{tmp_path}/out").collect()}
    assert found == {run: (1_700_000_000 + 60 * minutes[run]) * 1000 for run in ("old", "two days", "just stale")}

"""Collocations, exact block search and the filter audit against brute force, and the SQL of the llm queries."""

import itertools
import os
import re
from collections import Counter, defaultdict
from math import isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from payload_lake.llm import block_search, collocations, filter_audit, queries
from payload_lake.llm import quotient_filter as qf

from test_llm import WORD, awkward, lower, prose

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()
SCHEMA = "doc_id long, text string, lang string"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---------------------------------------------------------------- registered queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@given
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_llm_query_equals_its_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda frame: sorted((tuple(r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None)), key=repr)
    assert plain(ours) == plain(theirs)


CONTRACTS = {
    "op1_knn_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_minhash_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_suffix_array": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_ngram_perplexity": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_minimax_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_block_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@given
@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns_are_those_of_the_contract(spark, name):
    out = queries.QUERIES[name](spark, SF)
    types = dict(out.dtypes)
    assert {c.split(" ")[0]: types.get(c.split(" ")[0]) for c in CONTRACTS[name].split(", ")} == dict(c.split(" ") for c in CONTRACTS[name].split(", "))
    if "doc_id" in types:
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# ---------------------------------------------------------------- quotient filters


@pytest.mark.parametrize("n,width", [(2, 42), (3, 42), (2, 64), (3, 64)])
def test_filters_lose_nothing(n, width):
    rng = np.random.default_rng(n * width)
    ids = [rng.integers(0, 1 << min(width, 62), 5000, dtype=np.uint64) for _ in range(n)]
    ids = [np.concatenate([x, x[:700], x[:40]]) for x in ids]
    ids[0][:2] = 0, (1 << width) - 1
    plain = Counter(zip(*(x.tolist() for x in ids), strict=True))
    lanes = qf.permute(qf.pack(ids, width), n, width)
    assert [x.tolist() for x in qf.unpack(qf.restore(lanes, n, width), n, width)] == [x.tolist() for x in ids]
    keys, counts = qf.summed(lanes)
    counts = counts.copy()
    counts[7], counts[8] = 254, 1 << 40
    for bits in (0, 3, 9):
        back, total = [], []
        for part, blob in qf.slices(keys, counts, bits, n, width):
            k, c = qf.decode(blob, part, n, width)
            back.append(k)
            total.append(c)
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*back, strict=True), keys, strict=True))
        assert (np.concatenate(total) == counts).all()
    keys, counts = qf.summed(lanes)
    found = dict(zip(zip(*(x.tolist() for x in qf.unpack(qf.restore(keys, n, width), n, width)), strict=True), counts.tolist(), strict=True))
    assert found == plain


def test_keys_with_one_leading_lane_stay_apart():
    lanes = [np.array([5, 5, 5, 5], np.uint64), np.array([2, 1, 2, 1], np.uint64) << np.uint64(44)]
    keys, counts = qf.summed(lanes)
    assert counts.tolist() == [2, 2] and (keys[1] >> np.uint64(44)).tolist() == [1, 2]
    blobs = [b for _, b in qf.slices(keys, counts, 0, 2, 42)] * 3
    merged, sums = qf.merge(blobs, 0, 2, 42)
    assert sums.tolist() == [6, 6] and (merged[0] == 5).all()


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, least=10, share=50, top=2000):
    words, grams = defaultdict(Counter), {2: defaultdict(Counter), 3: defaultdict(Counter)}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang].update(w)
            for n in (2, 3):
                grams[n][lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang in words:
        n, f = sum(words[lang].values()), {(w,): c for w, c in words[lang].items()} | grams[2][lang] | grams[3][lang]
        frequent = {g: a for k in (2, 3) for g, a in grams[k][lang].items() if a >= least}
        found = []
        for g, a in frequent.items():
            if any(len(h) > len(g) and 100 * b >= share * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in frequent.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rows = [r[:3] for r in awkward()]
    for i in range(40):
        rows.append((1000 + i, f"New  York City, {prose(6, i % 9)}. new york;\t{'ä ö' if i % 2 else 'New York City'} x{i}\x0bYork city", ["en", "fr", None, "und"][i % 4]))
        rows.append((2000 + i, "b a b a b a c! c a b " * (i % 4), "en"))
    return rows


@pytest.mark.parametrize("top", [2000, 7])
def test_phrases_equal_brute_force(spark, top):
    rows = phrase_rows()
    got = collocations.collocations(docs_of(spark, rows), top=top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(rows, top=top)


def test_phrases_by_small_packs_in_many_rounds(spark, monkeypatch):
    """More slices than a pack is cut into at first, filters merged two at a time, wide ids."""
    for name, value in {"PACK": 300, "WORDS_HELD": 50, "SLICE": 16, "FIRST_BITS": 2, "MORE_BITS": 3, "FAN_IN": 2}.items():
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.chosen_ids, "__defaults__", (((64, 0),),))
    rows = phrase_rows()
    got = collocations.collocations(docs_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows)


def test_ids_that_words_share_are_passed_over(spark):
    words = spark.createDataFrame([("en", 1 << 30, 20), ("de", (1 << 30) + 1, 3), ("fr", 7, 2)], "lang string, h long, f long")
    assert collocations.chosen_ids(words, 10, ((42, 0), (42, 22))) == (42, 22)
    assert collocations.chosen_ids(words, 30, ((42, 0), (42, 22))) == (42, 0)
    with pytest.raises(ValueError):
        collocations.chosen_ids(words, 10, ((42, 0),))


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long").select(collocations.score("a", "l", "r")).first()[0]
    assert row == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).collect() == []
    assert collocations.collocations(docs_of(spark, [(1, None, "en"), (2, "", None), (3, "a b", "en")])).collect() == []


def test_bytes_that_are_no_text_are_parts_of_words(spark):
    odd = spark.createDataFrame([(bytearray(b"A\xff\xfe b ") * 12, "en")], "text binary, lang string").withColumn("text", F.col("text").cast("string"))
    # two-word phrases stand inside three-word ones nearly as often and go
    assert [(r.a, r.n) for r in collocations.collocations(odd).orderBy("rank").collect()] == [(11, 24), (11, 24)]


# ---------------------------------------------------------------- block search


def brute_top(rows, k, divisor):
    sound = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in sound:
        if i % divisor == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)  # noqa: B905  shorter ones count as filled up
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(seed, n=700, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.6, (7, dims))
    rows = [(int(i), [float(x) for x in np.float32(centres[i % 7] + rng.normal(0, 0.1, dims))]) for i in rng.permutation(n)]
    same = [float(x) for x in np.float32(centres[0])]
    rows += [(n + i, same) for i in range(250)]  # a third are one vector
    rows += [(5000, None), (5001, [None] * dims), (5010, [float("nan")] * dims), (5011, [float("inf")] + [0.0] * (dims - 1)), (None, same), (5020, []), (5030, same[:3]), (5040, [0.0] * dims), (700, same), (5050, same), (5050, same)]
    return rows


def searched(spark, rows, divisor=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    vectors = df.select("vec_id", block_search.quantised(F.col("embedding")).alias("v"))
    return sorted(map(tuple, block_search.top_k(vectors, F.col("vec_id") % divisor == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block": 16, "group": 3}, {"block": 8, "group": 64, "batch_bytes": 1 << 11}, {"k": 3, "block": 1}])
def test_search_equals_brute_force(spark, options):
    rows = vectors_of(3)
    assert searched(spark, rows, **options) == brute_top(rows, options.get("k", 10), 10)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) * 300_000.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_search.top_k(df.select("vec_id", block_search.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 10 == 0, block=8)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 10)


def test_blocks_below_the_kth_entry_are_not_scored():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (20, 8))
    centres *= 1000 / np.linalg.norm(centres, axis=1, keepdims=True)
    blocks = []
    for b in range(20):
        x = (centres[b] + rng.normal(0, 5, (16, 8))).astype(np.int64)
        ids, vectors, width, high, low = block_search._block([np.arange(16) + 100 * b], [x])
        blocks.append({"ids": ids, "vectors": vectors, "width": width, "high": high, "low": low})
    queries = (centres[:5] + 3).astype(np.int64)
    nothing = np.full(5, block_search.LEAST), np.full(5, block_search.LAST)
    search = block_search.BlockSearch(np.full(5, -1), queries, block_search.Best(10, *nothing))
    search.group(blocks)
    assert search.scored < 0.4 * search.seen
    query, _, ids = search.best.entries
    assert all((ids[query == q] // 100 == q).sum() >= 8 for q in range(5))


def test_search_of_nothing_and_of_few(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(1, [1.0])]) == []
    assert searched(spark, [(0, [1.0]), (1, [2.0]), (2, None)]) == [(0, 1, 1, 1024 * 2048)]


# ---------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    first, cells = {}, []
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, lang in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and first[text] < d}
        cells.append((lang or "", {x for x, f in fails.items() if f}, d in good, d in toxic))
    out = []
    for part in {c[0] for c in cells}:
        removed_by = Counter()
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [c for c in cells if c[0] == part]
            for step, x in enumerate(order):
                gone = [c for c in left if x in c[1]]
                every = [c for c in cells if c[0] == part]
                left = [c for c in left if x not in c[1]]
                removed_by[x] += len(gone)
                redundant = sum(x in c[1] for c in every) - len(gone)
                lines.append([part, order, step + 1, len(left), len(gone), redundant, sum(c[1] == {x} for c in every), sum(c[2] for c in gone), sum(c[3] for c in gone), x])
        out += [(*line[:9], removed_by[line[9]]) for line in lines]
    return sorted(out)


def audit_rows():
    rows = [r[:3] for r in awkward()]
    long = prose(300, 77)
    header = "same header " * 400
    rows += [(3000 + i, long, ["en", "de", "", None][i % 4]) for i in range(60)]
    rows += [(4000 + i, header + str(i // 2), "en") for i in range(30)] + [(5000, long[:900], "en"), (5001, long[:901], "en"), (2, "other", "en"), (2, "", "en")]
    rows += [(6000 + i, x, "fr") for i, x in enumerate(["A|b", "ÄÖÜ AB", "a" * 33 + "A", "a" * 32 + "A", "#" + long, "x y " * 100, "w " * 199, "Zz\x0bq"])]
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 40)] + [(3000 + i, 1, i % 2) for i in range(0, 60, 3)] + [(3000, 0, 0), (3000, None, 1), (None, 1, 1)]
    return rows, labels


def audited(spark, rows, labels, **options):
    masks = filter_audit.failure_masks(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    return sorted(map(tuple, filter_audit.orders_of(masks).collect()))


@pytest.mark.parametrize("held", [24 << 20, 2000])
def test_audit_equals_brute_force(spark, held):
    rows, labels = audit_rows()
    assert audited(spark, rows, labels, held=held) == brute_audit(rows, labels)


def test_audit_with_deep_regions_and_salted_texts(spark, monkeypatch):
    """A tiny region: prefixes grow to whole texts, and copies of one text are salted and meet in a second round."""
    regions = filter_audit._regions
    monkeypatch.setattr(filter_audit, "_regions", lambda texts: regions(texts, least=500))
    rows, labels = audit_rows()
    assert audited(spark, rows, labels, held=1500) == brute_audit(rows, labels)


def test_audit_of_text_ids_and_of_nothing(spark):
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    docs = spark.createDataFrame([("b", "same", "en"), ("a", "same", "en"), ("c", "other", "en")], "doc_id string, text string, lang string")
    first = filter_audit.audit_filters(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (first.kept, first.removed, first.good_lost) == (2, 1, 1)
    assert filter_audit.audit_filters(docs.limit(0), labels).collect() == []


def test_tries_hold_smallest_ids_in_order():
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 1000, b"b" * 999 + b"c", b"b" * 999, b"ab"]
    trie = filter_audit.RadixTrie()
    for i, x in enumerate(texts):
        trie.insert(x, 100 - i, i)
    assert [(x, d) for x, d, _ in trie.terminals()] == [(x, 100 - max(i for i, y in enumerate(texts) if y == x)) for x in sorted(set(texts))]

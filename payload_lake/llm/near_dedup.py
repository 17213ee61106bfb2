"""Near-duplicate documents by a MinHash LSH forest, links confirmed on full shingle sets.

Documents with equal shingle sets are one class from the start, whatever their
number. The classes enter a forest of ``TREES`` trees; each tree orders them by
their signature, read from another slot on. A region of a tree are the classes
that share the first ``DEPTH`` slots. In every region the order goes on through
the later slots, so neighbours have the longest prefixes in common, as deep as the
region is dense. Next neighbours are candidates, and in a region of up to ``REACH`` + 1
classes all pairs are.

Candidates whose sizes or signatures rule out the threshold are dropped (a pair
at the threshold passes with a probability of 1 - 3e-9); the others are verified
on the full sets, and verified links make components. In a larger region that is
still of several components, what is outside its largest component is compared
with the whole region, block by block (regions around one component are taken
together): first by signatures, of which the closest of each class in a block
are verified, then by the sets of what is not yet one component. So no link that
the trees can see is lost, and members of one component are never paired off with
each other. Components are built by joins on the shared folder.

A pair at the threshold of 0.8 is missed by all trees with a probability of
(1 - 0.8^4)^32 < 1e-7.

Defined cases: a document without words (null or empty text) has an empty set
and is linked with nothing; fewer words than a shingle make one shingle; rows
that share a doc_id are one node; a row with a null doc_id is passed on with its
own size, a null component and kept; doc_id may be of any type that orders and stays as
it is; very long texts are read whole; further columns are not read (``keep_one``
passes them on, whatever their names); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .stage import numbered_ids, settled, staged, table, trimmed
from .words import binary_column, chunks, mix, shingles, word_hashes

TREES, DEPTH = 32, 4
SLOTS = TREES * DEPTH
REACH = 3
#: bytes of the signature by which a region is ordered, classes of a block, and candidates of a class in a block that are tried first
ORDER, BLOCK, CLOSEST = 28, 256, 2
AGREE = 76
_RNG = np.random.default_rng(20_250_101)
_SCALE = (_RNG.integers(1, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _RNG.integers(0, 2**32, SLOTS, dtype=np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``SLOTS`` hash functions over the shingles."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        values = low[None, start : start + 2048] * _SCALE + _SHIFT
        values ^= values >> np.uint32(16)
        values *= np.uint32(0x7FEB352D)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def tree_keys(sign: np.ndarray) -> np.ndarray:
    """For each tree a hash of the slots that its members share."""
    part = sign.reshape(TREES, DEPTH).astype(np.uint64)
    key = np.arange(TREES, dtype=np.uint64)
    for j in range(DEPTH):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j] + np.uint64(1))
    return key


def _signatures(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, keys, signs = [], [], [], [], []
            for chunk in chunks(binary_column(batch, "text")):
                hashes, w = word_hashes(chunk, lower=True)
                for i in range(len(w.rows) - 1):
                    own = shingles(hashes[w.rows[i] : w.rows[i + 1]], size)
                    n.append(len(own))
                    k1.append(int(mix(own).sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    sign = signature(own) if len(own) else None
                    keys.append(None if sign is None else tree_keys(sign).view(np.int64))
                    signs.append(None if sign is None else sign.astype(np.uint8).tobytes())
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            columns = [ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "keys", "sign"])

    return run


def _sets(size: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for chunk in chunks(binary_column(batch, "text")):
                hashes, w = word_hashes(chunk, lower=True)
                sets += [shingles(hashes[a:b], size).view(np.int64) for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _possible(sign_a: np.ndarray, sign_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and signatures leave the threshold possible."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    # AGREE is for 80 percent; other thresholds keep the same distance of 5.8 deviations
    share = percent / 100
    least = AGREE if percent == 80 else SLOTS * share - 5.8 * np.sqrt(SLOTS * share * (1 - share))
    return sizes & ((sign_a == sign_b).sum(axis=1) >= least)


def _agreeing(percent: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            if batch.num_rows:
                ok = _possible(_bytes(get("sign_a")), _bytes(get("sign_b")), get("n_a").to_numpy(), get("n_b").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([get("a").filter(pa.array(ok)), get("b").filter(pa.array(ok))], ["a", "b"])

    return run


@trimmed
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, small) in the order of the trees: neighbours of a region, and all pairs of a small one."""
    key, ids, small = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        old = len(key)
        key, ids = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
        small = np.concatenate([small, batch.column(2).to_numpy(zero_copy_only=False)])
        a, b = [], []
        for lag in range(1, REACH + 1):
            right = np.arange(max(lag, old), len(key))
            right = right[(key[right - lag] == key[right]) & (ids[right - lag] != ids[right]) & (small[right] | (lag == 1))]
            a.append(np.minimum(ids[right - lag], ids[right]))
            b.append(np.maximum(ids[right - lag], ids[right]))
        key, ids, small = key[-REACH:], ids[-REACH:], small[-REACH:]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _across(percent: int):
    """Of rows with a block of a region and a block of what is outside its largest component: links between different components.

    With signatures alone these are the closest candidates of each class; with the
    sets it is one verified link of each class and component, if there is one.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                members, queries = (batch.column(batch.schema.get_field_index(c))[k].values for c in ("members", "queries"))
                get = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
                exact = members.type.get_field_index("shingles") >= 0
                signs, ids, n, roots = _bytes(members.field("sign")), get(members, "id"), get(members, "n"), get(members, "root")
                own = zip(_bytes(queries.field("sign")), *(get(queries, c).tolist() for c in ("id", "n", "root")), strict=True)
                for i, (sign, own_id, own_n, own_root) in enumerate(own):
                    near = np.flatnonzero(_possible(signs, sign[None], n, own_n, percent) & (roots != own_root))
                    near = near[np.argsort(-(signs[near] == sign).sum(axis=1), kind="stable")]
                    if not exact:
                        out += [(min(ids[j], own_id), max(ids[j], own_id)) for j in near[:CLOSEST].tolist()]
                        continue
                    linked: set[int] = set()
                    shingles = queries.field("shingles")[i].values.to_numpy() if len(near) else None
                    for j, root in zip(near.tolist(), roots[near].tolist(), strict=True):
                        if root in linked:
                            continue
                        common = len(np.intersect1d(members.field("shingles")[j].values.to_numpy(), shingles, assume_unique=True))
                        if 100 * common >= percent * (n[j] + own_n - common):
                            linked.add(root)
                            out.append((min(ids[j], own_id), max(ids[j], own_id)))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"set_{name}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
    return both.where(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents are linked if ``size``-word shingle sets have a Jaccard similarity
    of at least ``percent`` / 100; component_id is the smallest doc_id that can be
    reached, and kept marks the document that has it.
    """
    docs, back = numbered_ids(docs.select("doc_id", "text"))
    signed = staged(docs.mapInArrow(_signatures(size), "doc_id long, n long, k1 long, k2 long, keys array<long>, sign binary"), "signatures")
    classes = staged(signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "classes")
    first = classes.select(F.col("id").alias("doc_id"), "k1", "k2")
    heads = staged(signed.join(first, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("id"), "n", "keys", "sign"), "heads")
    # a doc_id that stands on rows with different texts heads several classes; its rows are one node
    roots = settled(lambda: _forest_components(docs, heads, size, percent), "components")
    placed = signed.drop("keys", "sign").join(classes, ["k1", "k2"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return back(placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).select("*", kept), "doc_id", "component_id")


def _forest_components(docs: DataFrame, heads: DataFrame, size: int, percent: int) -> DataFrame:
    leaves = heads.select("id", F.posexplode("keys").alias("tree", "key"))
    shared = staged(leaves.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared-keys")
    live = staged(leaves.hint("merge").join(shared, "key"), "live-leaves")
    order = F.expr(f"substring(concat(substring(sign, tree * {DEPTH} + {DEPTH} + 1), sign), 1, {ORDER})")
    ordered = live.join(heads.select("id", "sign"), "id").select("key", "id", order.alias("order"), "members")
    # a region of which all pairs are neighbours stays in one task; larger ones may be split, and what that loses is compared below
    task = F.when(F.col("members") > REACH + 1, F.col("order"))
    placed = ordered.repartitionByRange("key", task).sortWithinPartitions("key", "order", "id").select("key", "id", (F.col("members") <= REACH + 1).alias("small"))
    pairs = placed.mapInArrow(_neighbours, "a long, b long").distinct()
    side = lambda name: heads.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sign").alias(f"sign_{name}"))
    candidates = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_agreeing(percent), "a long, b long"), "candidates")
    crowd = live.where(F.col("members") > REACH + 1).select("key", "id")
    wanted = reduce(DataFrame.unionByName, (df.select(F.col(c).alias("doc_id")) for df, c in ((candidates, "a"), (candidates, "b"), (crowd, "id")))).distinct()
    sets = staged(docs.hint("merge").join(wanted, "doc_id").mapInArrow(_sets(size), "id long, shingles array<long>"), "sets")
    roots = components(staged(_verified(candidates, sets, percent), "verified"))
    closest = _links_outside(crowd, roots, heads.select("id", "n", "sign"), percent)
    if closest is None:
        return roots
    roots = _merged(roots, staged(_verified(closest, sets, percent), "verified-closest"))
    others = _links_outside(crowd, roots, heads.select("id", "n", "sign").join(sets, "id"), percent)
    return roots if others is None else _merged(roots, others)


def _with_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, a_root and b_root of links; a node without a component is its own."""
    root_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    return links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if links.isEmpty():
        return roots
    upper = components(_with_roots(links, roots).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    lower = roots.unionByName(upper.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
    step = upper.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return staged(lower.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")


def _links_outside(crowd: DataFrame, roots: DataFrame, rows: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) of ``_across`` between what is outside the largest component of a region of ``crowd`` (key, id) and the region; ``rows`` has what is known of each id."""
    if crowd.isEmpty():
        return None
    placed = staged(crowd.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "crowd")
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("share"))
    largest = shares.groupBy("key").agg(F.max(F.struct("share", "root")).alias("top"), F.sum("share").alias("members"))
    open_keys = staged(largest.where("top.share < members").select("key", F.col("top.root").alias("top")), "open-regions")
    if open_keys.isEmpty():
        return None
    # the same members meet in many trees: regions around one component are one region, compared once
    once = staged(placed.join(open_keys, "key").select(F.col("top").alias("key"), "id", "root").distinct(), "regions")
    counts = staged(once.groupBy("key").agg(F.count("*").alias("members"), F.count_if(F.col("root") != F.col("key")).alias("outside")), "region-sizes")
    region = once.join(counts, "key").join(rows, "id")
    block = lambda count: F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK)).cast("int")
    place = lambda count: F.pmod(F.xxhash64("id"), block(count)).cast("int")
    grid, row = ["key", "mine", "theirs"], F.collect_list(F.struct("root", *rows.columns))
    blocks = lambda df, name, *own: staged(df.groupBy("key", "block").agg(row.alias(name), F.first(own[0]).alias("others")), f"blocks-{name}")
    members = blocks(region.withColumn("block", place("members")), "members", block("outside"))
    outside = blocks(region.where("root <> key").withColumn("block", place("outside")), "queries", block("members"))
    span = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    left = members.select("key", F.col("block").alias("mine"), span.alias("theirs"), "members")
    right = outside.select("key", span.alias("mine"), F.col("block").alias("theirs"), "queries")
    return staged(left.join(right, grid).select("members", "queries").mapInArrow(_across(percent), "a long, b long").distinct(), "links-outside")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of ``docs`` without the near-duplicates of a smaller doc_id."""
    gone = settled(lambda: near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-duplicates")
    return docs.hint("merge").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)

"""Order-dependent operators on frames, segments and texts of one clip or page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.scalars import norm_ns, split_ranges

TOLERANCE = 0.1


def speech_regions(frames: DataFrame, frame_s: float, min_gap_s: float, min_run_s: float, threshold: float | None = None) -> DataFrame:
    """Gaps and islands: runs of speech frames (clip, frame, is_speech or score), short gaps bridged, then short runs dropped."""
    least = lambda seconds: F.greatest(F.lit(1), F.bround(F.lit(seconds / frame_s), 0).cast("bigint"))
    speech = frames.where("is_speech = 1" if threshold is None else F.col("score") >= threshold).select("clip", "frame")
    order = W.partitionBy("clip").orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(order) - 1
    starts = F.coalesce((gap > 0) & (gap >= least(min_gap_s)), F.lit(True)).cast("int")
    islands = speech.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    runs = islands.groupBy("clip", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    long = runs.where(F.col("last") - F.col("first") + 1 >= least(min_run_s))
    return long.select("clip", "first", "last", F.round(F.col("first") * frame_s, 6).alias("start_s"), F.round((F.col("last") + 1) * frame_s, 6).alias("end_s"))


def gaps(regions: DataFrame, clips: DataFrame) -> DataFrame:
    """Silence of each clip (clip, duration_s) outside its regions (clip, start_s, end_s), head and tail included."""
    inside = regions.join(clips, "clip").select("clip", "duration_s", F.greatest(F.least("start_s", "duration_s"), F.lit(0.0)).alias("s"), F.greatest(F.least("end_s", "duration_s"), F.lit(0.0)).alias("e")).where("e > s")
    tail = clips.select("clip", "duration_s", F.col("duration_s").alias("s"), F.col("duration_s").alias("e"))
    before = F.coalesce(F.max("e").over(W.partitionBy("clip").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return inside.unionByName(tail).withColumn("cursor", before).where("s > cursor").select("clip", F.col("cursor").alias("start_s"), F.col("s").alias("end_s"))


def plan_splits(clips: DataFrame, regions: DataFrame, max_seg: float, min_seg: float = 60.0, overlap: float = 2.5) -> DataFrame:
    """Spans of each clip: cut at the last silence mid-point in reach, else hard at the maximum with an overlap.

    A fold over the clip's mid-points; the number of steps is bounded by the least advance.
    """
    least = 60.0 if min_seg <= 0 else min_seg
    least = max_seg / 2 if least >= max_seg else least
    middles = gaps(regions, clips).groupBy("clip").agg(F.sort_array(F.collect_list((F.col("start_s") + F.col("end_s")) / 2)).alias("mids"))
    rows = clips.join(middles, "clip", "left").withColumn("mids", F.coalesce("mids", F.array().cast("array<double>")))
    advance = min(least, max(1.0, max_seg - overlap))
    steps = F.greatest(F.ceil(F.col("duration_s") / advance).cast("int") + 1, F.lit(1))
    span = "array<struct<start_s:double,end_s:double>>"
    start = F.struct(F.lit(0.0).alias("t"), F.array().cast(span).alias("spans"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        t, spans, duration = state["t"], state["spans"], F.col("duration_s")
        cut = F.array_max(F.filter("mids", lambda m: (m >= t + least) & (m <= t + max_seg)))
        end = F.coalesce(cut, t + max_seg)
        following = F.coalesce(cut, F.greatest(t + max_seg - overlap, t + 1))
        add = lambda to: F.concat(spans, F.array(F.struct(t.alias("start_s"), to.cast("double").alias("end_s"))))
        final = F.struct(duration.cast("double").alias("t"), add(duration).alias("spans"), F.lit(True).alias("done"))
        more = F.struct(following.cast("double").alias("t"), add(end).alias("spans"), F.lit(False).alias("done"))
        return F.when(state["done"], state).when(duration - t <= max_seg, final).otherwise(more)

    folded = F.aggregate(F.sequence(F.lit(1), steps), start, step)["spans"]
    return rows.where("duration_s > 0").select("clip", F.posexplode(folded).alias("part", "span")).select("clip", "part", "span.start_s", "span.end_s")


#: all that ``str.strip`` takes off, as a regular expression
BLANK = r"[\s\x1c-\x1f]"


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def joint(tail: Column, right: Column, probe: int = 200, min_overlap: int = 20) -> Column:
    """What follows a transcript that ends in ``tail`` when ``right`` is joined to it: right without
    all up to the end of the longest text that both share there, else a space and right.

    Only a place of the tail whose next ``min_overlap`` characters stand in the head can
    begin a match that counts. Its longest match is found by halving: if a text
    stands in the head, so do all that it begins with. Of equally long matches the one that is
    first in the tail, then in the head, is taken.
    """
    head = F.left(right, F.lit(probe))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(probe.bit_length()))))
    there = lambda at, n: F.instr(head, F.substr(tail, at, n)) > 0

    def longest(at: Column) -> Column:
        fits = lambda n: (at + n - 1 <= F.length(tail)) & there(at, n)
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(tail) - min_overlap + 1)), lambda at: (F.length(tail) >= at + min_overlap - 1) & there(at, F.lit(min_overlap)))
    best = F.array_max(F.transform(starts, lambda at: F.struct(longest(at).alias("n"), (-at).alias("before"))))
    place = F.instr(head, F.substr(tail, -best["before"], best["n"]))
    return F.when(best.isNull(), F.concat(F.lit(" "), right)).otherwise(F.substr(right, place + best["n"]))


def stitch(segments: DataFrame, by: list[str], probe: int = 200, min_overlap: int = 20) -> DataFrame:
    """The texts of each page stitched in the order of ``pos``, blank ones left out.

    A fold in the JVM over the texts of one page, whose stitched text is its output row;
    it keeps what each text adds and the last ``probe`` characters.
    """
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: stripped(x["text"])), lambda x: x != "")
    pages = segments.groupBy(*by).agg(texts.alias("texts"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("tail"))
    # the part is worked out once, then used twice: ``transform`` over one element names it

    def add(state: Column, text: Column) -> Column:
        part = F.when(F.size(state["parts"]) == 0, text).otherwise(joint(state["tail"], text, probe, min_overlap))
        grown = lambda p: F.struct(F.array_append(state["parts"], p).alias("parts"), F.right(F.concat(state["tail"], p), F.lit(probe)).alias("tail"))
        return F.element_at(F.transform(F.array(part), grown), 1)

    return pages.select(*by, F.aggregate("texts", start, add, lambda state: F.array_join(state["parts"], "")).alias("text"))


def refine_round(outcomes: DataFrame, split_s: float = 30.0, min_s: float = 10.0, empty_s: float = 5.0) -> DataFrame:
    """One round over segments (key columns, start_s, end_s, outcome): ``action`` and, for a split, one row for each part.

    Actions: keep, skip, skip_error, split and fail. Called again on the parts
    until nothing is split.
    """
    length = F.col("end_s") - F.col("start_s")
    refused = F.col("outcome").isin("high_risk", "truncated")
    action = (
        F.when(F.col("outcome") == "ok", "keep").when((F.col("outcome") == "empty") & (length <= empty_s), "skip")
        .when(refused & (length > min_s), "split").when(refused, "skip_error").otherwise("fail")
    )
    step = F.least(F.greatest(F.lit(split_s), F.lit(min_s)), F.greatest(F.lit(min_s), length / 2))
    whole = F.array(F.struct(F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")))
    rows = outcomes.withColumn("action", action).withColumn("parts", F.when(F.col("action") == "split", split_ranges(F.col("start_s"), F.col("end_s"), step)).otherwise(whole))
    return rows.drop("start_s", "end_s").select("*", F.posexplode("parts").alias("part", "range")).select("*", "range.start_s", "range.end_s").drop("parts", "range")


def cache_merge(cached: DataFrame, new: DataFrame, by: list[str], tol: float = TOLERANCE) -> DataFrame:
    """Cached segments after new ones (in order of ``seq``): each replaces all that are within the tolerance in its name-space.

    A new row removes what it is near to even if it is removed itself later, so a
    row stays unless a new row with a larger ``seq`` is near to it: an anti join on
    buckets of starts. Rows: start_s, end_s, ns, text.
    """
    columns = [*by, "start_s", "end_s", "ns", "text"]
    named = lambda df, seq: df.select(*by, "start_s", "end_s", norm_ns(F.col("ns")).alias("ns"), "text", seq.cast("bigint").alias("seq"))
    add = named(new, F.col("seq"))
    every = named(cached, F.lit(None)).unionByName(add).withColumn("bucket", F.floor(F.col("start_s") / (2 * tol)))
    bucket = F.floor(F.col("start_s") / (2 * tol))
    later = add.select(*by, "ns", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"), F.col("seq").alias("l_seq"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    same = reduce(lambda a, b: a & b, [every[c].eqNullSafe(later[c]) for c in (*by, "ns", "bucket")])
    near = (F.abs(F.col("l_start") - F.col("start_s")) <= tol) & (F.abs(F.col("l_end") - F.col("end_s")) <= tol)
    return every.join(later, same & near & (every["seq"].isNull() | (F.col("l_seq") > every["seq"])), "left_anti").select(*columns)


def cache_evict(cache: DataFrame, results: DataFrame, version: int = 1) -> DataFrame:
    """Cache rows of this version whose items have not succeeded."""
    done = results.where("status = 'success'").select("uid", "item_id")
    return cache.where(F.col("version") == version).join(done, ["uid", "item_id"], "left_anti")


def parse_responses(responses: DataFrame, refusal: str) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) of raw recogniser responses in ``payload``."""
    value = jsonx.parsed(F.col("payload"))
    choice = F.try_element_at(jsonx.at(value, "choices", "array<variant>"), F.lit(1))
    content = jsonx.at(choice, "message.content")
    text = F.trim(jsonx.at(content, "", "string"))
    said = (
        F.when(content.isNull(), "ASRAPIError").when(jsonx.at(choice, "finish_reason", "string") == "length", "LengthTruncatedError")
        .when(jsonx.kind(content) != "string", "ASRAPIError").when(text == "", "EmptyTranscriptError").when(F.lower(text).contains(refusal), "ASRAPIError")
    )
    model = F.coalesce(jsonx.at(value, "model", "string"), F.lit("mimo-v2.5-asr"))
    rows = responses.withColumn("error_class", said).withColumn("text", text).withColumn("seconds", jsonx.at(value, "usage.seconds", "double")).withColumn("audio_tokens", jsonx.at(value, "usage.prompt_tokens_details.audio_tokens", "bigint")).withColumn("model", model)
    return rows.where("error_class is null").drop("payload", "error_class"), rows.where("error_class is not null").drop("text", "seconds", "audio_tokens", "model")

"""Text, time, classification and segment functions; all return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values
SECRET_WORDS = ("sessdata", "bili_jct", "buvid3", "api_key", "apikey", "authorization", "cookie")
UNAVAILABLE_CODES = (-400, 22115, 22118, 53013, 53016, 88214)
REFUSAL = "the request was rejected because it was considered high risk"
PERMANENT_ERRORS = ("AuthError", "InvalidRequestError")
FETCH_ERRORS = ("FetchingError", "AuthError", "RequestError", "InvalidRequestError", "Http412Error", "Http5xxError", "ResourceUnavailableError")
DAY_MS = 86_400_000


def redact(text: Column) -> Column:
    """The whole text gives way if it has a secret word in any case."""
    return F.when(F.lower(text).rlike("|".join(SECRET_WORDS)), F.lit("[REDACTED secret]")).otherwise(text)


def absolute_url(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https:"), url))


def norm_ns(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def source_label(model: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    return F.when(name.startswith("mimo"), "MIMO-ASR").when(name.startswith("mock"), "mock").when(name != "", model).otherwise("ASR")


def classify_error(error_type: Column, fetch: bool = True) -> Column:
    """unavailable, permanent or retryable; a type that is no fetch error is permanent unless ``fetch``."""
    known = F.when(error_type == "ResourceUnavailableError", "unavailable").when(error_type.isin(*PERMANENT_ERRORS), "permanent")
    return known.otherwise("retryable") if fetch else known.when(error_type.isin(*FETCH_ERRORS), "retryable").otherwise("permanent")


def classify_response(code: Column, status: Column, timed_out: Column) -> Column:
    """Error type of a business code, or of an HTTP status where there is no code."""
    by_code = F.when(code == 412, "Http412Error").when(code.isin(*UNAVAILABLE_CODES), "ResourceUnavailableError").otherwise("RequestError")
    by_status = F.when(status == 404, "ResourceUnavailableError").when((status >= 400) & (status < 500), "RequestError").otherwise("Http5xxError")
    return F.when(timed_out, "Http5xxError").when(code.isNotNull(), by_code).otherwise(by_status)


def failure_category(error_type: Column, message: Column) -> Column:
    text, api = F.lower(F.coalesce(message, F.lit(""))), error_type == "ASRAPIError"
    limited = text.contains("429") | text.contains("too many requests") | text.contains("rate limit") | text.contains("limitation")
    return (
        F.when(error_type == "LengthTruncatedError", "max_tokens").when(error_type == "ASRConnectionError", "network")
        .when(api & limited, "rate_limit").when(api & text.contains("high risk"), "high_risk")
        .when((error_type == "EmptyTranscriptError") | api & text.contains("empty transcription text"), "empty")
        .when(api, "parse_error").otherwise("unknown")
    )


def segment_seconds(duration: Column, budget: Column | int, rate: float = 6.5, cap: int | None = None) -> Column:
    """Segment length that fits the token budget; null if the whole clip fits."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fitting = F.when(F.ceil(duration * rate) > budget, F.greatest(F.lit(60), F.floor(budget / rate)).cast("bigint"))
    length = fitting if cap is None else F.least(F.coalesce(fitting, F.lit(cap).cast("bigint")), F.lit(cap).cast("bigint"))
    return F.when(duration > length, length)


def fixed_ranges(duration: Column, seconds: Column) -> Column:
    """Array of (start_s, end_s) that cover the duration in steps, the last one shorter."""
    n = F.ceil(duration / seconds).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * seconds).cast("double").alias("start_s"), F.least((i + 1) * seconds, duration).cast("double").alias("end_s")))
    return F.when((duration > 0) & (seconds > 0), ranges).otherwise(F.array().cast("array<struct<start_s:double,end_s:double>>"))


def split_ranges(start: Column, end: Column, step: Column) -> Column:
    """Array of (start_s, end_s) of a segment cut every ``step`` seconds."""
    return F.transform(fixed_ranges(end - start, step), lambda r: F.struct((start + r.start_s).alias("start_s"), F.least(start + r.end_s, end).cast("double").alias("end_s")))


def next_step(length: Column, step: Column | float, least: Column | float) -> Column:
    """The step of a further split: not under the least, not over half of the segment."""
    step, least = (x if isinstance(x, Column) else F.lit(float(x)) for x in (step, least))
    return F.least(F.greatest(step, least), F.greatest(least, length / 2))


def doubling(start: Column, cap: Column) -> Column:
    """start, 2 start, 4 start, ... below the cap, then the cap; nothing if start or cap is not positive."""
    none = F.array().cast("array<bigint>")
    n = F.when((start > 0) & (start < cap), F.ceil(F.log2(F.try_divide(cap, start)))).otherwise(0).cast("int")
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (start * F.pow(F.lit(2), i)).cast("bigint"))).otherwise(none)
    return F.when((start > 0) & (cap > 0), F.concat(steps, F.array(cap.cast("bigint")))).otherwise(none)


def parse_delays(text: Column, default: tuple[int, ...] = (30, 60, 120)) -> Column:
    """Comma list of whole seconds, sorted; the default if it is empty or any entry is no whole number."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    values = F.transform(parts, lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint")))
    fine = (F.size(parts) > 0) & ~F.exists(values, lambda x: x.isNull())
    return F.when(fine, F.array_sort(values)).otherwise(F.array(*(F.lit(d).cast("bigint") for d in default)))


def is_stale(fetched_ms: Column, now_ms: Column | int, days: int = 7) -> Column:
    now_ms = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return now_ms - fetched_ms >= days * DAY_MS


def safe_int(text: Column, default: int | None = None) -> Column:
    value = F.when(F.trim(text.cast("string")) != "", text.cast("string").try_cast("bigint"))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def safe_double(text: Column, default: float | None = None) -> Column:
    value = F.when(F.trim(text.cast("string")) != "", text.cast("string").try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def request_key(params: Column) -> Column:
    """Parameters of a map as sorted ``key=value`` text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "&")


def is_failure(status: Column) -> Column:
    return (status == "PARTIAL") | status.startswith("FAILED") | (status == "ERROR")


def is_attention(level: Column, event: Column) -> Column:
    """Levels as written; names in any case."""
    named = event.ilike("%.retry_scheduled") | event.ilike("%.rate_limited") | event.ilike("%.high_risk_%") | event.ilike("%.failed")
    return level.isin("WARNING", "ERROR", "CRITICAL") | named


DETAIL_KEYS = ("retry", "delay_s", "pieces", "missing", "failed")


def event_detail(data_json: Column) -> Column:
    """error or message if there is one, else ``k=v`` of the known keys."""
    get = lambda k: F.get_json_object(data_json, f"$.{k}")
    said = [F.when(get(k) != "", get(k)) for k in ("error", "message")]
    return F.coalesce(*said, F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), get(k)) for k in DETAIL_KEYS)))

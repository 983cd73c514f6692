"""Column functions shared by the log and document queries. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode blanks and the four separator controls, as the document half treats them.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def extract(c: Column, pattern: str) -> Column:
    """Group 1, or null where nothing (or an empty group) matches."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def key_value(c: Column, key: str) -> Column:
    """The value of ``key=value`` in a line of text."""
    return extract(c, f"{key}=([^ ]+)")


def key_number(c: Column, key: str) -> Column:
    return extract(c, f"{key}=([0-9]+)").try_cast("bigint")


def latency_ms(c: Column) -> Column:
    return extract(c.cast("string"), "([0-9.]+)").try_cast("double") * 1000


#: Latencies below this many milliseconds have a slot for each; above, a thousandth of a latency shares one.
EXACT_MS, SLOT_BITS = 1 << 20, 10


def latency_slot(ms: Column) -> Column:
    """The slot of a latency, as its least whole milliseconds: of every thousand above ``EXACT_MS`` at most one is told
    apart from the next. There are ``EXACT_MS`` and some 17,000 more slots, so whatever is kept by slot is bounded."""
    whole = F.round(F.when(ms > float(1 << 53), float(1 << 53)).otherwise(ms)).cast("bigint")
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(whole)) - (SLOT_BITS + 1))
    return F.when(whole < EXACT_MS, whole).otherwise(whole - whole % width)


def path_of(url: Column) -> Column:
    return F.coalesce(extract(url, r"https?://[^/]+(/[^? ]*)"), F.lit("/unknown"))


def device_class(agent: Column) -> Column:
    return F.when(F.lower(agent).rlike("(iphone|android|mobile|ipad)"), "mobile").when(agent.isNull() | (agent == ""), "unknown").otherwise("desktop")


def is_core(path: Column) -> Column:
    return path.rlike(r"^/v2/(ask|conversations)(/|\z)")


#: What names an error in a log line, and what marks a line as one.
ERROR_NAME = r"([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception|Failed|Timeout|Conflict))"
ERROR_EVENT = r"([a-z_]+(?:_failed|_error|_timeout|_conflict))"
ERROR_WORDS = r"(error|exception|failed|timeout|traceback|conflict)"


def error_class(line: Column) -> Column:
    return F.coalesce(extract(line, ERROR_NAME), extract(line, ERROR_EVENT), F.lit("unknown"))


def is_error_line(line: Column) -> Column:
    return F.lower(line).rlike(ERROR_WORDS)


def boolean(text: Column) -> Column:
    """Only the words true and false."""
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def trimmed(c: Column) -> Column:
    """Text without blanks at its ends; null becomes empty."""
    return F.coalesce(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), F.lit(""))


def json_scalar(payload: Column, key: str) -> Column:
    """A scalar member of a variant as text; objects, arrays and null give null."""
    member = F.try_variant_get(payload, f"$.{key}", "variant")
    return F.when(~F.schema_of_variant(member).rlike("^(OBJECT|ARRAY)"), member.cast("string"))


def iso_time(text: Column) -> Column:
    """Instant of an ISO text; null if it is none. Text without a zone is UTC."""
    t = F.regexp_replace(trimmed(text), r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))


def short_reason(text: Column) -> Column:
    """Blanks collapsed, over 120 characters cut to 117 and dots, empty becomes unknown."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))
    cut = F.concat(F.rtrim(F.substring(t, 1, 117)), F.lit("..."))
    return F.when(t == "", "unknown").when(F.length(t) > 120, cut).otherwise(t)


#: Modes of a conversation.
MODES = ("internal", "websearch", "deepthinking", "standard")


def mode_class(c: Column) -> Column:
    """A known mode, blanks and case ignored, or unknown."""
    t = F.lower(trimmed(c))
    return F.when(t.isin(*MODES), t).otherwise("unknown")


def local(ts: Column, tz: str) -> Column:
    """Wall-clock time (without zone) of an instant; the session runs in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_bucket(ts: Column, tz: str, minutes: int) -> Column:
    """Start of the local bucket, by wall clock, so that clock changes merge or skip hours as clocks do."""
    t = local(ts, tz)
    over = F.minute(t) % minutes if minutes < 60 else F.minute(t)
    return (t - F.make_dt_interval(F.lit(0), F.lit(0), over, F.date_part(F.lit("SECONDS"), t).cast("decimal(18,6)"))).cast("timestamp_ntz")


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)

"""Traffic, latency and error queries over request and text logs.

Each builder is a pure function of sources and a window; filters on type, service and time sit on the scan so
they reach it as pushed filters, and grids are tiny and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.window import Window
from ..sources.tables import Sources, of_days

SERVICE, RESOURCE = "source-svc", "cloud_run_revision"
DEVICES = ("desktop", "mobile", "unknown")
TOP = 30
#: The two answer endpoints of each kind.
FIRST_ANSWER = ("/v2/ask", "/v2/ask/stream")
ENHANCE = ("/v2/ask/enhance_full", "/v2/ask/enhance_full/stream")


def scan(df: DataFrame, w: Window | None, service: str = SERVICE) -> DataFrame:
    df = df.where((F.col("resource.type") == RESOURCE) & (F.col("resource.labels.service_name") == service))
    return df if w is None else of_days(df, w.start, w.end).where((F.col("timestamp") >= F.lit(w.start)) & (F.col("timestamp") < F.lit(w.end)))


def requests(src: Sources, w: Window | None, service: str = SERVICE) -> DataFrame:
    """Normalised request log."""
    h = "httpRequest."
    rows = scan(src.requests, w, service).select("timestamp", F.col(h + "status").try_cast("bigint").alias("status"), S.latency_ms(F.col(h + "latency")).alias("latency_ms"), S.path_of(F.col(h + "requestUrl")).alias("path"), S.device_class(F.col(h + "userAgent")).alias("device_class"))
    return rows.withColumns({"latency_slot": S.latency_slot(F.col("latency_ms")), "is_core": S.is_core(F.col("path")), "is_5xx": F.col("status") >= 500})


def text_lines(src: Sources, w: Window | None, prefix: str, service: str = SERVICE) -> DataFrame:
    return scan(src.stdout, w, service).where(F.col("textPayload").startswith(prefix)).select("timestamp", F.col("textPayload").alias("line"))


def p95() -> F.Column:
    """The discrete 95th percentile of the latencies' slots, nulls ignored: exact in whole milliseconds. Its state is
    one count for each slot that occurs, however many latencies there are, and counts of several tasks add up."""
    return F.expr("percentile_disc(0.95) within group (order by latency_slot)")


def counters() -> list[F.Column]:
    return [F.count("*").alias("request_count"), F.count_if("is_core").alias("core_request_count"), F.count_if(~F.col("is_core")).alias("system_request_count"), F.count_if("is_5xx").alias("error_5xx_count")]


def grid(src: Sources, w: Window) -> DataFrame:
    """Every local bucket that the window touches."""
    spark = src.requests.sparkSession
    first, last = S.local(F.lit(w.start), w.tz), S.local(F.lit(w.end) - F.expr("interval 1 second"), w.tz)
    if w.by_day:
        a, z, step = F.to_date(first), F.to_date(last), F.expr("interval 1 day")
    else:
        a, z, step = S.local_bucket(F.lit(w.start), w.tz, w.bucket_minutes), last, F.expr(f"interval {w.bucket_minutes} minute")
    return spark.range(1).select(F.explode(F.when(a <= z, F.sequence(a, z, step))).alias("bucket"))


def bucket(w: Window) -> F.Column:
    return F.to_date(S.local(F.col("timestamp"), w.tz)) if w.by_day else S.local_bucket(F.col("timestamp"), w.tz, w.bucket_minutes)


def labels(w: Window) -> list[F.Column]:
    b = F.col("bucket")
    if w.by_day:
        return [F.date_format(b, "yyyy-MM-dd").alias("bucket_key"), F.date_format(b, "MM-dd").alias("bucket_label")]
    return [F.date_format(b, "yyyy-MM-dd HH:mm").alias("bucket_key"), F.date_format(b, "HH:mm" if w.seconds <= 86400 else "MM-dd HH:mm").alias("bucket_label")]


def in_order(df: DataFrame, *names: str) -> DataFrame:
    """A series in order; it is no longer than its window's grid, so it lies in one partition."""
    return df.repartition(1).sortWithinPartitions(*names)


def by_device(src: Sources, w: Window) -> DataFrame:
    devices = src.requests.sparkSession.createDataFrame([(d,) for d in DEVICES], "device_class string")
    return grid(src, w).crossJoin(F.broadcast(devices))


def zero(*names: str) -> list[F.Column]:
    return [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]


def overview(src: Sources, w: Window) -> DataFrame:
    ok = F.col("status") < 500
    mean = lambda paths: F.round(F.avg(F.when(ok & F.col("path").isin(*paths), F.col("latency_ms"))), 6)
    r = requests(src, w).agg(*counters(), p95().alias("request_p95_latency_ms"), mean(FIRST_ANSWER).alias("first_answer_avg_ms"), mean(ENHANCE).alias("enhance_answer_avg_ms"))
    r = r.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count")))
    return r.crossJoin(text_totals(src, w))


def text_totals(src: Sources, w: Window) -> DataFrame:
    """One row of suggestion and restore counts, from one pass over the text log."""
    line = F.col("line")
    rows = scan(src.stdout, w).select(F.col("textPayload").alias("line")).where(line.startswith("query_suggest_result ") | (line.startswith("chat_sync_telemetry ") & line.contains("event=restore_")))
    said = line.startswith("query_suggest_result ")
    rows = rows.select(said.alias("said"), F.when(said, S.key_value(line, "stage")).alias("stage"), F.when(said, S.key_number(line, "latency_ms")).alias("l"), F.when(said, S.key_number(line, "suggestion_count")).alias("n"), F.when(~said, S.key_value(line, "event")).alias("event"))
    t = rows.agg(
        F.count_if("said").alias("qs_total"), F.count_if(F.col("stage") == "stable").alias("qs_stable_count"), F.count_if(F.col("stage") == "degraded").alias("qs_degraded_count"), F.round(F.avg("l"), 6).alias("qs_avg_latency_ms"), F.round(F.avg("n"), 6).alias("qs_avg_suggestion_count"),
        F.count_if(~F.col("said")).alias("restore_total"), F.count_if(F.col("event").isin("restore_success", "restore_empty")).alias("restore_success_count"),
    )
    t = t.withColumns({"qs_stable_rate": S.rate(F.col("qs_stable_count"), F.col("qs_total")), "restore_success_rate": S.rate(F.col("restore_success_count"), F.col("restore_total"))})
    return t.select("qs_total", "qs_stable_count", "qs_degraded_count", "qs_avg_latency_ms", "qs_avg_suggestion_count", "qs_stable_rate", "restore_total", "restore_success_count", "restore_success_rate")


def usage(src: Sources, w: Window) -> DataFrame:
    """Zero-filled series by local bucket and device class."""
    got = requests(src, w).groupBy(bucket(w).alias("bucket"), "device_class").agg(*counters(), p95().alias("p95_latency_ms"))
    got = got.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count")))
    rows = by_device(src, w).join(got, ["bucket", "device_class"], "left")
    rows = rows.select(*labels(w), "device_class", *zero("request_count", "core_request_count", "system_request_count", "error_5xx_count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("error_5xx_rate", "p95_latency_ms")])
    return in_order(rows, "bucket_key", "device_class")


def error_trend(src: Sources, w: Window) -> DataFrame:
    got = requests(src, w).where("is_5xx").groupBy(bucket(w).alias("bucket")).agg(F.count("*").alias("error_5xx_count"))
    return in_order(grid(src, w).join(got, "bucket", "left").select(*labels(w), *zero("error_5xx_count")), "bucket_key")


def top_endpoints(src: Sources, w: Window, n: int = TOP) -> DataFrame:
    got = requests(src, w).where("is_5xx").groupBy(F.col("path").alias("endpoint")).agg(F.count("*").alias("error_5xx_count"))
    return got.orderBy(F.desc("error_5xx_count"), "endpoint").limit(n)


def top_errors(src: Sources, w: Window, n: int = TOP) -> DataFrame:
    lines = scan(src.stderr, w).select(F.col("textPayload").alias("line")).unionByName(scan(src.stdout, w).select(F.col("textPayload").alias("line")))
    got = lines.where(S.is_error_line(F.col("line"))).groupBy(S.error_class(F.col("line")).alias("error_type")).agg(F.count("*").alias("count"))
    return got.orderBy(F.desc("count"), "error_type").limit(n)


def devices(src: Sources, w: Window) -> DataFrame:
    got = requests(src, w).groupBy("device_class").agg(F.count("*").alias("request_count"), F.count_if("is_5xx").alias("error_5xx_count"), p95().alias("p95_latency_ms"))
    return got.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count"))).orderBy(F.desc("request_count"), "device_class")


def suggest_stages(src: Sources, w: Window) -> DataFrame:
    line = F.col("line")
    got = text_lines(src, w, "query_suggest_result ").groupBy(S.key_value(line, "stage").alias("stage"))
    return got.agg(F.count("*").alias("count"), F.round(F.avg(S.key_number(line, "latency_ms")), 6).alias("avg_latency_ms"), F.round(F.avg(S.key_number(line, "suggestion_count")), 6).alias("avg_suggestion_count")).orderBy(F.desc("count"), "stage")


def suggest_fallbacks(src: Sources, w: Window) -> DataFrame:
    line = F.col("line")
    got = text_lines(src, w, "query_suggest_refine_degraded ").groupBy(S.key_value(line, "fallback").alias("fallback_source"), S.key_value(line, "reason").alias("reason"))
    return got.agg(F.count("*").alias("count")).orderBy(F.desc("count"), "fallback_source", "reason")


def _json(src: Sources, w: Window, name: str) -> DataFrame:
    prefix = f"{name}_json="
    p = F.try_parse_json(S.extract(F.col("line"), prefix + r"(.*)\z"))
    # as a generated column, since filters on members would else be pushed below with a copy of the parsing each
    return text_lines(src, w, prefix).select("timestamp", F.explode(F.array(p)).alias("p")).where("p is not null")


def followups(src: Sources, w: Window) -> DataFrame:
    """Follow-up opens by event and user."""
    p = F.col("p")
    rows = _json(src, w, "followup_open_result").select(F.lower(F.coalesce(F.nullif(S.json_scalar(p, "event"), F.lit("")), F.lit("unknown"))).alias("event_name"), F.coalesce(F.nullif(S.json_scalar(p, "user_id"), F.lit("")), F.lit("unknown")).alias("user_id"), F.lower(F.coalesce(S.json_scalar(p, "user_email"), F.lit(""))).alias("user_email"))
    return rows.groupBy("event_name", "user_id", "user_email").agg(F.count("*").alias("event_count"))


def followup_users(src: Sources, w: Window) -> DataFrame:
    n = lambda e: F.coalesce(F.sum(F.when(F.col("event_name") == e, F.col("event_count"))), F.lit(0))
    got = followups(src, w).groupBy("user_id", "user_email").agg(n("recognized").alias("recognized_count"), n("success").alias("success_count"))
    return got.withColumn("success_rate", S.rate(F.col("success_count"), F.col("recognized_count")))


def user_requests(src: Sources, w: Window) -> DataFrame:
    """Per-user request events, normalised."""
    p = F.col("p")
    return _json(src, w, "request_user_metric").select("timestamp", F.nullif(S.json_scalar(p, "user_id"), F.lit("")).alias("user_id"), F.lower(F.coalesce(S.json_scalar(p, "user_email"), F.lit(""))).alias("user_email"), F.lower(F.coalesce(F.nullif(S.json_scalar(p, "device_class"), F.lit("")), F.lit("unknown"))).alias("device_class"), F.coalesce(S.boolean(S.json_scalar(p, "is_core")), F.lit(False)).alias("is_core"))


def request_users(src: Sources, w: Window) -> DataFrame:
    got = user_requests(src, w).groupBy(F.coalesce("user_id", F.lit("unknown")).alias("user_id"), "user_email")
    return got.agg(F.count("*").alias("request_count"), F.count_if("is_core").alias("core_request_count"), F.count_if(~F.col("is_core")).alias("system_request_count"), *[F.count_if(F.col("device_class") == d).alias(f"{d}_request_count") for d in DEVICES])


def user_facts(src: Sources, w: Window) -> DataFrame:
    """Requests of users (kind "asked", named by device) and follow-up opens ("opened", by event), a row for each line, from
    one pass over the text log."""
    p, asked = F.col("p"), F.col("asked")
    line = F.col("textPayload")
    rows = scan(src.stdout, w).where(line.startswith("request_user_metric_json=") | line.startswith("followup_open_result_json="))
    parsed = F.try_parse_json(S.extract(line, r"^(?:request_user_metric|followup_open_result)_json=(.*)\z"))
    rows = rows.select(line.startswith("request_user_metric_json=").alias("asked"), F.explode(F.array(parsed)).alias("p")).where("p is not null")
    text = lambda k: F.nullif(S.json_scalar(p, k), F.lit(""))
    name = F.lower(F.coalesce(F.when(asked, text("device_class")).otherwise(text("event")), F.lit("unknown")))
    return rows.select(F.when(asked, "asked").otherwise("opened").alias("kind"), name.alias("name"), text("user_id").alias("user_id"), F.lower(F.coalesce(S.json_scalar(p, "user_email"), F.lit(""))).alias("user_email"), (asked & F.coalesce(S.boolean(S.json_scalar(p, "is_core")), F.lit(False))).alias("is_core"), F.lit(1).cast("bigint").alias("n"))


def user_series(src: Sources, w: Window, user_key: str) -> DataFrame:
    """Zero-filled series of one user, by id or e-mail."""
    key = user_key.strip().lower()
    got = user_requests(src, w).where((F.lower("user_id") == key) | (F.col("user_email") == key)) if key else user_requests(src, w).where("false")
    got = got.groupBy(bucket(w).alias("bucket"), "device_class").agg(F.count("*").alias("request_count"), F.count_if("is_core").alias("core_request_count"))
    got = got.withColumn("system_request_count", F.greatest(F.col("request_count") - F.col("core_request_count"), F.lit(0)))
    rows = by_device(src, w).join(got, ["bucket", "device_class"], "left").select(*labels(w), "device_class", *zero("request_count", "core_request_count", "system_request_count"))
    return in_order(rows, "bucket_key", "device_class")


def counter_rows(src: Sources) -> DataFrame:
    """One row for each log entry that a counter counts: (timestamp, metric)."""
    line = F.col("textPayload")
    req = src.requests.where((F.col("resource.labels.service_name") == SERVICE) & (F.col("httpRequest.status") >= 500)).select("timestamp", F.lit("error_5xx").alias("metric"))
    hits = F.array_compact(F.array(F.when(line.startswith("query_suggest_result "), "qs_total"), F.when(line.rlike("^query_suggest_result .* stage=degraded "), "qs_degraded"), F.when(line.rlike("^chat_sync_telemetry .*event=restore_"), "restore_total"), F.when(line.rlike("^chat_sync_telemetry .*event=restore_failed"), "restore_failed")))
    out = src.stdout.where(F.col("resource.labels.service_name") == SERVICE).select("timestamp", F.explode(hits).alias("metric"))
    return req.unionByName(out)


def log_counters(src: Sources, w: Window) -> DataFrame:
    src = Sources(requests=of_days(src.requests, w.start, w.end), stdout=of_days(src.stdout, w.start, w.end))
    rows = counter_rows(src).where((F.col("timestamp") >= F.lit(w.start)) & (F.col("timestamp") < F.lit(w.end)))
    return rows.groupBy("metric").agg(F.count("*").alias("count"))


#: Alert name, counter, threshold, window in seconds.
ALERTS = {"5xx": ("error_5xx", 3, 600), "suggest_degraded": ("qs_degraded", 15, 1800), "restore_failed": ("restore_failed", 3, 1800)}


def alert(rows: DataFrame, name: str) -> DataFrame:
    """Aligned windows in which the counter reaches its threshold; for batch rows and streams alike."""
    metric, least, seconds = ALERTS[name]
    got = rows.where(F.col("metric") == metric).groupBy(F.window("timestamp", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("count"))
    return got.where(F.col("count") >= least).select(F.lit(name).alias("alert"), F.unix_timestamp("w.start").alias("window_start"), "count")

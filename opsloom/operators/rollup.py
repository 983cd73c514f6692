"""A time rollup of the logs, and the log questions answered from it.

Two additive tables, kept by date: requests by five minutes, device, status and path, with counts of latencies by slot
(``scalars.latency_slot``); and log lines by five minutes, kind and what the questions ask of that kind. Each log is
read once to build them, rows are counted inside tasks before they move, and all measures add up, so the tables of
several batches are simply read together. A path has a row of its own where a question asks for it (errors and the
answer endpoints); all others share one, so the table does not grow with the number of distinct addresses.

``Rollup`` answers what the functions of ``logs`` answer, with the same names, arguments and rows. Whole steps of five
minutes inside a window come from the rollup, pruned by date; what a window cuts off a step at its ends is counted
from the logs. Local time has to differ from UTC by whole steps, as in every zone now in use. Entries without a time
are in no window and in no rollup. Quantiles are those of slots, so they merge without loss over any set of steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.window import Window
from ..sources.tables import Sources, of_days, stored
from . import logs

STEP = timedelta(minutes=5)
#: Files of a batch for each day at most; a day's counts are dealt to them by step.
FILES = 8
REQUEST_KEYS = ("date", "bucket", "device_class", "is_core", "status", "path")
LINE_KEYS = ("date", "bucket", "kind", "name", "detail", "user_id", "user_email", "is_core")
LINE_SUMS = ("n", "a_n", "a_sum", "b_n", "b_sum")
OVERVIEW = (
    "request_count", "core_request_count", "system_request_count", "error_5xx_count", "request_p95_latency_ms", "first_answer_avg_ms", "enhance_answer_avg_ms", "error_5xx_rate",
    "qs_total", "qs_stable_count", "qs_degraded_count", "qs_avg_latency_ms", "qs_avg_suggestion_count", "qs_stable_rate", "restore_total", "restore_success_count", "restore_success_rate",
)
SCHEMAS = {
    "requests": "date date, bucket timestamp, device_class string, is_core boolean, status bigint, path string, n bigint, latency_n bigint, latency_sum double, slots array<struct<slot:bigint,n:bigint>>",
    "lines": "date date, bucket timestamp, kind string, name string, detail string, user_id string, user_email string, is_core boolean, n bigint, a_n bigint, a_sum bigint, b_n bigint, b_sum bigint",
}


def _step() -> Column:
    seconds = int(STEP.total_seconds())
    return F.timestamp_seconds(F.unix_seconds("timestamp") - F.pmod(F.unix_seconds("timestamp"), F.lit(seconds)))


def _stepped(rows: DataFrame) -> DataFrame:
    return rows.where("timestamp is not null").withColumn("bucket", _step()).withColumn("date", F.to_date("bucket"))


def request_counts(requests: DataFrame) -> DataFrame:
    """The rollup of normalised requests (see ``logs.requests``)."""
    told = F.col("is_5xx") | F.col("path").isin(*logs.FIRST_ANSWER, *logs.ENHANCE)
    rows = _stepped(requests).withColumns({"path": F.when(told, F.col("path")), "slot": F.col("latency_slot")})
    rows = rows.groupBy(*REQUEST_KEYS, "slot").agg(F.count("*").alias("n"), F.count("latency_ms").alias("latency_n"), F.sum("latency_ms").alias("latency_sum"))
    slots = F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n"))))
    return rows.groupBy(*REQUEST_KEYS).agg(F.sum("n").alias("n"), F.sum("latency_n").alias("latency_n"), F.sum("latency_sum").alias("latency_sum"), slots.alias("slots"))


def _facts() -> Column:
    """What a line of the first log, with its parsed JSON ``p``, says, as an array: a line may be of several kinds."""
    line, p, none = F.col("line"), F.col("p"), F.lit(None)

    def fact(kind: str, name: Column, **more: Column) -> Column:
        kinds = {"detail": "string", "user_id": "string", "user_email": "string", "is_core": "boolean", "a": "bigint", "b": "bigint"}
        return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), *[more.get(k, none).cast(t).alias(k) for k, t in kinds.items()])

    text = lambda k: F.nullif(S.json_scalar(p, k), F.lit(""))
    mail = F.lower(F.coalesce(S.json_scalar(p, "user_email"), F.lit("")))
    return F.array_compact(
        F.array(
            F.when(line.startswith("query_suggest_result "), fact("suggested", S.key_value(line, "stage"), a=S.key_number(line, "latency_ms"), b=S.key_number(line, "suggestion_count"))),
            F.when(line.startswith("query_suggest_refine_degraded "), fact("fallback", S.key_value(line, "fallback"), detail=S.key_value(line, "reason"))),
            F.when(line.startswith("chat_sync_telemetry ") & line.contains("event=restore_"), fact("restored", S.key_value(line, "event"))),
            F.when(line.startswith("followup_open_result_json=") & p.isNotNull(), fact("opened", F.lower(F.coalesce(text("event"), F.lit("unknown"))), user_id=F.coalesce(text("user_id"), F.lit("unknown")), user_email=mail)),
            F.when(line.startswith("request_user_metric_json=") & p.isNotNull(), fact("asked", F.lower(F.coalesce(text("device_class"), F.lit("unknown"))), user_id=text("user_id"), user_email=mail, is_core=F.coalesce(S.boolean(S.json_scalar(p, "is_core")), F.lit(False)))),
            F.when(S.is_error_line(line), fact("error", S.error_class(line))),
        )
    )


def line_counts(stdout: DataFrame, stderr: DataFrame) -> DataFrame:
    """The rollup of the lines of both text logs; of the second only errors count."""
    error = F.col("line")
    p = F.try_parse_json(S.extract(F.col("line"), r"^(?:followup_open_result|request_user_metric)_json=(.*)\z"))
    # as a generated column, or each use of its members would parse again
    out = stdout.select("timestamp", "line", F.explode(F.array(p)).alias("p")).select("timestamp", F.explode(_facts()).alias("f")).select("timestamp", "f.*")
    err = stderr.where(S.is_error_line(error)).select("timestamp", F.lit("error").alias("kind"), S.error_class(error).alias("name"))
    rows = _stepped(out.unionByName(err, allowMissingColumns=True)).groupBy(*LINE_KEYS)
    return rows.agg(F.count("*").alias("n"), F.count("a").alias("a_n"), F.sum("a").alias("a_sum"), F.count("b").alias("b_n"), F.sum("b").alias("b_sum"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("timestamp", F.col("textPayload").alias("line"))


def counted(src: Sources, spans: list[tuple[datetime, datetime]] | None = None) -> dict[str, DataFrame]:
    """Both tables from the logs, of some spans of time or of all."""

    def at(df: DataFrame) -> DataFrame:
        hit = F.lit(False)
        for a, z in spans or ():
            hit = hit | ((F.col("timestamp") >= F.lit(a)) & (F.col("timestamp") < F.lit(z)))
        return df if spans is None else df.where(hit)

    def days(df: DataFrame) -> DataFrame:
        return of_days(df, min(a for a, _ in spans), max(z for _, z in spans)) if spans else df

    src = Sources(requests=days(src.requests), stdout=days(src.stdout), stderr=days(src.stderr))
    return {"requests": request_counts(at(logs.requests(src, None))), "lines": line_counts(at(_lines(logs.scan(src.stdout, None))), at(_lines(logs.scan(src.stderr, None))))}


def aligned(w: Window) -> tuple[datetime, datetime]:
    """The whole steps inside a window, as a span (empty or turned round if there are none)."""
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return zero + -((zero - w.start) // STEP) * STEP, zero + (w.end - zero) // STEP * STEP


def _n(when: Column | None = None) -> Column:
    return F.coalesce(F.sum("n" if when is None else F.when(when, F.col("n"))), F.lit(0))


def _counters() -> list[Column]:
    core, bad = F.col("is_core"), F.col("status") >= 500
    return [_n().alias("request_count"), _n(core).alias("core_request_count"), _n(~core).alias("system_request_count"), _n(bad).alias("error_5xx_count")]


def _mean(total: str, n: str, when: Column | None = None) -> Column:
    of = lambda c: F.sum(c if when is None else F.when(when, F.col(c)))
    return F.round(F.try_divide(of(total).cast("double"), of(n).cast("double")), 6)


def p95(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """The discrete 95th percentile of latency by some columns: counts of slots, added up in order. There are no more
    rows of a group than there are slots."""
    slots = rows.select(*by, F.explode("slots").alias("s")).groupBy(*by, F.col("s.slot").alias("slot")).agg(F.sum("s.n").alias("n"))
    group = Over.partitionBy(*by or [F.lit(0)])
    slots = slots.withColumns({"upto": F.sum("n").over(group.orderBy("slot").rowsBetween(Over.unboundedPreceding, 0)), "all": F.sum("n").over(group)})
    return slots.where("100 * upto >= 95 * all").groupBy(*by).agg(F.min("slot").cast("double").alias(name))


@dataclass(frozen=True)
class Rollup:
    """The two tables, and the questions of ``logs`` answered from them."""

    requests: DataFrame
    lines: DataFrame

    def _rows(self, name: str, src: Sources, w: Window) -> DataFrame:
        a, z = aligned(w)
        if a >= z:
            return counted(src, [(w.start, w.end)])[name]
        rows = getattr(self, name).where((F.col("date") >= F.lit(a.date())) & (F.col("date") <= F.lit(z.date())) & (F.col("bucket") >= F.lit(a)) & (F.col("bucket") < F.lit(z)))
        cut = [(x, y) for x, y in ((w.start, a), (z, w.end)) if x < y]
        return rows.select(*counted(src, cut)[name].columns).unionByName(counted(src, cut)[name]) if cut else rows

    def _requests(self, src: Sources, w: Window) -> DataFrame:
        return self._rows("requests", src, w).withColumn("timestamp", F.col("bucket"))

    def _kind(self, src: Sources, w: Window, kind: str) -> DataFrame:
        return self._rows("lines", src, w).where(F.col("kind") == kind).withColumn("timestamp", F.col("bucket"))

    def overview(self, src: Sources, w: Window) -> DataFrame:
        rows, ok = self._requests(src, w), F.col("status") < 500
        mean = lambda paths: _mean("latency_sum", "latency_n", ok & F.col("path").isin(*paths))
        r = rows.agg(*_counters(), mean(logs.FIRST_ANSWER).alias("first_answer_avg_ms"), mean(logs.ENHANCE).alias("enhance_answer_avg_ms"))
        # an aggregate of nothing has a row, one by key has none
        r = r.crossJoin(p95(rows, "p").agg(F.max("p").alias("request_p95_latency_ms")))
        r = r.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count")))
        said, stage = F.col("kind") == "suggested", F.col("name")
        kept, restored = stage.isin("restore_success", "restore_empty"), F.col("kind") == "restored"
        t = self._rows("lines", src, w).where(said | restored)
        t = t.agg(
            _n(said).alias("qs_total"), _n(said & (stage == "stable")).alias("qs_stable_count"), _n(said & (stage == "degraded")).alias("qs_degraded_count"),
            _mean("a_sum", "a_n", said).alias("qs_avg_latency_ms"), _mean("b_sum", "b_n", said).alias("qs_avg_suggestion_count"),
            _n(restored).alias("restore_total"), _n(restored & kept).alias("restore_success_count"),
        )
        r = r.crossJoin(t.withColumns({"qs_stable_rate": S.rate(F.col("qs_stable_count"), F.col("qs_total")), "restore_success_rate": S.rate(F.col("restore_success_count"), F.col("restore_total"))}))
        return r.select(*OVERVIEW)

    def usage(self, src: Sources, w: Window) -> DataFrame:
        by, rows = ("local", "device_class"), self._requests(src, w).withColumn("local", logs.bucket(w))
        got = rows.groupBy(*by).agg(*_counters()).join(p95(rows, "p95_latency_ms", *by), [*by], "left").withColumnRenamed("local", "bucket")
        got = got.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count")))
        rows = logs.by_device(src, w).join(got, ["bucket", "device_class"], "left")
        rows = rows.select(*logs.labels(w), "device_class", *logs.zero("request_count", "core_request_count", "system_request_count", "error_5xx_count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("error_5xx_rate", "p95_latency_ms")])
        return logs.in_order(rows, "bucket_key", "device_class")

    def error_trend(self, src: Sources, w: Window) -> DataFrame:
        got = self._requests(src, w).where("status >= 500").groupBy(logs.bucket(w).alias("bucket")).agg(_n().alias("error_5xx_count"))
        return logs.in_order(logs.grid(src, w).join(got, "bucket", "left").select(*logs.labels(w), *logs.zero("error_5xx_count")), "bucket_key")

    def top_endpoints(self, src: Sources, w: Window, n: int = logs.TOP) -> DataFrame:
        got = self._requests(src, w).where("status >= 500").groupBy(F.col("path").alias("endpoint")).agg(_n().alias("error_5xx_count"))
        return got.orderBy(F.desc("error_5xx_count"), "endpoint").limit(n)

    def top_errors(self, src: Sources, w: Window, n: int = logs.TOP) -> DataFrame:
        got = self._kind(src, w, "error").groupBy(F.col("name").alias("error_type")).agg(_n().alias("count"))
        return got.orderBy(F.desc("count"), "error_type").limit(n)

    def devices(self, src: Sources, w: Window) -> DataFrame:
        rows = self._requests(src, w)
        got = rows.groupBy("device_class").agg(_n().alias("request_count"), _n(F.col("status") >= 500).alias("error_5xx_count")).join(p95(rows, "p95_latency_ms", "device_class"), "device_class", "left")
        return got.withColumn("error_5xx_rate", S.rate(F.col("error_5xx_count"), F.col("request_count"))).orderBy(F.desc("request_count"), "device_class")

    def suggest_stages(self, src: Sources, w: Window) -> DataFrame:
        got = self._kind(src, w, "suggested").groupBy(F.col("name").alias("stage"))
        return got.agg(_n().alias("count"), _mean("a_sum", "a_n").alias("avg_latency_ms"), _mean("b_sum", "b_n").alias("avg_suggestion_count")).orderBy(F.desc("count"), "stage")

    def suggest_fallbacks(self, src: Sources, w: Window) -> DataFrame:
        got = self._kind(src, w, "fallback").groupBy(F.col("name").alias("fallback_source"), F.col("detail").alias("reason")).agg(_n().alias("count"))
        return got.orderBy(F.desc("count"), "fallback_source", "reason")

    def followups(self, src: Sources, w: Window) -> DataFrame:
        return self._kind(src, w, "opened").groupBy(F.col("name").alias("event_name"), "user_id", "user_email").agg(_n().alias("event_count"))

    def followup_users(self, src: Sources, w: Window) -> DataFrame:
        of = lambda e: _n(F.col("name") == e)
        got = self._kind(src, w, "opened").groupBy("user_id", "user_email").agg(of("recognized").alias("recognized_count"), of("success").alias("success_count"))
        return got.withColumn("success_rate", S.rate(F.col("success_count"), F.col("recognized_count")))

    def user_requests(self, src: Sources, w: Window) -> DataFrame:
        """Requests of a user, a row for each step, device and kind of request, ``n`` of them."""
        return self._kind(src, w, "asked").select("timestamp", "user_id", "user_email", F.col("name").alias("device_class"), "is_core", "n")

    def request_users(self, src: Sources, w: Window) -> DataFrame:
        got = self.user_requests(src, w).groupBy(F.coalesce("user_id", F.lit("unknown")).alias("user_id"), "user_email")
        return got.agg(_n().alias("request_count"), _n(F.col("is_core")).alias("core_request_count"), _n(~F.col("is_core")).alias("system_request_count"), *[_n(F.col("device_class") == d).alias(f"{d}_request_count") for d in logs.DEVICES])

    def user_facts(self, src: Sources, w: Window) -> DataFrame:
        return self._rows("lines", src, w).where(F.col("kind").isin("asked", "opened")).select("kind", "name", "user_id", "user_email", "is_core", "n")

    def user_series(self, src: Sources, w: Window, user_key: str) -> DataFrame:
        key = user_key.strip().lower()
        got = self.user_requests(src, w).where(((F.lower("user_id") == key) | (F.col("user_email") == key)) if key else F.lit(False))
        got = got.groupBy(logs.bucket(w).alias("bucket"), "device_class").agg(_n().alias("request_count"), _n(F.col("is_core")).alias("core_request_count"))
        got = got.withColumn("system_request_count", F.greatest(F.col("request_count") - F.col("core_request_count"), F.lit(0)))
        rows = logs.by_device(src, w).join(got, ["bucket", "device_class"], "left").select(*logs.labels(w), "device_class", *logs.zero("request_count", "core_request_count", "system_request_count"))
        return logs.in_order(rows, "bucket_key", "device_class")


def of_logs(src: Sources) -> Rollup:
    """A rollup of all that the logs hold, counted when it is asked."""
    return Rollup(**counted(src))


def batch_counts(log: str, rows: DataFrame) -> tuple[str, DataFrame]:
    """The table that entries of one log go to, and their rollup."""
    if log == "requests":
        return "requests", request_counts(logs.requests(Sources(requests=rows), None))
    lines, none = _lines(logs.scan(rows, None)), _lines(rows.where("false"))
    return "lines", line_counts(lines, none) if log == "stdout" else line_counts(none, lines)


def append(log: str, rows: DataFrame, folder: str, batch: int) -> None:
    """Add the rollup of some entries of one log as one batch, kept by date. A batch written again replaces itself."""
    table, counts = batch_counts(log, rows)
    counts = counts.withColumns({"log": F.lit(log), "batch": F.lit(batch).cast("long")}).repartition("date", F.pmod(F.hash("bucket"), F.lit(FILES)))
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "log", "batch").parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str) -> Rollup:
    """What ``append`` has kept; a table of which nothing was kept yet is empty."""
    return Rollup(**{n: stored(spark, f"{folder}/{n}", f"{s}, log string, batch bigint") for n, s in SCHEMAS.items()})

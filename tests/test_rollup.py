"""The rollup: slots and their quantiles, steps that a window cuts, batches, pruning, a dashboard without the logs."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from opsloom.catalogue import WEEK, queries
from opsloom.functions import scalars as S
from opsloom.operators import logs, reports, rollup
from opsloom.plans.window import window
from opsloom.sources.tables import Sources, from_dir, registered

UTC, SF = timezone.utc, "/root/testdata/sf0.001"


def slot(ms):
    whole = min(math.floor(ms + 0.5), 1 << 53)
    return whole if whole < S.EXACT_MS else whole - whole % (1 << (whole.bit_length() - S.SLOT_BITS - 1))


def test_slots(spark):
    r = random.Random(1)
    values = [0.0, 0.49, 0.5, 1.0, 1048575.0, 1048576.0, 1048577.0, 2.0**53, 1e300] + [10 ** r.uniform(-2, 12) for _ in range(2000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.latency_slot(F.col("v")).alias("s")).collect()
    for v, s in ((x.v, x.s) for x in got):
        assert s == slot(v)
        assert v > 2**53 or abs(s - v) <= max(0.5, v / 1000)
    assert spark.sql("select cast(null as double) as v").select(S.latency_slot(F.col("v"))).first()[0] is None


def entries(spark, latencies, start=datetime(2024, 1, 10, tzinfo=UTC)):
    rows = [(start + timedelta(seconds=7 * i), (logs.RESOURCE, (logs.SERVICE,)), ("GET", "https://h/v2/ask", 200, f"{v:.9f}s", "x")) for i, v in enumerate(latencies)]
    src = registered(spark)
    return Sources(requests=spark.createDataFrame(rows, src.requests.schema), stdout=src.stdout, stderr=src.stderr)


@pytest.mark.parametrize("shape", ["uniform", "heavy", "one"])
def test_quantile_of_slots_is_near_the_exact_one(spark, shape):
    """Latencies finer than a millisecond: a slot away at most, from logs and from a rollup merged over steps alike."""
    r = random.Random(2)
    latencies = [{"uniform": r.uniform(0, 3), "heavy": r.paretovariate(0.7), "one": 0.1234567}[shape] for _ in range(3000)]
    w, src = window(datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 11, tzinfo=UTC), "UTC"), entries(spark, latencies)
    exact = sorted(1000 * float(f"{v:.9f}") for v in latencies)[math.ceil(0.95 * 3000) - 1]
    got = {logs.overview(src, w).first().request_p95_latency_ms, rollup.of_logs(src).overview(src, w).first().request_p95_latency_ms}
    assert got == {slot(exact)} and abs(got.pop() - exact) <= max(0.5, exact / 1000)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


ASKED = ("overview", "usage", "error_trend", "top_endpoints", "top_errors", "devices", "suggest_stages", "suggest_fallbacks", "followups", "followup_users", "request_users")


@pytest.mark.parametrize("span,asked", [(("10 00:12:01", "10 07:33:59"), ASKED), (("10 00:01:00", "10 00:04:00"), ("usage", "devices")), (("10 00:04:00", "10 00:06:00"), ("overview",)), (("10 00:05:00", "10 00:05:01"), ("top_errors",))])
def test_any_window_equals_the_logs(spark, span, asked):
    src = from_dir(spark, "/root/testdata/sf0.01")
    w = window(*[datetime.strptime(f"2024-01-{t}", "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC) for t in span])
    rolled = rollup.of_logs(src)
    for name in asked:
        assert same(getattr(rolled, name)(src, w), getattr(logs, name)(src, w)), name
    assert same(rolled.user_series(src, w, "u7"), logs.user_series(src, w, "u7"))


def test_batches_by_date(spark, tmp_path):
    """Batches add up, one written twice counts once, a window reads its own days, and a dashboard needs no log."""
    src, folder = from_dir(spark, SF), str(tmp_path / "rollup")
    names = ("requests", "stdout", "stderr")
    part = lambda k: Sources(**{n: getattr(src, n).where(F.pmod(F.hash("timestamp"), F.lit(3)) == k) for n in names})
    for k in (0, 1, 2, 1):
        for n in names:
            rollup.append(n, getattr(part(k), n), folder, k)
    rolled = rollup.read(spark, folder)
    plan = rolled.overview(src, WEEK)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan
    empty = registered(spark)
    bare = Sources(**{n: getattr(empty, n) for n in names}, **{n: (lambda n=n: getattr(src, n)) for n in ("users", "conversations", "messages", "summaries", "runtime")})
    parts = reports.report(bare, WEEK, "dashboard", rolled)
    for part_, name in (("overview", "q01_overview"), ("series", "q02_usage_day"), ("error_trend", "q04_error_trend_day"), ("endpoints", "q06_top_endpoints"), ("errors", "q07_top_errors"), ("devices", "q08_devices"), ("users", "q24_dashboard_users"), ("summary", "q26_dashboard_summary")):
        assert same(parts[part_], queries()[name](spark, SF)), part_
    with reports.summed(src, WEEK) as once:
        assert same(reports.report(bare, WEEK, "dashboard", once)["summary"], parts["summary"])
    days = {p.name for p in (tmp_path / "rollup" / "requests").iterdir() if p.name.startswith("date=")}
    assert len(days) == 30


def test_nothing(spark):
    src = registered(spark)
    rolled = rollup.of_logs(src)
    for name in ("overview", "usage", "devices", "followup_users"):
        assert same(getattr(rolled, name)(src, WEEK), getattr(logs, name)(src, WEEK)), name
    late = spark.createDataFrame([(None, (logs.RESOURCE, (logs.SERVICE,)), ("GET", None, None, None, None))], src.requests.schema)
    assert rollup.request_counts(logs.requests(Sources(requests=late), None)).collect() == []

"""Stored tables and the alert service: late and repeated batches, pruning, expiry, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsloom.catalogue import MONTH, WEEK
from opsloom.operators import documents, logs
from opsloom.sources.tables import Sources, from_dir
from opsloom.streaming import policies as P
from opsloom.streaming import store
from opsloom.streaming.alerts import stream

UTC, SF = dt.timezone.utc, "/root/testdata/sf0.001"
LOGS = ("requests", "stdout", "stderr")
REST = ("users", "conversations", "summaries", "runtime")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """All tables of the fixture, stored from files out of order, a file a batch."""
    src, folder = from_dir(spark, SF), str(tmp_path_factory.mktemp("store"))
    for name in (*LOGS, "messages"):
        rows = getattr(src, name)
        rows.repartition(3, F.hash("timestamp")).write.parquet(f"{folder}/in/{name}")
        incoming = stream(spark, f"{folder}/in/{name}", name, 1)
        for _ in range(2):  # the second finds nothing new
            store.start_store(incoming, name, f"{folder}/store", f"{folder}/state/{name}").awaitTermination()
        store.write_batch(name, spark.read.schema(incoming.schema).parquet(f"{folder}/in/{name}").where("false"), f"{folder}/store", 99)
    return src, f"{folder}/store"


def scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x or "PartitionFilters" in x]


def test_stored_tables_answer_alike_and_read_their_days(spark, kept):
    src, folder = kept
    rest = {n: getattr(src, n) for n in REST}
    here = store.open_store(spark, folder, **rest)
    for ask in (lambda s: logs.usage(s, WEEK), lambda s: logs.top_errors(s, WEEK), lambda s: logs.log_counters(s, WEEK), lambda s: documents.usage(s, WEEK), lambda s: documents.usage(s, WEEK, True), lambda s: documents.monitor(s, WEEK), lambda s: documents.monitor_user_errors(s, WEEK), lambda s: documents.monitor_users(s, MONTH), lambda s: documents.dashboard_users(s, WEEK)):
        assert same(ask(here), ask(src))
    for ask, table in ((logs.usage, "requests"), (logs.top_errors, "stderr"), (logs.log_counters, "stdout"), (documents.usage, "messages"), (documents.monitor, "messages"), (documents.monitor_users, "messages"), (documents.monitor_errors, "messages"), (documents.dashboard_users, "messages")):
        found = [x for x in scans(ask(here, WEEK)) if f"/{table}]" in x or f"/{table}," in x]
        assert found and all("date#" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in found), (ask, found)
    rolled = store.open_rollup(spark, folder)
    assert same(rolled.overview(here, WEEK), logs.overview(src, WEEK)) and same(rolled.top_errors(here, WEEK), logs.top_errors(src, WEEK))


def test_a_batch_again_and_late_rows(spark, tmp_path):
    src = from_dir(spark, SF)
    first, late = (src.requests.where(c) for c in ("timestamp >= '2024-01-05'", "timestamp < '2024-01-05'"))
    for batch, rows in ((0, first), (1, late), (1, late), (0, first)):
        store.write_batch("requests", rows, str(tmp_path), batch)
    here = store.open_store(spark, str(tmp_path))
    assert here.requests.count() == logs.scan(src.requests, None).count()
    assert same(store.open_rollup(spark, str(tmp_path)).devices(here, MONTH), logs.devices(src, MONTH))


def test_old_days_go(spark, tmp_path):
    src, folder = from_dir(spark, SF), str(tmp_path)
    for name in (*LOGS, "messages"):
        store.write_batch(name, getattr(src, name), folder, 0)
    nowhere = src.requests.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp"))
    nowhere = nowhere.withColumn("resource", F.expr(f"named_struct('type', '{logs.RESOURCE}', 'labels', named_struct('service_name', '{logs.SERVICE}'))"))
    store.write_batch("requests", nowhere, folder, 1)
    assert store.expire(spark, folder, dt.datetime(2024, 7, 1, 12, tzinfo=UTC), 200) == []
    gone = store.expire(spark, folder, dt.datetime(2024, 7, 8, 0, tzinfo=UTC))
    assert gone == [dt.date(2024, 1, d) for d in range(1, 11)]
    here, day = store.open_store(spark, folder), dt.date(2024, 1, 11)
    assert here.requests.where("timestamp is not null").agg(F.min("date")).first()[0] == day and here.requests.where("timestamp is null").count() == 1
    assert here.messages.agg(F.min("date")).first()[0] == day and here.message_counts.agg(F.min("date")).first()[0] == day
    assert store.open_rollup(spark, folder).requests.agg(F.min("date")).first()[0] == day
    assert store.expire(spark, folder, dt.datetime(2024, 7, 8, 0, tzinfo=UTC)) == []
    assert here.requests.where("timestamp is not null").count() == logs.scan(src.requests, None).where("timestamp >= '2024-01-11'").count()


def test_nothing_stored(spark, tmp_path):
    here = store.open_store(spark, str(tmp_path / "none"))
    assert logs.overview(here, WEEK).first().request_count == 0 and documents.monitor(here, WEEK).first().message_count == 0
    assert store.open_rollup(spark, str(tmp_path / "none")).overview(here, WEEK).first().request_count == 0
    assert store.expire(spark, str(tmp_path / "none"), dt.datetime(2030, 1, 1, tzinfo=UTC)) == []


T0 = dt.datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp, metric string"
MIXED = (*P.POLICIES, P.Policy("either", (P.Condition("qs_degraded", 2, 600), P.Condition("restore_failed", 4, 1800))))


def hits(seed, n=400, hours=6):
    r = random.Random(seed)
    return [(T0 + dt.timedelta(seconds=r.randrange(hours * 3600)), r.choice(("error_5xx", "qs_degraded", "restore_failed", "qs_total"))) for _ in range(n)]


def told(rows, policies):
    """By plain loops: incidents with a condition that holds."""
    out = set()
    for p in policies:
        for c in p.conditions:
            counts = {}
            for t, m in rows:
                if m == c.metric:
                    s = int(t.replace(tzinfo=UTC).timestamp())
                    counts[s - s % c.seconds] = counts.get(s - s % c.seconds, 0) + 1
            out |= {(p.name, s - s % p.seconds) for s, n in counts.items() if n >= c.least}
    return out


def test_policies_equal_plain_loops_and_single_alerts(spark):
    rows = hits(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.crossings(df, MIXED)
    assert {(r.policy, r.incident_start) for r in got.collect()} == told(rows, MIXED)
    for name in logs.ALERTS:
        assert {(r.window_start, r["count"]) for r in got.where(F.col("policy") == name).collect()} == {(r.window_start, r["count"]) for r in logs.alert(df, name).collect()}
    with pytest.raises(ValueError):
        P.crossings(df, (*P.POLICIES, P.Policy("odd", (P.Condition("qs_total", 1, 700),))))


def test_each_channel_is_told_once_over_a_restart(spark, tmp_path):
    """Files out of order, a channel that dies while it is told, a stop, a restart: every incident once to each channel."""
    rows, folder = hits(2), str(tmp_path)
    random.Random(3).shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    put = lambda k: spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    calls, dead = {"pager": [], "mail": []}, []

    def tell(name):
        def one(new, batch):
            if name == "mail" and len(calls["mail"]) == 1 and not dead:
                dead.append(batch)
                raise RuntimeError("killed")
            calls[name].append([(r.policy, r.incident_start) for r in new.collect()])

        return one

    channels = {"pager": tell("pager"), "mail": tell("mail"), "table": P.table_channel(f"{folder}/told")}
    put(0)
    rows_in = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start = lambda: P.start_policies(rows_in, channels, f"{folder}/ledger", f"{folder}/state", MIXED, every="1 second", late="1 day")
    q = start()
    q.processAllAvailable()
    put(1)
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    assert dead
    q = start()
    q.processAllAvailable()
    q.stop()
    put(2)
    put(3)
    q = start()
    q.processAllAvailable()
    q.stop()
    want = told(rows, MIXED)
    for name in ("pager", "mail"):
        flat = [x for call in calls[name] for x in call]
        assert sorted(flat) == sorted(set(flat)) and set(flat) == want, name
    table = [(r.policy, r.incident_start) for r in spark.read.parquet(f"{folder}/told").collect()]
    assert sorted(table) == sorted(want)


def test_all_counters_of_late_and_unordered_files_equal_batch(spark, tmp_path):
    src, folder = from_dir(spark, SF), str(tmp_path)
    for n in ("requests", "stdout"):
        rows = getattr(src, n)
        for part in ("timestamp >= '2024-01-20'", "timestamp < '2024-01-05'", "timestamp between '2024-01-05' and '2024-01-20'"):
            rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    live = lambda: logs.counter_rows(Sources(requests=stream(spark, f"{folder}/requests", "requests", 1), stdout=stream(spark, f"{folder}/stdout", "stdout", 1)))
    q = P.start_counters(live(), f"{folder}/counts", f"{folder}/state", every="1 second")
    q.processAllAvailable()
    q.stop()
    src.requests.where("timestamp < '2024-01-02'").coalesce(1).write.mode("append").parquet(f"{folder}/requests")  # very late
    q = P.start_counters(live(), f"{folder}/counts", f"{folder}/state")
    q.awaitTermination()
    batch = logs.counter_rows(Sources(requests=spark.read.parquet(f"{folder}/requests"), stdout=spark.read.parquet(f"{folder}/stdout")))
    want = batch.groupBy(F.date_trunc("minute", "timestamp").alias("minute"), "metric").agg(F.count("*").alias("n"))
    got = P.counters(spark, f"{folder}/counts")
    assert same(got.select("minute", "metric", "n"), want) and {r.metric for r in got.collect()} == {"error_5xx", "qs_total", "qs_degraded", "restore_total", "restore_failed"}

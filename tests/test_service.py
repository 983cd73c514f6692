"""What a service around the engine needs: kept results, refused limits, exports as one CSV text."""

import csv
import glob
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from opsloom.catalogue import WEEK
from opsloom.operators import reports
from opsloom.operators.cache import ResultCache, asked
from opsloom.plans.window import resolve
from opsloom.sources.sinks import BOM, write_csv_rows, write_csv_whole
from opsloom.sources.tables import from_dir

SF = "/root/testdata/sf0.001"


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def jobs(spark, f):
    """What ``f`` gives, and how many jobs it ran."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def rows(parts):
    return {k: sorted(map(str, df.collect())) for k, df in parts.items()}


def test_second_call_runs_no_job(spark):
    src, cache = from_dir(spark, SF), ResultCache(clock=(clock := Clock()))
    ask = lambda user="": rows(reports.dashboard(src, WEEK, user, cache=cache))
    first, n = jobs(spark, lambda: ask("u7"))
    assert n > 0 and {"selected_user", "selected_series", "summary"} < set(first) and len(first["selected_user"]) == 1
    again, n = jobs(spark, lambda: ask(" U7 "))
    assert n == 0 and again == first
    assert rows(reports.dashboard(src, WEEK, "u7")) == first
    clock.now = 15.0
    assert jobs(spark, lambda: ask("u7"))[1] > 0 and len(cache) == 1


def test_expiry_eviction_and_large_results(spark):
    cache, made = ResultCache(entries=3, rows=10, clock=(clock := Clock())), []

    def build(k, n=5):
        made.append(k)
        return {"part": spark.range(n).withColumn("k", F.lit(k))}

    for k in "abc":
        cache.get(k, lambda k=k: build(k))
        clock.now += 1
    assert cache.get("a", lambda: build("a"))["part"].count() == 5 and made == ["a", "b", "c"]
    cache.get("d", lambda: build("d", 1000))  # too large to be held here, and one too many: a goes
    assert cache.get("d", lambda: build("d"))["part"].count() == 1000 and len(cache) == 3
    cache.get("a", lambda: build("a"))
    assert made == ["a", "b", "c", "d", "a"]
    clock.now = 17.5  # c ended at 17
    cache.get("c", lambda: build("c"))
    assert made[-1] == "c"
    cache.clear()
    assert len(cache) == 0
    none = ResultCache(ttl=0)
    none.get("x", lambda: build("x"))
    none.get("x", lambda: build("x"))
    assert made[-2:] == ["x", "x"] and len(none) == 0
    assert asked(WEEK, "dashboard", " U ") == asked(WEEK, "dashboard", "u") != asked(WEEK, "overview", "u")
    now = WEEK.end
    assert asked(resolve(now, preset="last_1h"), "d") != asked(resolve(now, start="2024-01-14T23:00:00+00:00"), "d")


def test_limits_are_refused(spark):
    src = from_dir(spark, SF)
    assert reports.listing(src, "users", limit=3).count() == 3 and reports.listing(src, "messages", "u7", "c7", limit=2).count() == 2
    for name, args, limit in (("users", (), 0), ("users", (), 501), ("conversations", ("u7",), 501), ("messages", ("u7", "c7"), 2001), ("messages", ("u7", "c7"), -1)):
        with pytest.raises(ValueError):
            reports.listing(src, name, *args, limit=limit)


def whole(path):
    """The export's files one after the other."""
    return b"".join(open(f, "rb").read() for f in (f"{path}/0-header.csv", *sorted(glob.glob(f"{path}/1-rows/part-*"))))


def plain(dicts):
    if not dicts:
        return BOM.encode()
    names, out = [], io.StringIO()
    for d in dicts:
        names += [k for k in d if k not in names]
    w = csv.DictWriter(out, names, extrasaction="ignore")
    w.writeheader()
    w.writerows(dicts)
    return (BOM + out.getvalue()).encode()


def test_export_is_byte_equal_to_a_plain_writer(spark, tmp_path):
    r = random.Random(1)
    texts = [None, "", "a", 'say "hi"', "a,b", "two\nlines", "two\r\nlines", " é ", '"']
    numbers = [None, 0.0, -0.0, 1.0, 0.5, 1e-4, 9.9e-5, -1.25e-7, 1e15, 1e16, 1.5e300, 123456.789, 0.000123, math.inf, -math.inf, math.nan] + [round(r.uniform(-1, 1) * 10 ** r.randint(-6, 9), 6) for _ in range(300)]
    data = [(i, r.choice(texts), n, r.choice([True, False, None])) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(data, "n long, `a text` string, x double, b boolean").repartitionByRange(5, "n").sortWithinPartitions("n")
    write_csv_whole(df, f"{tmp_path}/a")
    assert whole(f"{tmp_path}/a") == plain([r_.asDict() for r_ in df.collect()])
    assert len(glob.glob(f"{tmp_path}/a/1-rows/part-*")) == 5
    write_csv_whole(df.where("false"), f"{tmp_path}/b")
    assert whole(f"{tmp_path}/b") == BOM.encode()
    write_csv_whole(spark.createDataFrame([("",), ("x",)], "t string").coalesce(1), f"{tmp_path}/c")
    assert whole(f"{tmp_path}/c") == plain([{"t": ""}, {"t": "x"}])


def test_header_is_the_union_of_keys_as_first_seen(spark, tmp_path):
    r = random.Random(2)
    dicts = [{k: f"{k}{i}" for k in r.sample("zyxwvut", r.randint(0, 4))} for i in range(40)]
    df = spark.createDataFrame([(i, [(k, v) for k, v in d.items()]) for i, d in enumerate(dicts)], "i long, cells array<struct<key:string,value:string>>").repartition(4)
    write_csv_rows(df, f"{tmp_path}/a", ["i"])
    assert whole(f"{tmp_path}/a") == plain(dicts)
    write_csv_rows(df.where("false"), f"{tmp_path}/b", ["i"])
    assert whole(f"{tmp_path}/b") == BOM.encode()


def test_named_export_as_one_text(spark, tmp_path):
    src = from_dir(spark, SF)
    reports.export(src, "errors/trend", f"{tmp_path}/e", WEEK, write=write_csv_whole)
    want = reports.report(src, WEEK, "errors")["trend"].collect()
    assert whole(f"{tmp_path}/e") == plain([x.asDict() for x in want])

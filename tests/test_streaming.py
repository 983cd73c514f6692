import datetime as dt

from opsloom.operators.logs import ALERTS, alert
from opsloom.streaming.alerts import start_alert


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=97 * i), m) for i in range(60) for m in ("error_5xx", "restore_failed") if i % 7 or m == "error_5xx"]
    spark.createDataFrame(rows, "timestamp timestamp, metric string").repartition(4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name in ALERTS:
        got = {}
        q = start_alert(stream, name, lambda df, _, got=got: got.update({r.window_start: r["count"] for r in df.collect()}), str(tmp_path / f"state-{name}"), late="1 day")
        q.awaitTermination()
        assert got == {r.window_start: r["count"] for r in alert(batch, name).collect()}
        assert bool(got) == (name != "suggest_degraded" )


def test_ingest_and_counters_on_a_stream(spark, tmp_path):
    """Log files in, a table by date and the alerts of its counters out, as from batch rows."""
    from opsloom.operators.logs import SERVICE, counter_rows, scan
    from opsloom.sources.tables import Sources, from_dir
    from opsloom.streaming.alerts import stream
    from opsloom.streaming.ingest import start_ingest

    src = from_dir(spark, "/root/testdata/sf0.001")
    for name in ("requests", "stdout"):
        getattr(src, name).selectExpr("*" if name == "stdout" else "timestamp", *[] if name == "stdout" else ["resource", "httpRequest"]).repartition(3).write.parquet(str(tmp_path / name))
    requests, stdout = (spark.read.parquet(str(tmp_path / n)) for n in ("requests", "stdout"))
    start_ingest(stream(spark, str(tmp_path / "stdout"), "stdout", 1), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    start_ingest(stream(spark, str(tmp_path / "stdout"), "stdout", 1), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()  # nothing new
    table, want = spark.read.parquet(str(tmp_path / "table")), scan(stdout, None, SERVICE)
    assert table.count() == want.count() > 0 and table.where("date <> to_date(timestamp)").count() == 0
    assert {p.name.split("=")[0] for p in (tmp_path / "table").iterdir() if p.is_dir()} == {"date", "_spark_metadata"}
    live = counter_rows(Sources(requests=stream(spark, str(tmp_path / "requests"), "requests"), stdout=stream(spark, str(tmp_path / "stdout"), "stdout")))
    batch, got = counter_rows(Sources(requests=requests, stdout=stdout)), {}
    start_alert(live, "5xx", lambda df, _: got.update({r.window_start: r["count"] for r in df.collect()}), str(tmp_path / "alerts"), late="400 days").awaitTermination()
    assert got == {r.window_start: r["count"] for r in alert(batch, "5xx").collect()}

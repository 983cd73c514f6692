"""Stored tables: log entries and messages as they come in, typed once, kept by date, expired by date.

A table is a folder of Parquet files by date and batch. Each micro-batch replaces exactly the partitions of its own
number, so a batch that is run again after a failure adds nothing twice, entries may come late or out of order,
and no commit log ties the folder to the files that were once in it: whole days can go. With each batch its rollup is
kept (``operators.rollup``), and of messages their number by conversation.

A log entry's date is that of its time; a message's time is parsed here, once, into ``at``. What has no time goes to the
partition of null, which no window reads and which never expires. Dates are UTC, as the session's zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import rollup
from ..operators.logs import SERVICE, scan
from ..plans.window import RETENTION_DAYS
from ..sources.tables import SCHEMAS, Sources, hadoop_path, stored

LOGS = ("requests", "stdout", "stderr")
COUNTS = "user_id string, conv_id string, n bigint"
#: Everything under a store's folder that is kept by date.
FOLDERS = (*LOGS, "messages", "message_counts", "rollup/requests", "rollup/lines")


def typed(table: str, rows: DataFrame, service: str = SERVICE) -> DataFrame:
    """Rows as they are stored: a log's entries of the service, messages with their instant, each with its date."""
    if table == "messages":
        return rows.withColumn("at", S.iso_time(F.col("timestamp"))).withColumn("date", F.to_date("at"))
    return scan(rows, None, service).withColumn("date", F.to_date("timestamp"))


def _keep(rows: DataFrame, path: str, batch: int) -> None:
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)


def write_batch(table: str, rows: DataFrame, folder: str, batch: int, service: str = SERVICE) -> None:
    """Store one batch of a table and what is counted from it."""
    rows = rows.persist()
    try:
        kept = typed(table, rows, service)
        _keep(kept, f"{folder}/{table}", batch)
        if table in LOGS:
            rollup.append(table, rows, f"{folder}/rollup", batch)
        else:
            counts = kept.groupBy("date", "user_id", "conv_id").agg(F.count("*").alias("n"))
            _keep(counts.repartition("date", F.pmod(F.hash("user_id", "conv_id"), F.lit(rollup.FILES))), f"{folder}/message_counts", batch)
    finally:
        rows.unpersist()


def start_store(rows: DataFrame, table: str, folder: str, checkpoint: str, every: str | None = None, service: str = SERVICE) -> StreamingQuery:
    """Store a stream of a table's rows (see ``alerts.stream``): all that is there, or for good, in a batch each ``every``."""
    when = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**when).foreachBatch(lambda df, batch: write_batch(table, df, folder, batch, service)).start()


def open_store(spark: SparkSession, folder: str, **others: DataFrame) -> Sources:
    """The stored tables as sources; windows read the partitions of their days. Tables that are not stored are given, or
    empty."""
    found = {n: (lambda s=s: spark.createDataFrame([], s)) for n, s in SCHEMAS.items()} | others
    found |= {n: (lambda n=n: stored(spark, f"{folder}/{n}", f"{SCHEMAS[n]}, date date, batch bigint").drop("batch")) for n in LOGS}
    found["messages"] = lambda: stored(spark, f"{folder}/messages", f"{SCHEMAS['messages']}, at timestamp, date date, batch bigint").drop("batch")
    found["message_counts"] = lambda: stored(spark, f"{folder}/message_counts", f"{COUNTS}, date date, batch bigint").drop("batch")
    return Sources(**found)


def open_rollup(spark: SparkSession, folder: str) -> rollup.Rollup:
    return rollup.read(spark, f"{folder}/rollup")


def expire(spark: SparkSession, folder: str, now: datetime, days: int = RETENTION_DAYS) -> list[date]:
    """Delete the days whose beginning lies ``days`` days or more back; says which. Works on folders alone, so its cost
    is the number of days, not of entries."""
    last, gone = (now.astimezone(timezone.utc) - timedelta(days=days)).date(), set()
    for name in FOLDERS:
        where, files = hadoop_path(spark, f"{folder}/{name}")
        for entry in files.listStatus(where) if files.exists(where) else ():
            key, _, value = entry.getPath().getName().partition("=")
            if key == "date" and value[:1].isdigit() and (day := date.fromisoformat(value)) <= last:
                files.delete(entry.getPath(), True)
                gone.add(day)
    return sorted(gone)

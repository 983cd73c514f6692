"""Alert policies as a service: one stream over all policies, each crossing told once to every channel; and counters.

A policy has conditions (a counter reaches a threshold within aligned windows) and fires if any of them holds. All
conditions of all policies are counted by one aggregation: windows of every length lie inside windows of the longest,
by which the watermark closes them, so state is bounded by the entries of that and ``late``.

A crossing belongs to an incident: policy and start of the policy's longest window. Each channel has a ledger of the
incidents it was told of, a part for each micro-batch. A batch that is run again passes over channels whose part is
there; the others are called with the same incidents and the same batch number, by which a channel that was
stopped between being told and being written down can tell a repetition (``table_channel`` does).

The counters have no watermark: each batch adds its counts by minute under its own number, so entries however late are
counted, and a batch run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import ALERTS
from ..sources.tables import hadoop_path, stored
from .alerts import LATE

Channel = Callable[[DataFrame, int], None]
INCIDENT = "policy string, incident_start bigint"
COUNTERS = "minute timestamp, metric string, n bigint, date date, batch bigint"


@dataclass(frozen=True)
class Condition:
    metric: str
    least: int
    seconds: int


@dataclass(frozen=True)
class Policy:
    name: str
    conditions: tuple[Condition, ...]

    @property
    def seconds(self) -> int:
        return max(c.seconds for c in self.conditions)


POLICIES = tuple(Policy(name, (Condition(*c),)) for name, c in ALERTS.items())


def crossings(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, incident_start, metric, window_start, count for each aligned window in which a condition holds; of batch rows
    (timestamp, metric) and streams alike."""
    longest = max(p.seconds for p in policies)
    if odd := [c for p in policies for c in p.conditions if longest % p.seconds or p.seconds % c.seconds]:
        raise ValueError(f"windows that do not lie inside the longest one: {odd}")
    at = F.unix_seconds("timestamp")
    start = lambda n: at - F.pmod(at, F.lit(n))
    told = [
        F.when(F.col("metric") == c.metric, F.struct(F.lit(p.name).alias("policy"), start(p.seconds).alias("incident_start"), F.lit(c.metric).alias("metric"), F.lit(c.seconds).alias("seconds"), start(c.seconds).alias("window_start"), F.lit(c.least).alias("least")))
        for p in policies
        for c in p.conditions
    ]
    hits = rows.select("timestamp", F.explode(F.array_compact(F.array(*told))).alias("c")).select("timestamp", "c.*")
    got = hits.groupBy(F.window("timestamp", f"{longest} seconds"), "policy", "incident_start", "metric", "seconds", "window_start", "least").agg(F.count("*").alias("count"))
    return got.where(F.col("count") >= F.col("least")).select("policy", "incident_start", "metric", "window_start", "count")


def deliver(found: DataFrame, channels: dict[str, Channel], ledger: str, batch: int) -> None:
    """Tell each channel of the incidents it has not been told of, and write them down under the batch's number."""
    spark = found.sparkSession
    found = found.groupBy("policy", "incident_start").agg(F.min("window_start").alias("window_start"), F.array_sort(F.collect_set("metric")).alias("metrics"), F.max("count").alias("count")).persist()
    try:
        for name, tell in channels.items():
            part, files = hadoop_path(spark, f"{ledger}/{name}/batch={batch}/_SUCCESS")
            if files.exists(part):
                continue
            told = stored(spark, f"{ledger}/{name}", f"{INCIDENT}, batch bigint").where(F.col("batch") < batch).drop("batch")
            new = found.join(told, ["policy", "incident_start"], "left_anti")
            if not new.isEmpty():
                tell(new, batch)
            new.select("policy", "incident_start").write.mode("overwrite").parquet(f"{ledger}/{name}/batch={batch}")
    finally:
        found.unpersist()


def table_channel(path: str) -> Channel:
    """A channel that writes what it is told as a folder for each batch; told again, it writes the same again."""
    return lambda new, batch: new.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def start_policies(rows: DataFrame, channels: dict[str, Channel], ledger: str, checkpoint: str, policies: tuple[Policy, ...] = POLICIES, every: str | None = None, late: str = LATE) -> StreamingQuery:
    """Watch (timestamp, metric) rows of a stream (``logs.counter_rows``): all that is there, or for good, in a batch each
    ``every``. Entries later than ``late`` are not counted any more."""
    found = crossings(rows.withWatermark("timestamp", late), policies)
    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**_trigger(every)).foreachBatch(lambda df, batch: deliver(df, channels, ledger, batch)).start()


def start_counters(rows: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Count (timestamp, metric) rows of a stream by minute, kept by date."""

    def add(df: DataFrame, batch: int) -> None:
        counts = df.groupBy(F.date_trunc("minute", "timestamp").alias("minute"), "metric").agg(F.count("*").alias("n"))
        counts = counts.withColumns({"date": F.to_date("minute"), "batch": F.lit(batch).cast("long")}).repartition("date")
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(folder)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**_trigger(every)).foreachBatch(add).start()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """minute, metric, n, date: what ``start_counters`` has counted."""
    return stored(spark, folder, COUNTERS).groupBy("date", "minute", "metric").agg(F.sum("n").alias("n"))

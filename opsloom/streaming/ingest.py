"""Continuous log ingest: log files of one service into tables partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import SERVICE, scan


def start_ingest(rows: DataFrame, table: str, checkpoint: str, service: str = SERVICE) -> StreamingQuery:
    """Append the service's entries of a stream (see ``alerts.stream``) to a table, each exactly once, until all that is
    there is read. Entries without a time go to the partition of null."""
    dated = scan(rows, None, service).withColumn("date", F.to_date("timestamp"))
    return dated.writeStream.partitionBy("date").format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

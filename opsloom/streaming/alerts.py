"""The alert job: log files in, threshold crossings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import alert
from ..sources.tables import SCHEMAS

#: How late a log entry may come before its window is closed; bounds the state.
LATE = "10 minutes"


def stream(spark: SparkSession, path: str, source: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of log files of one source as a stream."""
    return spark.readStream.schema(SCHEMAS[source]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_alert(rows: DataFrame, name: str, notify: Callable[[DataFrame, int], None], checkpoint: str, late: str = LATE) -> StreamingQuery:
    """Run one alert over (timestamp, metric) rows until all that is there is read; ``notify`` gets every batch
    of windows that have reached the threshold (again each time their count changes)."""
    found = alert(rows.withWatermark("timestamp", late), name)
    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(notify).start()

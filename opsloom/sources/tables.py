"""The engine's sources as DataFrames.

A deployment registers its own tables (``registered(spark, requests=..., stdout=..., ...)``); a missing one is an empty
DataFrame of the right schema. ``from_dir`` derives all of them from the star-schema test tables. A source is only read
once a query asks for it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .message_documents import shredded

RESOURCE = "resource struct<type:string,labels:struct<service_name:string>>"
SCHEMAS = {
    "requests": f"timestamp timestamp, {RESOURCE}, httpRequest struct<requestMethod:string,requestUrl:string,status:int,latency:string,userAgent:string>",
    "stdout": f"timestamp timestamp, {RESOURCE}, textPayload string",
    "stderr": f"timestamp timestamp, {RESOURCE}, textPayload string",
    "users": "user_id string, userEmail string, subject string, updatedAt string, lastSeenAt string, identitySource string, identityVerified boolean",
    "conversations": "user_id string, conv_id string, title string, mode string, visibility string, isFavorite boolean, integrityState string, messageCount bigint, createdAt string, updatedAt string",
    "summaries": "user_id string, conv_id string, querySuggestRuntimeSummary string",
    "messages": "user_id string, conv_id string, msg_id string, role string, content string, timestamp string, status string, errorMessage string, feedback string, grounded struct<citations:array<string>>, modeAtSend string, chatFlowType string, parentTurnId string",
    "runtime": "user_id string, conv_id string, payload string",
}


class Sources:
    """The tables of ``SCHEMAS`` as attributes. Runtime summaries, kept apart from the conversations that hold them, and
    runtime documents are JSON text."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables

    def has(self, name: str) -> bool:
        return name in self._tables

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        if not isinstance(tables[name], DataFrame):
            tables[name] = tables[name]()
        return tables[name]


def registered(spark: SparkSession, **tables: DataFrame | str) -> Sources:
    """Sources from DataFrames or table names; names that do not exist and sources not named are empty. Local time
    counts from UTC, so the session has to run in it."""
    if (zone := spark.conf.get("spark.sql.session.timeZone")) not in ("UTC", "Etc/UTC"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}; set it to UTC")
    found = {}
    for name, schema in SCHEMAS.items():
        t = tables.get(name)
        if isinstance(t, str):
            t = spark.table(t) if spark.catalog.tableExists(t) else None
        found[name] = (lambda schema=schema: spark.createDataFrame([], schema)) if t is None else t
    return Sources(**found)


def of_days(df: DataFrame, start: datetime, end: datetime, undated: bool = False) -> DataFrame:
    """The partitions of a stored table that may hold something of a span (``undated``: or of no time at all). Other
    tables stay as they are."""
    if "date" not in df.columns:
        return df
    days = F.col("date").between(F.lit(start.astimezone(timezone.utc).date()), F.lit(end.astimezone(timezone.utc).date()))
    return df.where(days | F.col("date").isNull() if undated else days)


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lies in, wherever that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files, or no rows where there is none yet."""
    where, files = hadoop_path(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(where) else spark.createDataFrame([], schema)


def from_dir(spark: SparkSession, sf_dir: str, documents: bool = False) -> Sources:
    """The test tables as sources; messages as columns, or shredded from whole documents."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    resource = "struct(resource_type as type, struct(service_name) as labels) as resource"
    view = lambda name: adapters.spark_view(spark, sf_dir, name)
    text = ["cast(timestamp as timestamp) as timestamp", resource, "textPayload"]
    # facts of even-numbered conversations are in their summary, of odd ones in a document of their own
    odd = "cast(substr(conv_id, 2) as bigint) % 2 = 1"

    def payloads() -> DataFrame:
        fact = F.to_json(F.struct("lastEventAt", "impressions", "clicks", "adoptions", "editAfterAccepts", "dismisses"))
        return view("a_facts").groupBy("user_id", "conv_id").agg(F.concat(F.lit('{"suggestionFacts": ["no fact", 7, null, '), F.array_join(F.collect_list(fact), ", "), F.lit("]}")).alias("payload"))

    return Sources(
        requests=lambda: view("a_requests").selectExpr("cast(timestamp as timestamp) as timestamp", resource, "struct('GET' as requestMethod, requestUrl, status, latency, userAgent) as httpRequest"),
        stdout=lambda: view("a_stdout").selectExpr(*text),
        stderr=lambda: view("a_stderr").selectExpr(*text),
        users=lambda: view("a_users"),
        conversations=lambda: view("a_conversations"),
        summaries=lambda: payloads().where(f"not ({odd})").withColumnRenamed("payload", "querySuggestRuntimeSummary"),
        messages=lambda: shredded(view("a_message_docs")) if documents else view("a_messages").selectExpr("* except (has_citation)", "struct(if(has_citation, array('x'), array()) as citations) as grounded"),
        runtime=lambda: payloads().where(odd),
    )

"""The four helper views over the logs of one service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import Sources
from .logs import SERVICE, scan, text_lines


def v_requests(src: Sources, service: str = SERVICE) -> DataFrame:
    h = "httpRequest."
    return scan(src.requests, None, service).select(F.col("timestamp").alias("ts"), F.col(h + "status").try_cast("bigint").alias("status"), F.col(h + "requestMethod").alias("method"), F.col(h + "requestUrl").alias("request_url"), S.latency_ms(F.col(h + "latency")).alias("latency_ms"), F.lower(h + "userAgent").alias("user_agent"), S.device_class(F.col(h + "userAgent")).alias("device_class"), F.col("resource.labels.service_name").alias("service_name"))


def v_query_suggest_results(src: Sources, service: str = SERVICE) -> DataFrame:
    line = F.col("line")
    return text_lines(src, None, "query_suggest_result ", service).select(F.col("timestamp").alias("ts"), *[S.key_value(line, k).alias(k) for k in ("mode", "conversation_id", "stage", "stable")], *[S.key_number(line, k).alias(k) for k in ("latency_ms", "suggestion_count")])


def v_query_suggest_degraded(src: Sources, service: str = SERVICE) -> DataFrame:
    line = F.col("line")
    return text_lines(src, None, "query_suggest_refine_degraded ", service).select(F.col("timestamp").alias("ts"), S.key_value(line, "reason").alias("reason"), S.key_value(line, "fallback").alias("fallback_source"), S.key_value(line, "conversation_id").alias("conversation_id"))


def v_sync_telemetry(src: Sources, service: str = SERVICE) -> DataFrame:
    line = F.col("line")
    return text_lines(src, None, "chat_sync_telemetry ", service).select(F.col("timestamp").alias("ts"), S.key_value(line, "event").alias("event"), S.key_value(line, "conversation_id").alias("conversation_id"), S.extract(line, r"detail=(\{.*\})\z").alias("detail_json"))


VIEWS = {f.__name__: f for f in (v_requests, v_query_suggest_results, v_query_suggest_degraded, v_sync_telemetry)}


def create_views(src: Sources, service: str = SERVICE) -> None:
    """Register all four as temporary views."""
    for name, f in VIEWS.items():
        f(src, service).createOrReplaceTempView(name)

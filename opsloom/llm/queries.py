"""The training-data queries by name, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hard_negatives import hard_negatives
from .importance_resampling import resample
from .jaccard_join import shingle_components
from .language_id import identify
from .license_scan import scan
from .oracle import oracle_sql
from .phrase_index import contamination
from .pii_spans import digests, find_spans
from .posting_lists import nearest
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_histogram
from .weak_labels import classify
from .wfst_pieces import encode_decode


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_histogram(_read(spark, sf_dir, "documents"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"))


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op8_wfst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: documents are taken as files of the directory source/lang ("-" for a null)."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang", "doc_id")])
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets the next of ten labels first, so that there are negatives among the nearest."""
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_spans(_read(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["oracle_sql", "queries"]


def queries():
    return {f.__name__: f for f in (op1_token_counts, op2_posting_lists, op3_suffix_dedup, op4_substring_dedup, op5_phrase_index, op6_weak_labels, op7_language_id, op8_wfst_pieces, op9_jaccard_join, op10_license_scan, op11_hard_negatives, op12_pii_spans, op13_importance_resampling, pipeline)}

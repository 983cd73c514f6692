"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Counted as part of the training-data subpackage; it needs it and says so by failing to import without it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.blocks import Scratch, shared_dir
from opsloom.llm.jaccard_join import shingle_components
from opsloom.llm.language_id import fit, recognised
from opsloom.llm.phrase_index import contamination
from opsloom.llm.suffix_dedup import suffix_dedup
from opsloom.llm.wfst_pieces import encode_decode

#: No SQL states a trained classifier or the piece transducer; the tests compare with a brute-force version.
ORACLE_SQL = None

ROW = "_row"
#: Intermediates of stages by their place; a stage's are of no more use once the next one reads what it has written.
_OPEN: dict[int, list[Scratch]] = {}


def _scratch(spark: SparkSession, place: int) -> Scratch:
    """A folder for a stage, after deleting those of the stages before it."""
    for k in [k for k in _OPEN if k < place]:
        for old in _OPEN.pop(k):
            old.clear()
    _OPEN.setdefault(place, []).append(new := Scratch(spark))
    return new


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a number of its own for each row, as ids may be null or repeat, the same whenever it is read.

    Rows read from files are numbered by file and place in it. Any others are written to the shared folder first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return scratch.write(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    spark = docs.sparkSession
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    rows = rows.join(F.broadcast(numbers), "_file")
    return rows.select(*docs.columns, F.shiftleft("_number", 40).bitwiseOR(F.col("_index")).alias(ROW))


def _without(rows: DataFrame, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` less those row numbers, which operators give back as ``doc_id``. They are written first, so that Spark
    knows their size: below its broadcast threshold texts are not shuffled, else both sides are."""
    return rows.join(scratch.write(dropped.select(F.col("doc_id").alias(ROW)), "dropped"), ROW, "left_anti").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised (``und``) go."""
    return recognised(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays (the first row of it, a null id last)."""
    scratch = _scratch(spark, 1)
    rows = _keyed(docs, scratch)
    groups = scratch.write(shingle_components(rows, key=ROW, scratch=scratch).select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    least = rows.select(ROW, "doc_id").join(groups, ROW).groupBy("component_id").agg(F.min(order)[ROW].alias("least"), F.count("*").alias("n")).where("n > 1")
    return _without(rows, groups.join(least, "component_id").where(F.col(ROW) != F.col("least")).select(F.col(ROW).alias("doc_id")), scratch)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur anywhere else are cut out; what has no text left goes."""
    scratch = _scratch(spark, 2)
    rows = _keyed(docs, scratch)
    kept = suffix_dedup(rows, key=ROW, with_text=True, scratch=scratch).where("n_removed = 0 or n_removed < n_bytes").select(F.col("doc_id").alias(ROW), F.col("kept_text").alias("_text"))
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in docs.columns else {})
    return rows.join(kept, ROW).withColumns(new).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    scratch = _scratch(spark, 3)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs, scratch)
    return _without(rows, contamination(rows, items, key=ROW, scratch=scratch).where("contaminated"), scratch)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, and whether it decodes to itself."""
    _scratch(spark, 4)
    return encode_decode(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written to the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

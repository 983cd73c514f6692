"""Exact length histogram of documents by encoded length.

Documents are encoded once and aggregated to (length, documents) inside each task, then summed by length;
suffix sums over that histogram answer, for every context limit at once, how many documents and tokens lie
at or above it, what is left when each document is cut there, and which quantile it is. The sums run in two
levels (stretches of ``STRETCH`` lengths, then inside a stretch), so no task gets more than the number of
stretches or one stretch of lengths.

Defined results: null and empty texts have length 0; repeated rows count again; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Scratch

STRETCH = 1024


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_counts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): whole texts encoded, counted inside tasks, then summed."""
    own_path, own_pattern = default_ranks() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern

    def count(batches):
        enc, seen = encoding(path, pattern), Counter()
        for batch in batches:
            seen.update(len(enc.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """A row for each length L that occurs: n_docs of it, docs_at_least and tokens_at_least (length L or more),
    docs_up_to and tokens_up_to, truncated_total (tokens left if all are cut at L), quantile (share of
    documents of length L or less), total_docs, total_tokens."""
    h = counts.withColumn("stretch", F.expr(f"n_tokens div {STRETCH}")).withColumn("tokens", F.expr("n_tokens * n_docs"))
    behind = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = h.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    tops = tops.select("stretch", *[F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(f"{c}_behind") for c in "dt"], *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"])
    inside = Window.partitionBy("stretch").orderBy(F.desc("n_tokens"))
    out = h.join(tops, "stretch").withColumns({"docs_at_least": F.sum("n_docs").over(inside) + F.col("d_behind"), "tokens_at_least": F.sum("tokens").over(inside) + F.col("t_behind")})
    up_to = {"docs_up_to": F.expr("d_all - docs_at_least + n_docs"), "tokens_up_to": F.expr("t_all - tokens_at_least + tokens")}
    out = out.withColumns(up_to).withColumns({"truncated_total": F.expr("tokens_up_to + n_tokens * (docs_at_least - n_docs)"), "quantile": F.col("docs_up_to") / F.col("d_all")})
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_up_to", "tokens_up_to", "truncated_total", "quantile", F.col("d_all").alias("total_docs"), F.col("t_all").alias("total_tokens"))


def token_histogram(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The sums over all documents; lengths are written once and read twice."""
    scratch = scratch or Scratch(docs.sparkSession)
    return suffix_sums(scratch.write(length_counts(docs, text, path, pattern), "lengths"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row: what the sums say of a context limit that need not occur as a length."""
    rows = sums.where(F.col("n_tokens") <= limit).groupBy().agg(F.max_by(F.struct("docs_up_to", "tokens_up_to", "total_docs", "total_tokens"), "n_tokens").alias("r"))
    all_docs = sums.groupBy().agg(F.max("total_docs").alias("n"))
    return rows.crossJoin(all_docs).select(F.lit(limit).alias("context_limit"), F.expr("coalesce(r.docs_up_to, 0)").alias("docs_up_to"), F.expr(f"coalesce(r.tokens_up_to, 0) + {limit} * (n - coalesce(r.docs_up_to, 0))").alias("truncated_total"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share ``q`` of the documents does not exceed."""
    return sums.where(F.col("quantile") >= q).groupBy().agg(F.min("n_tokens").alias("n_tokens"))

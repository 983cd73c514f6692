"""Target-distribution importance resampling without exploding what is scored.

A document's features are its runs of 1 to ``longest`` consecutive words; a feature's bucket is its checksum modulo
``buckets``. Two steps read the texts, both in JVM expressions only:

* *Counts.* Each task counts its buckets before anything moves, so a task sends ``buckets`` totals at most, whatever
  it read and however often a word occurs. ``buckets`` gains come to the driver: a bound by parameter.
* *Scores.* Higher-order functions turn a text into its array of buckets and add up ``element_at`` of one literal array of
  gains, so no feature ever becomes a row. What is written is one narrow row a document.

The draw takes the highest scores. A score lies within a range that the two logarithms bound (some 200,000 whole
numbers at 64-bit counts), so counting documents by score gives a table of bounded size; its suffix sums in two levels
(stretches of ``STRETCH`` scores, then scores) tell how many documents lie above each score. Only documents of the drawn
scores are sorted, each score by itself, and no task sorts all of them.

Defined results: a null or empty text has no feature, weight 0 and no part in the draw; a null id is hashed as the empty
text and comes last among equal scores; equal scores of equal ids go by weight, then by number of features; rows that
are equal in all of these are each other's equals and get different ranks; a target or corpus without words leaves gains of smoothing
alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Scratch

#: Fixed value: what parts words, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRETCH = 1024


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, GAP), lambda w: w != "")  # a third of the time of extracting what matches


def buckets_of(ws: Column, longest: int, buckets: int) -> Column:
    """The bucket of each run of 1 to ``longest`` words, repeats kept."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def of_runs(starts: Column, n: int) -> Column:
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(ws, i, n), " ")))

    found = F.transform(ws, bucket)
    for n in range(2, longest + 1):
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        found = F.concat(found, of_runs(starts, n))
    return found


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: totals of every feature of every document."""
    ws = docs.select(words(F.col(text)).alias("ws"))
    return ws.select(F.explode(buckets_of(F.col("ws"), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, gain, for every bucket: 1000 times the logarithm of the smoothed target share over the corpus share, floored."""
    side = lambda df, name: bucket_counts(df, text, longest, buckets).withColumns({x: F.col("n") if x == name else F.lit(0).cast("long") for x in ("s", "t")})
    found = side(docs, "s").unionByName(side(target, "t")).select("bucket", "s", "t")
    found = found.unionByName(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    found = found.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = found.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return found.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def scored(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document; ``gains`` become one literal array of the plan."""
    literal = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    ws = docs.select(F.col(key).cast("long").alias("doc_id"), words(F.col(text)).alias("ws"))
    rows = ws.select("doc_id", F.size("ws").cast("long").alias("n_words"), buckets_of(F.col("ws"), longest, len(gains)).alias("found"))
    total = F.aggregate("found", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), total.alias("total"))
    weight = F.expr("case when n_features = 0 then 0L else (total - pmod(total, n_features)) div n_features end")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def above(drawable: DataFrame) -> DataFrame:
    """score, n_above, n_all: of the rows, how many score higher than each score that occurs, and how many there are."""
    count = drawable.groupBy("score").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("score") / STRETCH))
    down = lambda w, by: w.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    stretches = count.groupBy("stretch").agg(F.sum("n").alias("m"))
    whole = Window.partitionBy(F.lit(0))
    stretches = stretches.select("stretch", F.coalesce(F.sum("m").over(down(whole, "stretch")), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n_all"))
    inside = F.coalesce(F.sum("n").over(down(Window.partitionBy("stretch"), "score")), F.lit(0))
    return count.withColumn("inside", inside).join(F.broadcast(stretches), "stretch").select("score", (F.col("before") + F.col("inside")).alias("n_above"), "n_all")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, scratch: Scratch | None = None) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and its rank among those drawn (null: not drawn)."""
    scratch = scratch or Scratch(docs.sparkSession)
    gains = [r.gain for r in bucket_gains(docs, target, text, longest, buckets).orderBy("bucket").collect()]
    rows = scratch.write(scored(docs, gains, key, text, longest, seed), "scored")
    may = F.col("n_words") >= least_words
    places = scratch.write(above(rows.where(may)), "places")
    # at most as many rows as there are scores: some 200,000 by the bound on gains and noise
    rows = rows.join(F.broadcast(places), "score", "left").withColumn("n_drawn", F.expr(f"{percent} * n_all div 100"))
    reached = may & (F.col("n_above") < F.col("n_drawn"))
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features"))
    drawn = rows.where(reached).withColumn("rank", F.col("n_above") + inside)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("n_drawn"), F.col("rank")))
    rest = rows.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

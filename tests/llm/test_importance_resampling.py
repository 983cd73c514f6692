import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsloom.llm.importance_resampling import bucket_gains, resample, scored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def features(text, longest):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, x in docs for f in features(x, longest)[1])
    t = Counter(bucket(f) for _, x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        ws, found = features(x, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws) >= least_words])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=str)


def run(spark, docs, target, **how):
    a = spark.createDataFrame(docs, SCHEMA).withColumns({"bucket": F.lit("x"), "score": F.lit(1), "ws": F.lit(2)})
    out = resample(a, spark.createDataFrame(target, SCHEMA), **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    return sorted([tuple(r) for r in out.collect()], key=str)


DOCS = [(i, f"Straße {'ab' * (i % 7)} x{i % 5}, École " * (i % 23)) for i in range(400)]
TARGET = [(1, "straße école x1 x1 x2"), (2, None), (3, "École!")]


@pytest.mark.parametrize("how", [{}, {"longest": 2}, {"longest": 3, "buckets": 50, "percent": 55, "least_words": 4}, {"percent": 100, "least_words": 0}])
def test_same_as_plain_loops(spark, how):
    assert run(spark, DOCS, TARGET, **how) == plain(DOCS, TARGET, **how)


def test_nulls_repeats_ties_and_long_texts(spark):
    long = "wörter über alles 12 " * 30_000
    docs = [(1, None), (2, ""), (None, "a b " * 30), (None, "c d " * 30), (3, "...!"), (4, long), (5, "a b " * 30), (5, "a b " * 30), (5, "q " * 40), (6, "\U0001d7d8 x " * 21), (7, "AB ab Ab " * 9)] * 3
    for percent in (10, 60, 100):
        assert run(spark, docs, TARGET, percent=percent) == plain(docs, TARGET, percent=percent)


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == [] and run(spark, [], []) == []
    docs = [(1, None), (2, "a " * 20), (3, "b " * 30)]
    assert run(spark, docs, [], percent=50) == plain(docs, [], percent=50)


def test_scores_are_not_exploded(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    plan = scored(docs, [1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan
    assert bucket_gains(docs, spark.createDataFrame(TARGET, SCHEMA)).count() == 10_000

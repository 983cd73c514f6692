import hashlib
import re
from collections import Counter

import pytest

from opsloom.llm.substring_dedup import substring_dedup


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, block string") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, width).collect()], key=str)


EDGE = [(1, None), (2, ""), (3, "a b c d e f"), (4, "x a b c d e"), (4, "x a b c d e"), (None, "q q q q q q q q q"), (5, "é ü ß c d e f"), (6, " \t a  b\nc "), (7, "a b c")]


@pytest.mark.parametrize("width", [1, 3, 5])
def test_edges(spark, width):
    assert run(spark, EDGE, width) == brute(EDGE, width)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, [], 3) == []
    rows = [(d, t, 7, "x") for d, t in EDGE]
    assert run(spark, rows, 3) == brute(EDGE, 3)


def test_whole_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows, 35)
    assert got == brute(rows, 35) and sum(r[2] for r in got) > 1000

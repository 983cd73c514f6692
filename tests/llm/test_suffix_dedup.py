import hashlib
import random
from collections import Counter

import pytest

from opsloom.llm import suffix_dedup as S


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, hot=2048):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "'x' as payload")
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df, length, hot=hot).collect()], key=str)


def made(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = [(1, None), (2, ""), (None, passages[0]), (3, "z" * 500), (3, "z" * 500), (4, "ab" * 300)]
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(passages))
        rows.append((10 + i, " ".join(parts)))
    return rows + rows[-3:]


@pytest.mark.parametrize(("length", "hot"), [(30, 2048), (60, 2048), (60, 2), (200, 3)])
def test_against_brute_force(spark, length, hot):
    rows = made(length)
    assert run(spark, rows, length, hot) == brute(rows, length)


def test_empty_table(spark):
    assert run(spark, [], 200) == []


def test_whole_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows, 200)
    assert got == brute(rows, 200) and sum(r[2] for r in got) > 1000


def test_columns_alone():
    """Hot handling aside: one shard's construction against counting."""
    import numpy as np
    import zstandard

    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(8, 20))) for _ in range(400)]
    head = lambda own: b"".join([np.uint32(len(own)).tobytes(), np.zeros(len(own), np.uint64).tobytes(), np.array([0] * len(own), np.uint16).tobytes(), np.array([len(t) for t in own], np.uint16).tobytes(), np.zeros(len(own), np.uint8).tobytes(), *own])
    parts = [zstandard.ZstdCompressor().compress(head(texts[:150])), zstandard.ZstdCompressor().compress(head(texts[150:]))]
    seen = Counter((i, t[i : i + 8]) for t in texts for i in range(len(t) - 7))
    want = [seen[i, t[i : i + 8]] > 1 for t in texts for i in range(len(t) - 7)]
    n = sum(len(t) - 7 for t in texts[:150])
    got, _ = S.repeated_columns(parts, 8)
    bits = np.concatenate([np.unpackbits(np.frombuffer(g, np.uint8), count=c) for g, c in zip(got, (n, len(want) - n))]).astype(bool)
    assert bits.tolist() == want

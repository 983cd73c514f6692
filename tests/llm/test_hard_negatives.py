import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import hard_negatives as h
from opsloom.llm.hard_negatives import Turned, exact, hard_negatives, rotation, survivors

SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, every=100, positives=5, negatives=5, percent=80, scale=256):
    cut = lambda x: max(-h.LAST, min(h.LAST, x))
    kept = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [cut(math.floor(scale * x)) if math.isfinite(scale * x) else math.copysign(1, x) > 0 and h.LAST or -h.LAST for x in v]))
    out = []
    for i, label, v in kept:
        if i % every:
            continue
        scored = sorted((-cut(sum(p * q for p, q in zip(v, w))), j, other) for j, other, w in kept if j != i and len(w) == len(v))
        for s, p, other in [x for x in scored if x[2] == label][:positives]:
            may = [(n, j) for n, j, other in scored if other != label and percent * -s <= 100 * -n <= 100 * -s]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(may[:negatives])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"d": F.lit("x"), "part": F.lit(1), "akey": F.lit(2)})
    got = hard_negatives(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(n, d, seed, kinds=4, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, d)) * np.linspace(2, 0.1, d)
    at = rng.integers(0, kinds, n)
    x = centres[at] + spread * rng.normal(size=(n, d)) * np.linspace(2, 0.1, d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, kinds)) if i % 3 == 0 else int(at[i]), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("d,every", [(16, 10), (5, 3), (1, 20), (64, 7)])
def test_same_as_plain_loops(spark, d, every):
    rows = vectors(400, d, d)
    got = run(spark, rows, every=every)
    assert got == plain(rows, every=every) and len(got) > 50


def test_other_parameters(spark):
    rows = vectors(300, 8, 3)
    how = dict(every=5, positives=3, negatives=7, scale=1000)
    assert run(spark, rows, least_percent=50, **how) == plain(rows, percent=50, **how)


def test_small_groups_and_stretches(spark, monkeypatch):
    for name, value in (("STRETCH", 16), ("GROUP_BYTES", 4096), ("ANCHOR_BYTES", 1024), ("AT_ONCE", 3)):
        monkeypatch.setattr(h, name, value)
    rows = vectors(600, 12, 5)
    assert run(spark, rows, every=4) == plain(rows, every=4)


def test_defined_results(spark):
    rows = vectors(200, 6, 9)
    rows += [(None, 1, [1.0] * 6), (100, None, [1.0] * 6), (100, 1, None), (100, 1, [1.0, None]), (200, 1, [math.nan] * 6), (300, 1, [math.inf] * 6)]
    rows += [(i, 2, [0.0] * 6) for i in range(1000, 1020)]  # zero vectors, some of them anchors
    rows += [(i, i % 2, []) for i in range(2000, 2012)]  # empty ones: all score 0
    rows += rows[:40]  # repeated rows, anchors among them
    rows += [(5000, 1, [1.0] * 3), (5001, 2, [1.0] * 3)]  # no positive
    rows += [(5100, 1, [1.0, -2.0]), (5101, 1, [-1.0, 2.0]), (5102, 2, [-1.0, 2.0])]  # a positive of negative score
    assert run(spark, rows, every=20) == plain(rows, every=20)
    assert run(spark, []) == [] and run(spark, [(0, 1, [1.0])]) == []


def test_very_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3), (10.0 ** rng.integers(0, 25) * rng.normal(size=4)).tolist()) for i in range(120)]
    rows += [(i, int(i % 3), (1e9 + rng.integers(-3, 4, 4) / 256).tolist()) for i in range(200, 260)] + [(300, 1, [1e308] * 4), (301, 1, [1e308] * 4), (302, 2, [-1e308, 1e308, 1e308, 1e308])]
    assert run(spark, rows, every=4) == plain(rows, every=4)


def test_hot_vector_and_hot_label(spark):
    rows = vectors(200, 8, 4)
    rows += [(1000 + i, 1 if i % 2 else 2, rows[3][2]) for i in range(600)]
    got = run(spark, rows, every=50)
    assert got == plain(rows, every=50)


def test_bounds_discard_most_and_lose_none(spark):
    rows = vectors(3000, 32, 1, kinds=20, spread=0.3)
    x = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    axes = rotation((x.T @ x).astype(float))
    assert np.allclose(axes @ axes.T, np.eye(32), atol=1e-9)
    a, b = Turned(x[:64], axes), Turned(x, axes)
    whole = x[:64] @ x.T
    need = np.sort(whole, axis=1)[:, -6]
    i, j = survivors(a, b, need, whole.max(axis=1))
    assert (exact(a, i, b, j) == whole[i, j]).all()
    assert {(p, q) for p, q in zip(*np.nonzero(whole >= need[:, None]))} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 0.02 * whole.size

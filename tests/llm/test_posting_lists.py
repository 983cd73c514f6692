import numpy as np

from opsloom.llm.posting_lists import nearest


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = [v for _, v in ok]
    ids = np.array([i for i, _ in ok])
    out = {}
    for q, v in ok:
        if q % every == 0:
            s = [np.cumsum(y * v)[-1] if len(y) == len(v) else None for y in x]
            best = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q and s[i] is not None)[:k]
            out[q] = [(int(i), -s) for s, i in best]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_is_exact_with_edges(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tolist()) for i in range(90)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    odd = [(200, None), (220, []), (240, [0.0] * 4), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>").selectExpr("*", "1 as score")
    want, have = brute(rows, 20, 20), got(nearest(df))
    assert {q: [i for i, _ in x] for q, x in have.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(want[q], have[q]))
    assert nearest(df.limit(0)).count() == 0
    assert [len(x) for x in got(nearest(df.where("vec_id in (0, 3, 5)"))).values()] == [2]


def test_recall_on_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, have = brute(rows, 20, 20), got(nearest(df, probe=8))
    full = got(nearest(df))
    recall = lambda x: np.mean([len({i for i, _ in want[q]} & {i for i, _ in x[q]}) / 20 for q in want])
    print("recall", recall(have), recall(full))
    assert set(full) == set(want) and recall(full) >= 0.9


def test_recall_with_a_thousand_lists(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = np.random.default_rng(5).normal(size=(1024 * 128, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    df, ids = spark.read.parquet(str(tmp_path / "e.parquet")), np.arange(0, len(x), 1000)
    s = x[ids] @ x.T
    s[np.arange(len(ids)), ids] = -1
    want = dict(zip(ids.tolist(), np.argpartition(-s, 20, axis=1)[:, :20].tolist(), strict=True))
    recall = lambda have: np.mean([len(set(want[q]) & {i for i, _ in have.get(q, [])}) / 20 for q in want])
    found = recall(got(nearest(df, every=1000)))
    print("recall", found)
    assert found >= 0.9


def test_ties_between_different_vectors(spark):
    """Eighty-six different vectors of one score, across lists; the smaller ids win. A vector far longer than the rest."""
    import itertools

    signs = list(itertools.product((-1.0, 1.0), repeat=7))[:86]
    rows = [(20, [1.0] + [0.0] * 7)] + [(21 + i, [0.5, *s]) for i, s in enumerate(signs)] + [(i, [-1.0] + [0.0] * 7) for i in range(1, 20)]
    want = brute(rows, 20, 20)
    assert [i for i, _ in want[20]] == list(range(21, 41))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(nearest(df)) == want
    more = rows + [(300, [1000.0] + [0.0] * 7)]
    assert got(nearest(spark.createDataFrame(more, df.schema))) == brute(more, 20, 20)


def test_dimensions_apart(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=3 + 2 * (i % 3 == 0)).tolist()) for i in range(130)]
    assert got(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == brute(rows, 20, 20)


def test_best_of_against_sorting():
    from opsloom.llm.posting_lists import best_of

    r = np.random.default_rng(8)
    x, z, least = r.integers(-2, 3, (500, 6)).astype(float), r.integers(-2, 3, (70, 6)).astype(float), r.permutation(500)
    row, col, score = best_of(x, least, z, 21)
    for i in range(70):
        want = sorted((-float(x[j] @ z[i]), int(least[j]), j) for j in range(500))[:21]
        assert [(-s, int(least[c]), c) for c, s in zip(col[row == i].tolist(), score[row == i].tolist())] == want


def test_graph_finds_the_nearest_without_meeting_all():
    from opsloom.llm.posting_lists import Graph

    c = np.random.default_rng(2).normal(size=(4000, 6))
    g, q = Graph(c), np.random.default_rng(9).normal(size=(50, 6))
    near, d = g.search(q, 40)
    want = np.argsort(((q[:, None] - c[None]) ** 2).sum(axis=2), axis=1)[:, :40]
    assert np.mean([len(set(a) & set(b)) / 40 for a, b in zip(near.tolist(), want.tolist())]) > 0.97
    assert (np.diff(d, axis=1) >= 0).all() and g.links.shape[1] == 33

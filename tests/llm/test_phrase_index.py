import hashlib
import re

import pytest

from opsloom.llm.phrase_index import build_index, contamination, proximity


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute(docs, items, width):
    out, windows = [], {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).update([] if i is None else [str(i)])
    sizes = {len(x) for x in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, width, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as n_words")
    return sorted([tuple(r) for r in contamination(d, spark.createDataFrame(items, "item_id long, text string"), width, **more).collect()], key=str)


DOCS = [(1, None), (2, ""), (3, "A b, C d-e f g"), (4, "a b c a b c d e f"), (4, "a b c a b c d e f"), (None, "zé É zé"), (5, "... !"), (6, "g f e d c b a"), (7, "a")]
ITEMS = [(1, "a b c"), (10, "B C D e f"), (2, None), (3, ""), (4, "ZÉ é zé"), (5, "zÉ É zé"), (9, "a b c"), (9, "a b c"), (11, "b c d"), (None, "f g"), (None, "c d e"), (12, "x a b c a b c d e f y")]


@pytest.mark.parametrize("width", [1, 3, 10])
@pytest.mark.parametrize("slice_windows", [4000, 3])
def test_edges(spark, width, slice_windows):
    assert run(spark, DOCS, ITEMS, width, slice_windows=slice_windows) == brute(DOCS, ITEMS, width)


def test_long_texts_words_and_items(spark):
    """Texts of more than a block, words of more than a kilobyte that linear hashes confuse, items of many windows."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(300_000))
    docs = [(1, f"{t} one two"), (2, f"{u} one two"), (3, long), (4, " ".join(long.split()[5000:5020]))]
    items = [(1, f"{t} one two"), (2, " ".join(long.split()[4990:5400])), (3, " ".join(long.split()[5010:5013]))]
    assert run(spark, docs, items, 3, slice_windows=150) == brute(docs, items, 3)


def test_empty(spark):
    assert run(spark, [], ITEMS, 3) == []
    assert run(spark, DOCS, [], 3) == brute(DOCS, [], 3)


def test_whole_fixture(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = run(spark, docs, items, 10)
    assert got == brute(docs, items, 10) and sum(r[5] for r in got) > 10


def test_proximity(spark):
    index = build_index(spark.createDataFrame([(1, "x red y green z"), (2, "green a b c red"), (3, "red"), (4, None), (5, "green red")], "doc_id long, text string"))
    found = lambda slop: sorted(tuple(r) for r in proximity(index, "Red green", slop).collect())
    assert found(0) == [(5, 0)]
    assert found(1) == [(1, 1), (5, 0)]
    assert found(3) == [(1, 1), (2, 0), (5, 0)]

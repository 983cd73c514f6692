import random
import re

import pytest

from opsloom.llm.jaccard_join import shingle_components


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def run(spark, rows, n=4, percent=85, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_shingles", "'x' as sid")
    return sorted([tuple(r) for r in shingle_components(df, n, percent, **more).collect()], key=str)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (None, "a b c d e"), (5, "a b c d e"), (6, " \n ")]
    line = [word() for _ in range(12)]
    for g in range(25):
        base = [word() for _ in range(r.choice([6, 30, 80, 300]))]
        if g % 3 == 0:
            base = line + base
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            rows.append((r.randrange(10, 5000), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (2, 70, 2), (1, 50, 3)])
def test_against_brute_force(spark, n, percent, seed):
    rows = made(seed)
    got = run(spark, rows, n, percent)
    assert got == brute(rows, n, percent) and len({g[2] for g in got}) < len(got)


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (2, 60, 2)])
def test_hot_lists_in_chunks(spark, n, percent, seed):
    """One group of near copies, and sets that share a line without linking, over chunks of eight sets."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, "one two")]
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        rows.append((6000 + k, " ".join(w)))
    got = run(spark, rows, n, percent, list_sets=8)
    assert got == brute(rows, n, percent) and 2 < len({g[2] for g in got}) < len(got)


def test_visitors_meet_what_a_chunk_holds():
    """Every pair of a hot list that is in two components is met in one chunk or another, whatever the cut."""
    import numpy as np
    import pandas as pd

    from opsloom.llm.jaccard_join import Lists, _bitmap

    r = np.random.default_rng(5)
    rows = pd.DataFrame({"sid": [bytes([i]) for i in range(40)], "size": 20, "pos": 0, "map": [_bitmap(np.arange(20, dtype=np.uint64), 20).tobytes()] * 40})
    rows["label"] = [bytes([k]) for k in r.choice(3, 40, p=[0.7, 0.2, 0.1])]
    chunk, guests, found = r.integers(0, 3, 40), rows[rows["label"] != b"\0"], set()
    for c in range(3):
        x, label = Lists.of_chunk(rows[chunk == c], 85, guests)
        found |= {tuple(sorted((x.sids[a], x.sids[b]))) for a, b in x.across(label)}
    assert found == {(a, b) for a, la in zip(rows["sid"], rows["label"]) for b, lb in zip(rows["sid"], rows["label"]) if a < b and la != lb}


def test_counts_of_a_block_are_whole(spark):
    """One block of 400 near copies: a list of all of them is dealt by its true size, not by what a byte holds."""
    import glob
    import pickle

    from opsloom.llm import blocks as B

    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base[:20] + [f"y{k}a", f"y{k}b"] + base[22:] if r.random() < 0.9 else base[:40] + [f"y{k}"] * 30)) for k in range(400)]
    scratch = B.Scratch(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted([tuple(x) for x in shingle_components(df, scratch=scratch, list_sets=32).collect()], key=str)
    assert got == brute(rows, 4, 85)
    hot = spark.read.parquet(*glob.glob(f"{scratch.folder.removeprefix('file://')}/listed_*/kind=3")).select("data").collect()
    token, chunk, chunks = (sum((list(pickle.loads(x.data)[k]) for x in hot), []) for k in range(3))
    sizes = {}
    for cell in zip(token, chunk):
        sizes[cell] = sizes.get(cell, 0) + 1
    assert max(chunks) >= 8 and max(sizes.values()) < 4 * 32


def test_more_partitions_than_buckets(spark, monkeypatch):
    from opsloom.llm import blocks as B
    from opsloom.llm.suffix_dedup import suffix_dedup

    rows = made(5)
    wide = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    plain = sorted(map(str, suffix_dedup(wide, 40).collect()))
    monkeypatch.setattr(B, "MAX_BUCKETS", 3)
    blocks = B.to_blocks(wide)
    assert blocks.buckets == 3 and len(set(B.bucket_of([r.block for r in blocks.rows.select("block").collect()], 3).tolist())) == 3
    assert sorted([tuple(r) for r in shingle_components(wide).collect()], key=str) == brute(rows, 4, 85)
    assert sorted(map(str, suffix_dedup(wide, 40).collect())) == plain


def test_empty_table(spark):
    assert run(spark, []) == []


def test_whole_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    assert got == brute(rows, 4, 85) and sum(d != c for d, _, c in got) > 10


def test_words_that_defeat_linear_hashes(spark):
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2**64."""
    from opsloom.llm.substring_dedup import substring_dedup

    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {t} y z w v"), (2, f"x {u} y z w v"), (3, " ".join(f"{t}{k}" for k in range(35))), (4, " ".join(f"{u}{k}" for k in range(35)))]
    rows += [(5, " ".join("ab"[bin(i).count("1") % 2] for i in range(2048))), (6, " ".join("ba"[bin(i).count("1") % 2] for i in range(2048)))]
    assert run(spark, rows) == brute(rows, 4, 85)
    docs = spark.createDataFrame(rows[:4], "doc_id long, text string")
    assert sum(r.n_removed for r in substring_dedup(docs).collect()) == 0
    assert sum(r.n_removed for r in substring_dedup(spark.createDataFrame(rows[4:], "doc_id long, text string"), 1025).collect()) == 0


def test_hashes_of_words_and_runs():
    import numpy as np

    from opsloom.llm import blocks as B

    words = [b"", b"a", b"a\0", b"b", b"abcdefgh", b"abcdefg", b"abcdefghi", b"x" * 256, b"x" * 257, b"y" + b"x" * 256, b"a"]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    h = B.hash_words(buf, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words) - 1 and h[1] == h[-1]
    other = B.hash_words(buf, ends - [len(w) for w in words], ends, 1)
    assert not set(h.tolist()) & set(other.tolist())
    r = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64)
    for n in (1, 2, 3, 4, 5, 7, 8, 35):
        runs, seen = B.hash_runs(B.mix(r), n), {}
        assert len(runs) == 500 - n + 1
        for i, x in enumerate(runs.tolist()):
            assert seen.setdefault(x, tuple(r[i : i + n])) == tuple(r[i : i + n])
        assert len(seen) == len({tuple(r[i : i + n]) for i in range(500 - n + 1)})


def test_blocks_of_a_task_are_of_one_bucket(spark):
    import numpy as np

    from opsloom.llm import blocks as B

    some = [-5, 0, 1, 2**40, 2**63 - 1]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in some], "x long").selectExpr("pmod(hash(x), 7)").collect()]
    assert B.bucket_of(np.array(some), 7).tolist() == want
    blocks = B.to_blocks(spark.range(3000, numPartitions=6).selectExpr("id as doc_id", "repeat('word ', 50) as text"), block_bytes=20_000)
    files = blocks.rows.selectExpr("_metadata.file_name as f", "block").collect()
    assert len({r.f for r in files}) == 6 < len(files) and len({r.block for r in files}) == len(files)
    replies = spark.range(1).selectExpr("0L as block", "0 as shard", "binary('x') as reply").unionByName(blocks.rows.selectExpr("block", "1", "binary('y')").toDF("block", "shard", "reply"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    joined = B.with_replies(blocks, t=replies)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and joined.count() == len(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

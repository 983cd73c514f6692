"""Texts longer than a block, whole, by plain versions."""

import hashlib
import random
import re
from collections import Counter

from opsloom.llm.blocks import BLOCK_BYTES
from opsloom.llm.jaccard_join import shingle_components
from opsloom.llm.substring_dedup import substring_dedup
from opsloom.llm.suffix_dedup import suffix_dedup


def made():
    """A text of over a block with a passage that it repeats itself, one that a short text shares, a near copy of it all."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    long = [word() for _ in range(BLOCK_BYTES // 5)]
    passage, shared = [word() for _ in range(60)], [word() for _ in range(70)]
    long[1000:1060], long[200_000:200_060], long[-70:] = passage, passage, shared
    near = list(long)
    for _ in range(300):
        near[r.randrange(len(near))] = "other"
    alone = [word() for _ in range(BLOCK_BYTES // 5)]
    rows = [(7, " ".join(long)), (3, " ".join(near)), (5, "x " + " ".join(shared) + " y"), (9, " ".join(alone)), (4, None)]
    assert all(len(t) > BLOCK_BYTES for _, t in (rows[0], rows[1], rows[3]))
    return rows


def test_whole_long_texts(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # op9: the near copies are one component
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(docs).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[d] == (len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}), 3 if d in (3, 7) else d)
    # op4: windows of words
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen = Counter(hash(tuple(w[i : i + 35])) for w in words.values() for i in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - 34):
            if seen[hash(tuple(w[i : i + 35]))] > 1:
                gone[i : i + 35] = b"\1" * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    # op3: strings of bytes
    raw = {d: (t or "").encode() for d, t in rows}
    seen = Counter(hash(t[i : i + 200]) for t in raw.values() for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffix_dedup(docs).collect()}
    for d, t in raw.items():
        gone, until = bytearray(len(t)), 0
        for i in range(len(t) - 199):
            if seen[hash(t[i : i + 200])] > 1:
                a = max(i, until)
                gone[a : i + 200] = b"\1" * (i + 200 - a)
                until = i + 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(t), sum(gone), hashlib.sha256(kept).hexdigest())

"""Substring dedup with a Count-min prefilter.

Pass 1: every block sketches its windows of ``width`` consecutive words in two hash rows; the partition
sketches are merged shard by shard (a shard is a range of counters). A window's estimate, the lesser of its
two counters, is never below its true count. Pass 2: only windows estimated to occur twice or more send
their digest and are grouped exactly. The digest has 128 bits, from two hashes of each word's bytes that share
nothing, and no part of it is a linear form of letters or words. Nothing that repeats is lost; what the sketch
overestimates is sorted out by pass 2. The counters grow with the corpus (about four a window and row), spread
over shards.

Defined results: a null or empty text has no words (n_words 0, hash of the empty string); a text shorter
than a window loses nothing; repeated rows and repeated ids are separate documents; an empty table gives an
empty result. Only the id and the text column are read, so other columns and their names do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks as B

SCHEMA = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
U = np.uint64


def _windows(b: B.Block, width: int):
    """Word starts and ends, document of each word, window starts (word numbers) and two hashes of each."""
    starts, ends = B.find_words(b.buf, B.BLANK)
    doc = np.searchsorted(b.start, starts, "right") - 1
    n = len(starts) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return starts, ends, doc, np.zeros(0, np.int64), none, none
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return starts, ends, doc, whole, *(B.hash_runs(B.hash_words(b.buf, starts, ends, seed), width)[whole] for seed in (0, 1))


def _cells(h: np.ndarray, row: int, shards: int, bits: int):
    """Distinct (shard, counter) keys of a block in one sketch row, each window's place among them, and whether it came twice."""
    key = (B.spread(h, shards).astype(U) + U(row * shards)) << U(32) | (h & U((1 << bits) - 1))
    key, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return key, back, count > 1


def merge_sketches(parts: list[bytes]) -> tuple[list[bytes], int]:
    """Add up the blocks' sketches of one shard; answer each with a bit for each counter it touched: two or more."""
    got = [B.unpack_sorted(p) for p in parts]
    cells, back, = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    count = np.bincount(back, np.concatenate([1 + f for _, f in got]), len(cells))
    twice, at, out = (count >= 2)[back], 0, []
    for c, _ in got:
        out.append(np.packbits(twice[at : at + len(c)]).tobytes())
        at += len(c)
    return out, 0


def group_digests(parts: list[bytes]) -> tuple[list[bytes], int]:
    """Group 128-bit digests exactly; answer with a bit for each: it occurs more than once."""
    sizes = [len(p) // 17 for p in parts]
    a, c = (np.concatenate([np.frombuffer(p, U, n, 8 * n * k) for p, n in zip(parts, sizes, strict=True)]) for k in (0, 1))
    many = np.concatenate([np.frombuffer(p, np.uint8, n, 16 * n) for p, n in zip(parts, sizes, strict=True)])
    order = np.lexsort((c, a))
    a, c = a[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    twice = np.empty(len(a), bool)
    twice[order] = (np.bincount(group, 1 + many[order]) >= 2)[group]
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(twice[at : at + n]).tobytes())
        at += n
    return out, 0


def digest_keys(h1: np.ndarray, h2: np.ndarray, shards: int):
    """Distinct digests of a block in order of shard; each window's place among them; whether it came twice."""
    shard = B.spread(h1, shards)
    order = np.lexsort((h2, h1, shard))
    s, a, c = shard[order], h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    back = np.empty(len(a), np.int64)
    back[order] = group
    first = np.flatnonzero(new)
    return s[first], a[first], c[first], back, np.bincount(group, minlength=len(first)) > 1


def send_digests(h1, h2, shards):
    s, a, c, _, many = digest_keys(h1, h2, shards)
    for shard, x in B.by_shard(s):
        yield shard, a[x].tobytes() + c[x].tobytes() + many[x].astype(np.uint8).tobytes()


def read_digests(h1, h2, shards, replies: dict[int, bytes]) -> np.ndarray:
    s, a, _, back, _ = digest_keys(h1, h2, shards)
    twice = np.zeros(len(a), bool)
    for shard, x in B.by_shard(s):
        twice[x] = np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=x.stop - x.start)
    return twice[back]


def _estimated(hs, replies, shards: int, bits: int) -> np.ndarray:
    """Windows whose estimate is two or more."""
    out = np.ones(len(hs[0]), bool)
    for row, h in enumerate(hs):
        key, back, _ = _cells(h, row, shards, bits)
        bit = np.zeros(len(key), bool)
        for shard, x in B.by_shard((key >> U(32)).astype(np.int64)):
            bit[x] = np.unpackbits(np.frombuffer(replies[shard], np.uint8), count=x.stop - x.start)
        out &= bit[back]
    return out


def repeated_windows(blocks: B.Blocks, width: int):
    """Written answers from which each block knows its repeated windows, the number of shards and of counter bits."""
    shards = blocks.shards()
    # about a window for every six bytes; four counters a window, in powers of two
    bits = max(8, min(31, int(np.ceil(np.log2(max(1, blocks.n_bytes / shards / 6 * 4))))))

    def sketch(_, b, __):
        *_, h1, h2 = _windows(b, width)
        for row, h in enumerate((h1, h2)):
            key, _, many = _cells(h, row, shards, bits)
            for shard, x in B.by_shard((key >> U(32)).astype(np.int64)):
                yield shard, B.pack_sorted(key[x] & U(0xFFFFFFFF), many[x])

    def digests(_, b, replies):
        *_, h1, h2 = _windows(b, width)
        if len(h1):
            est = _estimated((h1, h2), replies["cell"], shards, bits)
            yield from send_digests(h1[est], h2[est], shards)

    cells = B.ask(blocks, sketch, merge_sketches, "sketch", 2 * shards)
    exact = B.ask(blocks, digests, group_digests, "exact", shards, cell=cells)
    return cells, exact, shards, bits


def substring_dedup(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False, scratch: B.Scratch | None = None) -> DataFrame:
    """Remove each word that a window of ``width`` words covers whose word sequence starts anywhere else too.

    One row a document: doc_id, n_words, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (the
    kept words joined by one space; null for null).
    """
    blocks = B.to_blocks(docs, key, text, scratch=scratch)
    cells, exact, shards, bits = repeated_windows(blocks, width)

    def remove(_, b, replies):
        starts, ends, doc, at, h1, h2 = _windows(b, width)
        gone = np.zeros(len(starts) + 1, np.int32)
        if len(at):
            est = _estimated((h1, h2), replies["cell"], shards, bits)
            found = np.flatnonzero(est)
            if len(found):
                hit = at[found[read_digests(h1[est], h2[est], shards, replies.get("exact", {}))]]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n = len(b.ids)
        n_words, n_removed = np.bincount(doc, minlength=n), np.bincount(doc[gone], minlength=n)
        first = gone.copy()
        first[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
        spans = np.bincount(doc[first], minlength=n)
        # kept words with one blank after each, then cut into documents
        put = np.zeros(len(b.buf) + 1, np.int8)
        put[starts[~gone]] += 1
        put[ends[~gone]] -= 1
        kept = np.cumsum(put[:-1], dtype=np.int8) > 0
        kept_ends = ends[~gone]
        out = b.buf.copy()
        out[kept_ends] = 32
        kept[kept_ends] = True
        out = out[kept].tobytes()
        sizes = np.bincount(doc[~gone], (ends - starts + 1)[~gone], n).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        texts = [out[a : max(a, z - 1)] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        frame = pd.DataFrame({"doc_id": pd.array(list(b.ids), "Int64"), "n_words": n_words, "n_removed": n_removed, "n_spans": spans, "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})
        if with_text:
            frame["kept_text"] = [None if r < 0 else t.decode("utf-8", "replace") for t, r in zip(texts, b.raw_lens, strict=True)]
        return frame

    return B.map_blocks(B.with_replies(blocks, cell=cells, exact=exact), remove, SCHEMA + ", kept_text string" * with_text)

"""Suffix-array dedup: column-wise construction over many documents at once.

Equal stretches of ``length`` bytes hold the same least-hashed ``K``-byte word at the same offset (their
anchor). Each document is therefore cut into segments, the maximal runs of windows with one anchor, and
segments meet by anchor hash. Inside a shard the collection of segments is built column-wise: each round
inserts one symbol per segment, from the last column to the first, and updates the collection's
Burrows-Wheeler order (the insertion is a stable sort by the new symbol, since the suffixes behind it are
already in order) and the common prefixes between neighbours (one more than the least common prefix
between their predecessors). The columns are aligned on the anchor and only suffixes of the same column can
share a window, so a round touches each segment once instead of all suffixes so far, and rounds number at
most two windows whatever the length of a document. The column files are sequential: segments travel as
packed shuffle rows, and earlier columns are final as soon as they are written. A window is repeated exactly
if its suffix shares ``length`` bytes with a neighbour in that order, or its segment came more than once.

Two exchanges come before, at every size, so that only text that may repeat is moved: anchors that occur once drop
out, and for an anchor that over ``HOT`` different segments share (a line common to a third of all documents with
other text around it) windows whose digest occurs once drop out, and what is left is split by a hash of the
bytes that all windows of a quarter of the offsets share (157 of 200). ``HOT`` bounds what one anchor brings to a
task; no result depends on it.

Defined results: a null or empty text has 0 bytes and the hash of the empty string; texts shorter than
``length`` lose nothing; repeated rows and ids are separate documents; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from .substring_dedup import group_digests, read_digests, send_digests

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
U = np.uint64
#: Bytes of an anchor.
K = 24
#: An anchor with more different segments than this is split further.
HOT = 2048


def least_in_window(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive numbers, by running minima from both ends of stretches of ``w``."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    m = -(-len(v) // w) * w
    padded = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class Segments:
    """Segments of a block: first and last window start, anchor position, anchor hash."""

    def __init__(self, b: B.Block, length: int):
        self.b, self.length = b, length
        grams = np.zeros(0, np.uint64)
        self.roll = B.Rolling(B.BYTE_HASH[b.buf], B.BASES[0])
        if len(b.buf) >= length:
            grams = self.roll.windows(K)
        # by the upper half of the hash, then leftmost: the same choice in every block
        at = (grams & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        least = (least_in_window(at, length - K + 1) & U(0xFFFFFFFF)).astype(np.int64)
        whole = np.zeros(len(least), np.int32)
        room = b.lens >= length
        np.add.at(whole, b.start[room], 1)
        ends = b.start[room] + b.lens[room] - length + 1
        np.add.at(whole, ends[ends < len(whole)], -1)
        whole = np.cumsum(whole) > 0
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        last = whole.copy()
        last[:-1] &= (least[1:] != least[:-1]) | ~whole[1:]
        self.a, self.z = np.flatnonzero(new), np.flatnonzero(last)
        self.p = least[self.a] if len(least) else self.a
        self.key = grams[self.p] if len(grams) else np.zeros(0, np.uint64)

    def contents(self, a: np.ndarray, z: np.ndarray):
        """Number of each segment among the different ones, and the first place of each."""
        seen: dict[bytes, int] = {}
        raw, first = self.b.buf.tobytes(), []
        number = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a.tolist(), (z + self.length).tolist(), strict=True)):
            n = seen.setdefault(raw[x:y], len(seen))
            if n == len(first):
                first.append(i)
            number[i] = n
        return number, np.array(first, np.int64), list(seen)


def anchor_keys(s: Segments, shards: int):
    """Different anchors by shard, each segment's place among them, and how many different segments each has."""
    order = np.lexsort((s.key, B.spread(s.key, shards)))
    k = s.key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    key = k[new]
    return key, B.spread(key, shards), back


def count_anchors(parts: list[bytes], most: int) -> tuple[list[bytes], int]:
    """Answer for each anchor: 0 it occurs once, 1 more often, 2 with very many different segments."""
    sizes = [len(p) // 12 for p in parts]
    key = np.concatenate([np.frombuffer(p, U, n) for p, n in zip(parts, sizes, strict=True)])
    times = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(parts, sizes, strict=True)])
    kinds = np.concatenate([np.frombuffer(p, np.uint16, n, 10 * n) for p, n in zip(parts, sizes, strict=True)])
    u, back = np.unique(key, return_inverse=True)
    state = (np.bincount(back, times, len(u)) > 1).astype(np.uint8)
    hot = np.bincount(back, kinds, len(u)) > most
    state[hot] = 2
    out, at = [], 0
    for n in sizes:
        out.append(zstandard.ZstdCompressor(level=1).compress(state[back[at : at + n]].tobytes()))
        at += n
    return out, int(hot.sum())


def repeated_columns(parts: list[bytes], length: int) -> tuple[list[bytes], int]:
    """The column-wise construction over one shard; answers each block with a bit for each window it sent."""
    number: dict[tuple[int, int, bytes], int] = {}
    texts, keys, rels, many, sent = [], [], [], [], []
    for part in parts:
        raw = zstandard.ZstdDecompressor().decompress(part)
        n = int.from_bytes(raw[:4], "little")
        key = np.frombuffer(raw, U, n, 4)
        rel = np.frombuffer(raw, np.uint16, n, 4 + 8 * n)
        size = np.frombuffer(raw, np.uint16, n, 4 + 10 * n)
        twice = np.frombuffer(raw, np.uint8, n, 4 + 12 * n)
        at, ids = 4 + 13 * n, np.empty(n, np.int64)
        for i, (k, r, z, t) in enumerate(zip(key.tolist(), rel.tolist(), size.tolist(), twice.tolist(), strict=True)):
            text = raw[at : at + z]
            at += z
            ids[i] = j = number.setdefault((k, r, text), len(texts))
            if j == len(texts):
                texts.append(text)
                keys.append(k)
                rels.append(r)
                many.append(t)
            else:
                many[j] = 1
        sent.append(ids)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    rel, many = np.array(rels, np.int64), np.array(many, bool)
    group = np.unique(np.array(keys, np.uint64), return_inverse=True)[1].astype(np.int64)
    n_win = size - length + 1
    win_at = np.concatenate(([0], np.cumsum(n_win)))
    repeated = np.repeat(many, n_win)

    # columns run from the last to the first; column 0 is the anchor's first byte
    enter = (size - rel - 1).astype(np.int64)
    by_enter = np.argsort(-enter, kind="stable")
    enter_sorted, entered = -enter[by_enter], 0
    order, lcp = np.zeros(0, np.int64), np.zeros(1, np.int32)  # lcp[i]: with the one before; one spare at the end
    for column in range(int(enter.max(initial=-1)), -int(rel.max(initial=0)) - 1, -1):
        stay = rel[order] >= -column
        if not stay.all():  # segments that are complete leave; their neighbours' common prefix is the least passed
            keep = np.flatnonzero(stay)
            # least over each stretch from behind the previous kept one up to this one
            starts = np.concatenate(([0], keep[:-1] + 1)) if len(keep) else keep
            kept = np.minimum.reduceat(lcp[: keep[-1] + 1], starts) if len(keep) else np.zeros(0, np.int32)
            order, lcp = order[keep], np.append(kept, 0).astype(np.int32)
            lcp[0] = 0
        upto = int(np.searchsorted(enter_sorted, -column, "right"))
        if upto > entered:  # their suffix so far is empty: in front of all
            fresh = by_enter[entered:upto]
            entered = upto
            order = np.concatenate((fresh, order))
            lcp = np.concatenate((np.zeros(len(fresh), np.int32), lcp))
            # a fresh one shares nothing with whatever follows
            if len(fresh) < len(order):
                lcp[len(fresh)] = 0
        if not len(order):
            continue
        bwt = symbols[start[order] + rel[order] + column]
        rank = group[order] * 256 + bwt
        place = np.argsort(rank, kind="stable")
        new_order, new_rank = order[place], rank[place]
        new_lcp = np.zeros(len(order) + 1, np.int32)
        same = np.flatnonzero(new_rank[1:] == new_rank[:-1]) + 1
        if len(same):
            left, right = place[same - 1] + 1, place[same] + 1
            bounds = np.empty(2 * len(same), np.int64)
            bounds[::2], bounds[1::2] = left, right
            new_lcp[same] = 1 + np.minimum.reduceat(lcp, bounds)[::2]
        order, lcp = new_order, new_lcp
        shared = lcp >= length
        hit = order[shared[:-1] | shared[1:]]
        if len(hit):
            repeated[win_at[hit] + rel[hit] + column] = True
    out = []
    for ids in sent:
        if not len(ids):
            out.append(b"")
            continue
        counts = n_win[ids]
        at = np.repeat(win_at[ids] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
        out.append(np.packbits(repeated[at]).tobytes())
    return out, 0


def _states(s: Segments, shards: int, replies: dict[int, bytes]) -> np.ndarray:
    """0, 1 or 2 for each segment: see ``count_anchors``."""
    key, shard, back = anchor_keys(s, shards)
    state = np.zeros(len(key), np.uint8)
    for sh, x in B.by_shard(shard):
        state[x] = np.frombuffer(zstandard.ZstdDecompressor().decompress(replies[sh]), np.uint8)
    return state[back] if len(key) else np.zeros(0, np.uint8)


def _hot_windows(s: Segments, state: np.ndarray):
    """Window starts in segments with hot anchors, the segment of each, and two hashes of each."""
    hot = np.flatnonzero(state == 2)
    n = s.z[hot] - s.a[hot] + 1
    at = np.repeat(s.a[hot] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum()) if len(hot) else hot
    h1 = s.roll.of(at, s.length)
    h2 = B.Rolling(B.BYTE_HASH[s.b.buf], B.BASES[1]).of(at, s.length) if len(hot) else h1
    return at, np.repeat(hot, n), h1, h2


def _candidates(s: Segments, shards: int, replies):
    """First and last window start, anchor position and key of every segment that may hold a repeat."""
    state = _states(s, shards, replies["anchor"]) if len(s.a) else np.zeros(0, np.uint8)
    plain = state == 1
    a, z, p, key = s.a[plain], s.z[plain], s.p[plain], s.key[plain]
    if (state == 2).any():
        at, seg, h1, h2 = _hot_windows(s, state)
        twice = read_digests(h1, h2, shards, replies["hot"])
        at, seg = at[twice], seg[twice]
        if len(at):
            step = max(1, (s.length - K) // 4)
            quarter = (s.p[seg] - at) // step
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1]) | (quarter[1:] != quarter[:-1])
            last = np.append(new[1:], True)
            a2, z2, p2, q = at[new], at[last], s.p[seg[new]], quarter[new]
            shared = s.roll.of(p2 - step * q, s.length - step + 1)
            a, z, p = np.concatenate((a, a2)), np.concatenate((z, z2)), np.concatenate((p, p2))
            key = np.concatenate((key, B.mix(shared + q.astype(np.uint64))))
    return a, z, p, key


def _sorted_candidates(s: Segments, shards: int, replies):
    a, z, p, key = _candidates(s, shards, replies)
    number, first, texts = s.contents(a, z)
    # the text fixes the anchor but for split runs, whose key tells them apart
    pair = np.unique(np.stack((number, key.view(np.int64), p - a), axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True) if len(a) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, at, back, count = pair
    back = np.asarray(back).ravel()
    shard = B.spread(key[at], shards)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    at = at[order]
    return a, z, place[back], at, shard[order], key[at], (p - a)[at], (count > 1)[order], number, texts


def suffix_dedup(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False, hot: int = HOT, scratch: B.Scratch | None = None) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which starts anywhere else too.

    One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked
    for, kept_text (null for null; bytes that are no longer UTF-8 after a cut are left out).
    """
    if length <= K:
        raise ValueError(f"length must be over {K}")
    blocks = B.to_blocks(docs, key, text, scratch=scratch)
    shards = blocks.shards()

    def anchors(_, b, __):
        s = Segments(b, length)
        if len(s.a):
            key, shard, back = anchor_keys(s, shards)
            times = np.minimum(np.bincount(back, minlength=len(key)), 60_000).astype(np.uint16)
            # different segments of an anchor: by hash of the whole segment
            whole = s.roll.of(s.a, s.z - s.a + length)
            kinds = np.minimum(np.bincount(back[np.unique(whole, return_index=True)[1]], minlength=len(key)), 60_000).astype(np.uint16)
            for sh, x in B.by_shard(shard):
                yield sh, key[x].tobytes() + times[x].tobytes() + kinds[x].tobytes()

    def hot_windows(_, b, replies):
        s = Segments(b, length)
        if len(s.a):
            state = _states(s, shards, replies["anchor"])
            if (state == 2).any():
                _, _, h1, h2 = _hot_windows(s, state)
                yield from send_digests(h1, h2, shards)

    def segments(_, b, replies):
        s = Segments(b, length)
        if not len(s.a):
            return
        *_, at, shard, key, rel, many, number, texts = _sorted_candidates(s, shards, replies)
        for sh, x in B.by_shard(shard):
            own = [texts[i] for i in number[at[x]].tolist()]
            head = [np.uint32(len(own)).tobytes(), key[x].tobytes(), rel[x].astype(np.uint16).tobytes(), np.array([len(t) for t in own], np.uint16).tobytes(), many[x].astype(np.uint8).tobytes()]
            yield sh, zstandard.ZstdCompressor(level=1).compress(b"".join(head + own))

    asked = {"anchor": B.ask(blocks, anchors, lambda parts: count_anchors(parts, hot), "anchors", shards)}
    asked["hot"] = B.ask(blocks, hot_windows, group_digests, "hot", shards, **asked)
    asked["columns"] = B.ask(blocks, segments, lambda parts: repeated_columns(parts, length), "columns", shards, **asked)

    def remove(_, b, replies):
        s = Segments(b, length)
        cover = np.zeros(len(b.buf) + 1, np.int32)
        if len(s.a):
            a, z, place, at, shard, *_ = _sorted_candidates(s, shards, replies)
            n_win = (z - a + 1)[at]
            bits = [np.unpackbits(np.frombuffer(replies["columns"][sh], np.uint8), count=int(n_win[x].sum())) for sh, x in B.by_shard(shard)]
            bits = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            win_at = np.concatenate(([0], np.cumsum(n_win)))
            counts = z - a + 1
            step = np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
            hit = np.repeat(a, counts)[bits[np.repeat(win_at[place], counts) + step]] + step[bits[np.repeat(win_at[place], counts) + step]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        before, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(first)))
        end = b.start + b.lens
        texts = [b.buf[x:y][~gone[x:y]].tobytes() for x, y in zip(b.start.tolist(), end.tolist(), strict=True)]
        frame = pd.DataFrame({"doc_id": pd.array(list(b.ids), "Int64"), "n_bytes": b.lens, "n_removed": before[end] - before[b.start], "n_spans": spans[end] - spans[b.start], "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})
        if with_text:
            frame["kept_text"] = [None if r < 0 else t.decode("utf-8", "ignore") for t, r in zip(texts, b.raw_lens, strict=True)]
        return frame

    return B.map_blocks(B.with_replies(blocks, **asked), remove, SCHEMA + ", kept_text string" * with_text)

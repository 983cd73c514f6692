"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: each row of the index table holds the postings of one block of training
documents, as the sorted distinct terms (64-bit hashes of lower-cased words), where each term's list begins,
and the positions (block-wide word numbers with a gap between documents). A test phrase is looked up in a
block by intersecting lists from its rarest term on: the positions of the rarest term, less the term's offset
in the phrase, are the candidate starts, and the offset-adjusted list of the next rarest term strikes out what
it lacks. Rarity is counted over the whole corpus. Nothing is shuffled but term counts, a third of all
documents may hold one passage. Phrases are broadcast in slices of a fixed number of windows, one slice at a time
(a long item is split over slices); a test set of more than one slice takes one pass over the index for each, whose
findings are written and meet again by block.

Defined results: null and empty texts have no words and no hits; a test item without words is never found; words of
a test item without an id are hit, but it is not counted or named among the items; rows of one item id are one item;
repeated documents are separate; empty tables give empty results or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

INDEX = "block long, ids array<bigint>, first binary, n_words binary, terms binary, starts binary, positions binary"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words of nothing between two documents, so that no phrase or span runs across.
GAP = 64
#: Windows of test items in one broadcast (about 240 bytes each once compiled).
SLICE = 200_000
U = np.uint64


def words_of(buf: np.ndarray):
    low = B.LOWER[buf]
    starts, ends = B.find_words(low, B.NOT_ALNUM)
    return B.hash_words(low, starts, ends), starts


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = GAP, scratch: B.Scratch | None = None) -> DataFrame:
    """The positional index of whole texts, one row a block, written to the shared folder."""

    def rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, lens = B.flat(batch.column(1))
            ends = np.concatenate(([0], np.cumsum(np.maximum(lens, 0))))
            at = 0
            while at < len(lens):
                to = min(max(int(np.searchsorted(ends, ends[at] + B.BLOCK_BYTES, "right")) - 1, at + 1), at + B.BLOCK_ROWS, len(lens))
                size = np.maximum(lens[at:to], 0)
                start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
                buf = np.full(int(size.sum()) + len(size), 10, np.uint8)
                keep = np.ones(len(buf), bool)
                keep[start + size] = False
                buf[keep] = data[ends[at] : ends[to]]
                h, where = words_of(buf)
                doc = np.searchsorted(start, where, "right") - 1
                n_words = np.bincount(doc, minlength=len(size))
                first = np.concatenate(([0], np.cumsum(n_words + gap)))[:-1]
                position = (np.arange(len(h)) + doc * gap).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                h, position = h[order], position[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                begin = np.append(np.flatnonzero(new), len(h)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([batch.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64())),
                        pa.array([first.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([n_words.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([h[new].tobytes()], pa.binary()),
                        pa.array([squeeze(begin.tobytes())], pa.binary()),
                        pa.array([squeeze(np.diff(position.astype(np.int64), prepend=0).astype(np.int32).tobytes())], pa.binary()),
                    ],
                    ["block", "ids", "first", "n_words", "terms", "starts", "positions"],
                )
                block += 1
                at = to

    rows_in = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scratch = scratch or B.Scratch(docs.sparkSession)
    return scratch.write(rows_in.mapInArrow(rows, INDEX), "index", "none")


class Postings:
    """The lists of one block."""

    def __init__(self, row):
        expand = zstandard.ZstdDecompressor().decompress
        self.ids = row["ids"]
        self.first, self.n_words = np.frombuffer(row["first"], np.int64), np.frombuffer(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], U)
        self.starts = np.frombuffer(expand(row["starts"]), np.uint32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(expand(row["positions"]), np.int32), dtype=np.int64)
        # (number of the term, position) in one ascending list: a term's list is a stretch of it
        self.keys = (np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) << 32) | self.positions

    def find(self, terms: np.ndarray):
        """Number of each term here, -1 for those that no document here has."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (position >= 0)

    def phrases(self, phrase: np.ndarray, offset: np.ndarray, term: np.ndarray, n_phrases: int):
        """Exact matches of many phrases at once. The three arrays hold one entry a phrase term, each phrase's
        entries together and rarest first; returns (phrase, start) of every match."""
        local = self.find(term)
        whole = np.ones(n_phrases, bool)
        whole[phrase[local < 0]] = False
        first = np.concatenate(([0], np.flatnonzero(phrase[1:] != phrase[:-1]) + 1)) if len(phrase) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(phrase)))
        first, length = first[whole[phrase[first]]], length[whole[phrase[first]]]
        n = self.starts[local[first] + 1] - self.starts[local[first]]
        which = np.repeat(np.arange(len(first)), n)
        inside = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        start = self.positions[self.starts[local[first]][which] + inside] - offset[first][which]
        for k in range(1, int(length.max(initial=1))):
            more = length[which] > k
            entry = first[which] + np.where(more, k, 0)
            ok = ~more | self.has(local[entry], start + offset[entry])
            which, start = which[ok], start[ok]
        return phrase[first[which]], start

    def near(self, terms: np.ndarray, slop: int):
        """Documents where all distinct ``terms`` lie within ``len(terms) + slop`` words of each other, and the
        first word of the first such span from the rarest term on."""
        local = np.unique(self.find(terms))
        if not len(local) or local[0] < 0:
            return []
        lists = sorted((self.positions[self.starts[t] : self.starts[t + 1]] for t in local), key=len)
        width, out = len(local) + slop, {}
        for at in lists[0].tolist():
            # each window that holds this posting: the others must all have one inside
            near = [x[np.searchsorted(x, at - width + 1) : np.searchsorted(x, at + width)] for x in lists[1:]]
            if not all(len(x) for x in near):
                continue
            for low in sorted({at, *(p for x in near for p in x.tolist() if p <= at)}):
                if low > at - width and all(((x >= low) & (x < low + width)).any() for x in near):
                    doc = int(np.searchsorted(self.first, at, "right")) - 1
                    out.setdefault(doc, low - int(self.first[doc]))
                    break
        return sorted(out.items())

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of these distinct, sorted terms occurs in the whole corpus."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def count(frames):
        total = np.zeros(len(wanted.value), np.int64)
        for frame in frames:
            for row in frame.to_dict("records"):
                have = np.frombuffer(row["terms"], U)
                begin = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["starts"]), np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(have, wanted.value), max(0, len(have) - 1))
                if len(have):
                    total += np.where(have[at] == wanted.value, begin[at + 1] - begin[at], 0)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    rows = index.select("terms", "starts").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms), np.int64)
    for r in rows:
        out[r.term] = r.n
    return out


def _slices(items: DataFrame, key: str, text: str, width: int, size: int):
    """Test items in slices of at most ``size`` windows, as lists of (id, word hashes); an item that is split repeats
    the words that windows on both sides of the cut share."""
    rows = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    have: list = []
    room = size
    for r in rows.toLocalIterator():
        h, _ = words_of(np.frombuffer(r.text.encode(), np.uint8))
        at, left = 0, max(1, len(h) - width + 1) if len(h) else 0
        while left:
            n = min(left, room)
            have.append((r.item, h[at : at + n + width - 1]))
            at, left, room = at + n, left - n, room - n
            if not room:
                yield have
                have, room = [], size
    if have:
        yield have


def _compiled(index: DataFrame, have: list, width: int):
    """Distinct phrases of a slice with rarest terms first, their sizes, and the items of each phrase."""
    sizes, rows, owners = [], [], []
    for n in sorted({min(width, len(h)) for _, h in have}):
        own = [(i, h) for i, (_, h) in enumerate(have) if min(width, len(h)) == n]
        rows.append(np.concatenate([np.lib.stride_tricks.sliding_window_view(h, n) for _, h in own]))
        owners.append(np.concatenate([np.full(len(h) - n + 1, i) for i, h in own]))
        sizes.append(n)
    terms, back = np.unique(np.concatenate([r.ravel() for r in rows]), return_inverse=True)
    often, term_of = _frequencies(index, terms), np.split(back.ravel(), np.cumsum([r.size for r in rows])[:-1])
    phrase, offset, term, size, pairs, base = [], [], [], [], [], 0
    for n, r, who, t in zip(sizes, rows, owners, term_of, strict=True):
        kinds, number = np.unique(t.reshape(r.shape), axis=0, return_inverse=True)
        order = np.argsort(often[kinds], axis=1, kind="stable")
        phrase.append(np.repeat(np.arange(len(kinds)) + base, n))
        offset.append(order.ravel())
        term.append(terms[np.take_along_axis(kinds, order, axis=1)].ravel())
        size.append(np.full(len(kinds), n))
        pairs.append(np.stack((number.ravel() + base, who), axis=1))
        base += len(kinds)
    pairs = np.unique(np.concatenate(pairs), axis=0)
    return np.concatenate(phrase), np.concatenate(offset), np.concatenate(term), np.concatenate(size), pairs, [i for i, _ in have]


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", slice_windows: int = SLICE, scratch: B.Scratch | None = None) -> DataFrame:
    """Hit words and items of each document: see the module's text for the method.

    A window is ``width`` consecutive item words; an item of fewer words, but not none, is one window. A
    document word inside any occurrence of a window is hit. One row a document: doc_id, n_words, n_hit,
    n_items, items_sha256 (of the item ids sorted as strings and joined by commas), contaminated.
    """
    scratch = scratch or B.Scratch(docs.sparkSession)
    index = build_index(docs, key, text, scratch=scratch)
    share = docs.sparkSession.sparkContext.broadcast
    slices = _slices(items, item_key, item_text, width, slice_windows)
    first, second = next(slices, None), next(slices, None)
    if second is None:
        only = share(_compiled(index, first, width) if first else None)

        def whole(frames):
            for row in (r for f in frames for r in f.to_dict("records")):
                p = Postings(row)
                yield _finish(p.ids, p.first, p.n_words, *_look(p, only.value))

        return index.mapInPandas(whole, SCHEMA)

    # one pass a slice; what each slice found in a block is written and meets again by block
    def part(one):
        def run(frames):
            for row in (r for f in frames for r in f.to_dict("records")):
                p = Postings(row)
                hit, found = _look(p, one.value)
                bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(hit).tobytes())
                yield pd.DataFrame({"block": [row["block"]], "ids": [list(p.ids)], "first": [row["first"]], "n_words": [row["n_words"]], "hit": [bits], "found": [json.dumps({d: sorted(x) for d, x in found.items()})]})

        return run

    def merge(frame):
        first, n_words = (np.frombuffer(frame[c].iloc[0], np.int64) for c in ("first", "n_words"))
        hit, found = None, {}
        for bits, more in zip(frame["hit"], frame["found"], strict=True):
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8)
            hit = got if hit is None else hit | got
            for d, x in json.loads(more).items():
                found.setdefault(int(d), set()).update(x)
        return _finish(frame["ids"].iloc[0], first, n_words, np.unpackbits(hit).astype(bool), found)

    rows = None
    for have in chain((first, second), slices):
        one = share(_compiled(index, have, width))
        found = scratch.write(index.mapInPandas(part(one), "block long, ids array<bigint>, first binary, n_words binary, hit binary, found string"), "found")
        one.destroy()
        rows = found if rows is None else rows.unionByName(found)
    return rows.groupBy("block").applyInPandas(merge, SCHEMA)


def _look(p: Postings, compiled):
    """Hit words of a block, by position, and the items found in each of its documents."""
    n = len(p.ids)
    hit, found = np.zeros(int(p.first[-1] + p.n_words[-1] + GAP) + 1 if n else 1, np.int32), {}
    if compiled is not None:
        phrase, offset, term, sizes, pairs, names = compiled
        which, start = p.phrases(phrase, offset, term, len(sizes))
        if len(which):
            np.add.at(hit, start, 1)
            np.add.at(hit, start + sizes[which], -1)
            # (document, phrase) pairs, then the items of each phrase
            dw = np.unique(np.stack((p.doc_of(start), which), axis=1), axis=0)
            lo, hi = np.searchsorted(pairs[:, 0], dw[:, 1]), np.searchsorted(pairs[:, 0], dw[:, 1], "right")
            for d, a, z in zip(dw[:, 0].tolist(), lo.tolist(), hi.tolist(), strict=True):
                found.setdefault(d, set()).update(names[i] for i in pairs[a:z, 1].tolist() if names[i] is not None)
    return np.cumsum(hit) > 0, {d: x for d, x in found.items() if x}


def _finish(ids, first, n_words, hit, found) -> pd.DataFrame:
    covered = np.concatenate(([0], np.cumsum(hit)))
    n_hit = covered[first + n_words] - covered[first]
    lists = [sorted(found.get(d, ())) for d in range(len(ids))]
    return pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "n_words": n_words, "n_hit": n_hit, "n_items": [len(x) for x in lists], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], "contaminated": n_hit > 0})


def proximity(index: DataFrame, phrase: str, slop: int) -> DataFrame:
    """Documents in which all words of ``phrase`` lie within its number of different words plus ``slop`` words
    (at most ``GAP`` in all): doc_id and the first word's number."""
    terms = np.unique(words_of(np.frombuffer(phrase.encode(), np.uint8))[0])
    if len(terms) + slop > GAP:
        raise ValueError(f"a span may be {GAP} words at most")

    def search(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                p = Postings(row)
                got = p.near(terms, slop)
                yield pd.DataFrame({"doc_id": pd.array([p.ids[d] for d, _ in got], "Int64"), "at": [a for _, a in got]})

    return index.mapInPandas(search, "doc_id long, at long")

"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct shingles. Shingles are ordered rarest first (by the power of two of a
sketched set count, then by hash), and a set is listed under the first ``size - ceil(t * size) + 1`` of them:
two sets that link share one of these. A shingle that no other set has cannot be shared, so only sets whose
index prefix holds shingles that occur twice are listed at all.

Index-level skipping: each list is kept by set size and carries positions, so a probe skips the stretch of
sets too small or too large for it, then those whose positions leave too little overlap, then those whose
parity bitmaps differ in more bits than the sets may differ in members; all three bounds are exact.
Answer-level skipping: sets that a list's first set may link with are answered by it (round 1 verifies one
pair a set and leader, in place of all pairs of a group). Once verified links have made components, a set left
outside one is verified against the most similar of its members (round 2), which answers for the others, and
only pairs still across components are probed one by one (round 3); what a set reaches through a highly similar
set is never computed again. Round 3 covers every pair that shares a list and is not yet joined, so no link is lost.
Verification intersects the whole sets of shingles.

Hot lists: a list of more sets than one task should hold (by the sketched counts, which every block has before it
lists anything) is dealt into chunks by a hash of set and shingle, so each shingle cuts its sets differently. Round 1
answers each chunk by its own leaders; near copies share many shingles, whose different cuts tie the chunks'
components together. In rounds 2 and 3 the sets outside the list's largest component visit every chunk, in groups of
a chunk's size, which meets every pair of the list that is still apart.

Defined results: null texts and texts without words have no shingles, link with nothing and are their own
component; identical sets link; a null id takes its component's least non-null id; repeated rows are separate
documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .graph import components, extended

U = np.uint64
LISTED = "kind int, shard int, block long, sid binary, size long, data binary"
#: Kinds of rows of LISTED: a block's documents, a set's shingles, a block's part of a shard's lists, of hot lists.
DOCUMENTS, SETS, LISTS, HOT = 0, 1, 2, 3
#: A set's place in a chunk of a hot list.
PLACES = "token long, chunk int, chunks int, sid binary, size long, pos long, map binary"
#: Sets of a list, a power of two, from twice of which on it is dealt into chunks of about so many.
LIST_SETS = 8192
PAIRS = "kind int, shard int, a binary, b binary"


class Sets:
    """Distinct shingles of each document of a block, in order of document and hash."""

    def __init__(self, b: B.Block, n: int):
        low = B.LOWER[b.buf]
        starts, ends = B.find_words(low, B.BLANK)
        h = B.hash_words(low, starts, ends)
        doc = np.searchsorted(b.start, starts, "right") - 1
        n_words = np.bincount(doc, minlength=len(b.ids))
        first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
        whole = np.flatnonzero(doc[: max(0, len(h) - n + 1)] == doc[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
        # documents of fewer words are one run each
        short = [np.flatnonzero(n_words == k) for k in range(1, n)]
        runs = [B.mix(B.hash_runs(h, k)[first[d]] + U(k)) for k, d in enumerate(short, 1) if len(d)]
        hashes = np.concatenate((B.hash_runs(h, n)[whole], *runs))
        owner = np.concatenate((doc[whole], *short))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(b.ids))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        raw = self.hashes.tobytes()
        self.sid = [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() if z > a else b"" for a, z in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        #: The first document of each different set.
        self.kinds = np.array([i for i, s in enumerate(self.sid) if s and seen.setdefault(s, i) == i], np.int64)


def _cells(s: Sets, shards: int, bits: int):
    """Distinct (shard, counter) keys of the block's different sets, each shingle's place, and set counts."""
    mask = np.zeros(len(s.size), bool)
    mask[s.kinds] = True
    mine = mask[s.owner]
    h = s.hashes[mine]
    key, back, count = np.unique(B.spread(h, shards).astype(U) << U(32) | (h & U((1 << bits) - 1)), return_inverse=True, return_counts=True)
    return mine, key, back, count


def merge_counts(parts: list[bytes]) -> tuple[list[bytes], int]:
    """Sum the blocks' counters; answer with the power of two of each (0: one set only)."""
    got = []
    for p in parts:
        n, kind = int.from_bytes(p[:4], "little"), np.dtype(f"<u{p[4]}")
        got.append((B.unpack_sorted(p[5 + n * kind.itemsize :])[0], np.frombuffer(p, kind, n, 5)))
    u, back = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    power = np.log2(np.bincount(back, np.concatenate([k for _, k in got]), len(u))).astype(np.uint8)
    out, at = [], 0
    for c, _ in got:
        out.append(zstandard.ZstdCompressor(level=1).compress(power[back[at : at + len(c)]].tobytes()))
        at += len(c)
    return out, 0


def least_overlap(x, y, percent: int):
    """The least intersection of sets of these sizes that link."""
    return -(-percent * (x + y) // (100 + percent))


def _bitmap(hashes: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmap of two to four bits a member, a power of two, at least 1024."""
    bits = 1 << max(10, int(2 * size - 1).bit_length())
    count = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").view(U)


class Lists:
    """The inverted lists of one shard, or a chunk of a hot one with its visitors."""

    home = guest = None

    @classmethod
    def of_chunk(cls, rows: pd.DataFrame, percent: int, guests: pd.DataFrame | None = None) -> tuple[Lists, np.ndarray | None]:
        """A chunk's rows (PLACES) as one list, and its sets' labels if it has visitors: these meet the chunk's own
        sets, and nobody else meets."""
        x = cls.__new__(cls)
        both = rows if guests is None else pd.concat([rows, guests])
        both = both.drop_duplicates("sid").sort_values(["size", "sid"])
        x.percent, x.sids, x.size = percent, list(both["sid"]), both["size"].to_numpy(np.int64)
        x.maps = [np.frombuffer(m, U) for m in both["map"]]
        x.lists = [(np.arange(len(both)), both["pos"].to_numpy(np.int64))]
        if guests is None:
            return x, None
        x.home, x.guest = both["sid"].isin(rows["sid"]).to_numpy(), both["sid"].isin(guests["sid"]).to_numpy()
        return x, pd.factorize(both["label"])[0]

    def __init__(self, parts: list[bytes], percent: int):
        self.percent = percent
        sids, sizes, maps, owner, token, pos, base = [], [], [], [], [], [], 0
        for p in parts:
            s, z, m, o, t, k = pickle.loads(p)
            sids += s
            sizes.append(z)
            maps += m
            owner.append(o.astype(np.int64) + base)
            token.append(t)
            pos.append(k)
            base += len(s)
        number: dict[bytes, int] = {}
        same = np.array([number.setdefault(s, len(number)) for s in sids], np.int64)
        first = np.full(len(number), -1, np.int64)
        first[same[::-1]] = np.arange(len(same))[::-1]
        self.sids = list(number)
        self.size = np.concatenate(sizes).astype(np.int64)[first]
        self.maps = [maps[i] for i in first.tolist()]
        owner, token, pos = same[np.concatenate(owner)], np.concatenate(token), np.concatenate(pos).astype(np.int64)
        order = np.lexsort((owner, self.size[owner], token))
        owner, token, pos = owner[order], token[order], pos[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        owner, token, pos = owner[new], token[new], pos[new]
        cut = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))
        self.lists, seen = [], set()
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if z - a > 1:
                name = owner[a:z].tobytes() + pos[a:z].tobytes()
                if name not in seen:
                    seen.add(name)
                    self.lists.append((owner[a:z], pos[a:z]))

    def may_link(self, x: int, x_pos: int, ys: np.ndarray, y_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``ys`` the bounds on size, position and parity leave as partners of ``x``, and the parity bits
        in which those differ from it."""
        nx, ny = self.size[x], self.size[ys]
        need = least_overlap(nx, ny, self.percent)
        ok = (100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny)) & (1 + np.minimum(nx - x_pos - 1, ny - y_pos - 1) >= need)
        left = np.flatnonzero(ok)
        mine, gap = self.maps[x], np.zeros(len(ys), np.int64)
        by_len: dict[int, list[int]] = {}
        for i in left.tolist():
            by_len.setdefault(len(self.maps[ys[i]]), []).append(i)
        for n, idx in by_len.items():
            theirs, own = np.stack([self.maps[ys[i]] for i in idx]), mine
            while len(own) > n:
                own = own[: len(own) // 2] ^ own[len(own) // 2 :]
            while theirs.shape[1] > len(own):
                theirs = theirs[:, : theirs.shape[1] // 2] ^ theirs[:, theirs.shape[1] // 2 :]
            differ = np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64)
            idx = np.array(idx)
            ok[idx], gap[idx] = differ <= nx + ny[idx] - 2 * need[idx], differ
        return ok, gap

    def leaders(self):
        """Round 1: pairs of each list's leaders with those they may answer."""
        pairs = set()
        for owner, pos in self.lists:
            while len(owner) > 1:
                far = int(np.searchsorted(self.size[owner], self.size[owner[0]] * 100 // self.percent, "right"))
                ok = np.zeros(len(owner), bool)
                ok[0] = True
                if far > 1:
                    ok[1:far] = self.may_link(int(owner[0]), int(pos[0]), owner[1:far], pos[1:far])[0]
                    pairs.update((int(owner[0]), y) for y in owner[1:][ok[1:]].tolist())
                owner, pos = owner[~ok], pos[~ok]
        return pairs

    def _apart(self, label: np.ndarray):
        """Each set with the possible partners of a list that are not in its component yet, as (set, partners,
        differing parity bits); the sets of a list's largest component are met by the others only."""
        for owner, pos in self.lists:
            labels, size = label[owner], self.size[owner]
            kinds, count = np.unique(labels, return_counts=True)
            meets = labels != kinds[np.argmax(count)] if self.guest is None else self.guest
            for i in np.flatnonzero(meets).tolist():
                near = slice(int(np.searchsorted(size, -(-size[i] * self.percent // 100))), int(np.searchsorted(size, size[i] * 100 // self.percent, "right")))
                other = np.flatnonzero((labels[near] != labels[i]) & (self.home is None or self.home[near])) + near.start
                if len(other):
                    ok, gap = self.may_link(int(owner[i]), int(pos[i]), owner[other], pos[other])
                    yield int(owner[i]), owner[other[ok]], gap[ok]

    def nearest(self, label: np.ndarray):
        """Round 2: each set with the most similar set of every other component that it may link with."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x, ys, gap in self._apart(label):
            for g, y, there in zip(gap.tolist(), ys.tolist(), label[ys].tolist(), strict=True):
                if (x, there) not in best or (g, y) < best[x, there]:
                    best[x, there] = (g, y)
        return {(min(x, y), max(x, y)) for (x, _), (_, y) in best.items()}

    def across(self, label: np.ndarray):
        """Round 3: every pair of a list whose sets are not in one component yet."""
        return {(min(x, y), max(x, y)) for x, ys, _ in self._apart(label) for y in ys.tolist()}


def _frame(kind, shard, pairs) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "shard": shard, "a": [a for a, _ in pairs], "b": [b for _, b in pairs]}).astype({"a": object, "b": object})


def shingle_components(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", scratch: B.Scratch | None = None, list_sets: int = LIST_SETS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach). Two documents
    link when 100 * intersection >= percent * union of their distinct ``n``-word shingles. ``list_sets`` changes how
    the work is dealt, not what is found."""
    blocks = B.to_blocks(docs, key, text, scratch=scratch)
    scratch, spark = blocks.scratch, docs.sparkSession
    shards = blocks.shards()
    tasks = B.tasks_for(spark, shards)
    fits = int(np.log2(list_sets))
    bits = max(8, min(30, int(np.ceil(np.log2(max(1, blocks.n_bytes / shards / 6 * 4))))))

    def count(_, b, __):
        _, key_, _, times = _cells(Sets(b, n), shards, bits)
        for sh, x in B.by_shard((key_ >> U(32)).astype(np.int64)):
            k = times[x].astype(np.uint8 if times[x].max() < 256 else np.uint32)
            yield sh, np.uint32(len(k)).tobytes() + bytes([k.itemsize]) + k.tobytes() + B.pack_sorted(key_[x] & U(0xFFFFFFFF), np.zeros(len(k), np.int64))

    counts = B.ask(blocks, count, merge_counts, "counts", shards)

    def listed(block, b, replies):
        s = Sets(b, n)
        rows = [(DOCUMENTS, 0, block, b"".join(x or bytes(16) for x in s.sid), 0, pickle.dumps((list(b.ids), s.size.tolist())))]
        mine, key_, back, _ = _cells(s, shards, bits)
        power = np.zeros(len(key_), np.uint8)
        for sh, x in B.by_shard((key_ >> U(32)).astype(np.int64)):
            power[x] = np.frombuffer(zstandard.ZstdDecompressor().decompress(replies["counts"][sh]), np.uint8)
        all_power = np.zeros(len(s.hashes), np.uint8)
        all_power[mine] = power[back] if len(key_) else 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for i in s.kinds.tolist():
            h, p = s.hashes[s.at[i] : s.at[i + 1]], all_power[s.at[i] : s.at[i + 1]]
            size = len(h)
            prefix = size - -(-percent * size // 100) + 1
            alone = int((p == 0).sum())
            if alone >= prefix:
                continue
            order = np.argsort(p, kind="stable")[alone:prefix]  # hashes ascend already
            out.append((np.full(len(order), i), h[order], np.arange(alone, prefix), p[order]))
            rows.append((SETS, 0, block, s.sid[i], size, h[p > 0].tobytes()))
        if out:
            owner, token, pos, power = (np.concatenate(x) for x in zip(*out, strict=True))
            maps = {i: _bitmap(s.hashes[s.at[i] : s.at[i + 1]], int(s.size[i])) for i in np.unique(owner).tolist()}
            chunks = np.left_shift(1, np.maximum(0, power.astype(np.int64) - fits))
            hot = chunks > 1
            if hot.any():
                own, local = np.unique(owner[hot], return_inverse=True)
                sids = [s.sid[i] for i in own.tolist()]
                head = np.array([int.from_bytes(x[:8], "little") for x in sids], U)[local]
                chunk = (B.mix(token[hot] ^ head) & (chunks[hot] - 1).astype(U)).astype(np.int64)
                rows.append((HOT, 0, block, b"", 0, pickle.dumps((token[hot].view(np.int64), chunk, chunks[hot], local, pos[hot], sids, s.size[own], [maps[i].tobytes() for i in own.tolist()]))))
            owner, token, pos = owner[~hot], token[~hot], pos[~hot]
            shard = B.spread(B.mix(token), shards)
            order = np.argsort(shard, kind="stable")
            owner, token, pos, shard = owner[order], token[order], pos[order], shard[order]
            for sh, x in B.by_shard(shard):
                own, local = np.unique(owner[x], return_inverse=True)
                rows.append((LISTS, sh, block, b"", 0, pickle.dumps(([s.sid[i] for i in own.tolist()], s.size[own].astype(np.uint32), [maps[i] for i in own.tolist()], local.astype(np.uint32), token[x], pos[x].astype(np.uint32)))))
        return pd.DataFrame(rows, columns=["kind", "shard", "block", "sid", "size", "data"])

    # lists and sets are bucketed tables: the rounds below bring pairs and labels to them, and move neither again
    listed_rows = scratch.write(B.map_blocks(B.with_replies(blocks, counts=counts), listed, LISTED), "listed", by="kind")
    lists = scratch.write(listed_rows.where(F.col("kind") == LISTS).select("shard", "block", "data").repartition(tasks, "shard"), "lists", bucket=(tasks, "shard"))
    # of the blocks that hold the same set one sends its shingles
    whole = listed_rows.where(F.col("kind") == SETS).groupBy("sid").agg(F.first("size").alias("size"), F.first("data").alias("data"))
    whole = scratch.write(whole, "sets", "none", (int(spark.conf.get("spark.sql.shuffle.partitions")), "sid"))

    def places(frames):
        for frame in frames:
            for data in frame["data"]:
                token, chunk, chunks, local, pos, sids, sizes, maps = pickle.loads(data)
                local = local.tolist()
                yield pd.DataFrame({"token": token, "chunk": chunk, "chunks": chunks, "sid": [sids[i] for i in local], "size": sizes[local], "pos": pos, "map": [maps[i] for i in local]})

    packed = listed_rows.where(F.col("kind") == HOT).select("data")
    hot = None if packed.isEmpty() else packed.mapInPandas(places, PLACES)

    def first_round(frame):
        shard = int(frame["shard"].iloc[0])
        x = Lists(list(frame.sort_values("block")["data"]), percent)
        here = sorted({int(i) for owner, _ in x.lists for i in owner})
        pairs = [tuple(sorted((x.sids[a], x.sids[b]))) for a, b in sorted(x.leaders())]
        return pd.concat([_frame(1, shard, pairs), _frame(0, shard, [(x.sids[i], None) for i in here])])

    def first_of_chunk(frame):
        x, _ = Lists.of_chunk(frame, percent)
        return _frame(1, 0, [tuple(sorted((x.sids[a], x.sids[b]))) for a, b in sorted(x.leaders())])

    one = lists.groupBy("shard").applyInPandas(first_round, PAIRS)
    if hot is not None:
        one = one.unionByName(hot.groupBy("token", "chunk").applyInPandas(first_of_chunk, PAIRS))
    one = scratch.write(one, "round1")
    links = scratch.write(_verified(one.where("kind = 1").select("a", "b").distinct(), whole, percent), "links1")
    labels = components(links, scratch)
    here = one.where("kind = 0").select("shard", F.col("a").alias("node"))

    def visited(probe, labels):
        """Pairs that ``probe`` finds in the hot lists, given the components so far; None if each list is one of them."""
        named = hot.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        counts = named.groupBy("token", "chunks", "label").agg(F.count("*").alias("n"))
        tops = counts.groupBy("token", "chunks").agg(F.max_by("label", F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("apart"))
        tops = scratch.write(tops.where("apart > 0").withColumn("groups", F.ceil(F.col("apart") / list_sets).cast("int")), "tops")
        if tops.isEmpty():
            return None
        members = named.join(tops.withColumn("chunk", F.expr("explode(sequence(0, chunks - 1))")).drop("chunks"), ["token", "chunk"])
        members = scratch.write(members, "members")
        place = ["sid", "size", "pos", "map", "label"]
        homes = members.select("token", "chunk", F.expr("explode(sequence(0, groups - 1)) as grp"), *place)
        guests = members.where("label <> top").select(F.col("token").alias("to"), F.expr("explode(sequence(0, chunks - 1)) as at"), F.expr("pmod(hash(sid), groups) as of"), *[F.col(c).alias(f"g_{c}") for c in place])

        def met(_, rows, others):
            if not len(rows) or not len(others):
                return _frame(1, 0, [])
            x, label = Lists.of_chunk(rows[place], percent, others[[f"g_{c}" for c in place]].set_axis(place, axis=1))
            return _frame(1, 0, [tuple(sorted((x.sids[a], x.sids[b]))) for a, b in sorted(probe(x, label))])

        return homes.groupBy("token", "chunk", "grp").cogroup(guests.groupBy("to", "at", "of")).applyInPandas(met, PAIRS)

    def probed(probe, labels, name):
        """Verified links among the pairs that ``probe`` finds in the lists, given the components so far."""

        def of_shard(_, frame, labelled):
            if not len(frame):
                return _frame(1, 0, [])
            x = Lists(list(frame.sort_values("block")["data"]), percent)
            number = {s: i for i, s in enumerate(x.sids)}
            label, codes = np.arange(len(x.sids)) + len(labelled), {}
            for node, lab in zip(labelled["node"], labelled["label"], strict=True):
                label[number[bytes(node)]] = codes.setdefault(bytes(lab), len(codes))
            return _frame(1, 0, [tuple(sorted((x.sids[a], x.sids[b]))) for a, b in sorted(probe(x, label))])

        labelled = here.join(labels, "node").repartition(tasks, "shard")
        pairs = lists.groupBy("shard").cogroup(labelled.groupBy("shard")).applyInPandas(of_shard, PAIRS)
        if hot is not None and (more := visited(probe, labels)) is not None:
            pairs = pairs.unionByName(more)
        pairs = scratch.write(pairs.select("a", "b").distinct(), name)
        return scratch.write(_verified(pairs, whole, percent), "links")

    for probe, name in ((Lists.nearest, "round2"), (Lists.across, "round3")):
        more = probed(probe, labels, name)
        if not more.isEmpty():
            labels = extended(labels, more, scratch)

    def rows_of(frames):
        for frame in frames:
            for sids, data in zip(frame["sid"], frame["data"], strict=True):
                ids, size = pickle.loads(data)
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": size, "sid": [bytes(sids[16 * i : 16 * i + 16]) if z else None for i, z in enumerate(size)]})

    rows = listed_rows.where(F.col("kind") == DOCUMENTS).select("sid", "data").mapInPandas(rows_of, "doc_id long, n_shingles long, sid binary")
    kinds = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    kinds = kinds.join(labels.withColumnRenamed("node", "sid"), "sid", "left").where("n > 1 or label is not null").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    kinds = scratch.write(kinds, "kinds")
    least = scratch.write(kinds.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    named = scratch.write(kinds.select("sid", "label").join(least, "label").select("sid", "component_id"), "named")
    return rows.join(named, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def check(frames):
        for f in frames:
            keep = []
            for xs, ys, nx, ny in zip(f["xs"], f["ys"], f["nx"], f["ny"], strict=True):
                both = len(np.intersect1d(np.frombuffer(xs, U), np.frombuffer(ys, U), assume_unique=True))
                keep.append(100 * both >= percent * (nx + ny - both))
            yield f.loc[keep, ["a", "b"]]

    x = whole.select(F.col("sid").alias("a"), F.col("size").alias("nx"), F.col("data").alias("xs"))
    y = whole.select(F.col("sid").alias("b"), F.col("size").alias("ny"), F.col("data").alias("ys"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(check, "a binary, b binary")

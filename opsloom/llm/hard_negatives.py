"""Hard negatives by orthogonal PCA rotation.

Each component becomes ``floor(scale * x)``; a pair's score is the whole-number inner product. All vectors are turned into
the axes of their second moments, which keeps products and puts most of a vector's length into its leading components.
A pair is then scored a few components at a time: the partial product plus the product of what is left of both lengths,
plus a slack for rounding, bounds the score from above (and, taken off, from below). Pairs that cannot reach what an anchor
still needs are discarded at once, and the survivors are verified by the product of the whole numbers, so the answer does
not depend on rounding or on the rotation, which is only a matter of speed.

Rows are packed into stretches and dealt to groups of ``GROUP_BYTES``; anchors, a set number of rows given by their ids, to
groups of ``ANCHOR_BYTES``. Each pair of groups is a task of its own, so what a task holds does not grow with the table, nor
with how many rows share a label or a vector. A task answers each anchor with what a whole answer can use, and the
tasks' answers are merged by anchor. Two rounds: the first finds an anchor's positives, the second, knowing their
scores, the negatives of each.

The moments are summed over all rows, in two steps; they and the rotations (one for each of the ``ROTATED`` most frequent
numbers of components, up to ``MAX_SIZE``) are all that is broadcast. Other vectors are scored unrotated.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; vectors are
compared with those of as many components, empty ones score 0; an anchor is a row, others are rows of another id; repeated
rows are rows of their own, as anchors and as answers; components and scores beyond 64 bits are cut to the last number
on either side (``LAST``), ties among them going by id; an anchor without positives, or whose positives' scores are
negative, has no negatives; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Scratch

PACKED = "part long, d int, n int, n_bytes long, keys binary, ids binary, labels binary, x binary"
ANCHOR = "akey long, d int, anchor_id long, label long, x binary"
STRETCH, GROUP_BYTES, ANCHOR_BYTES, AT_ONCE = 4096, 32 << 20, 8 << 20, 512
ROTATED, MAX_SIZE = 8, 2048
LAST = (1 << 63) - 1
NONE = -(1 << 63)
EPS = float(np.finfo(float).eps)


def _clean(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(f"vec_id is not null and label is not null and v is not null and coalesce({finite}, false)")


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(scale * v)
    big = np.abs(x) >= 2.0**63
    out = np.where(big, 0, x).astype(np.int64)
    out[big] = np.where(x[big] > 0, LAST, -LAST)
    return out


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold all, which the first byte names."""
    for kind in ("<i2", "<i4"):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return kind[2].encode() + x.astype(kind).tobytes()
    return b"8" + x.astype("<i8").tobytes()


def _large(data: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64).reshape(n, d)


def _pack(rows: DataFrame, scale: int) -> DataFrame:
    """Stretches of rows of as many components; each row gets a number of its own."""

    def pack(frames):
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId() << 40, 0
        for f in frames:
            sizes = f["v"].map(len).to_numpy()
            for d in np.unique(sizes).tolist():
                own = f[sizes == d]
                for a in range(0, len(own), STRETCH):
                    some = own.iloc[a : a + STRETCH]
                    x = _whole(np.array(some["v"].tolist(), np.float64).reshape(len(some), d), scale)
                    ids, labels = (some[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
                    keys = np.arange(task + at, task + at + len(some))
                    yield pd.DataFrame({"part": [task + at], "d": d, "n": len(some), "n_bytes": len(data := _small(x)) + 24 * len(some), "keys": [keys.tobytes()], "ids": [ids], "labels": [labels], "x": [data]})
                    at += len(some)

    return rows.mapInPandas(pack, PACKED)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _moments(packed: DataFrame, d: int) -> np.ndarray:
    """Sum of every vector's products of components: added up in tasks, then in 64 groups, then in one."""

    def partial(frames):
        from pyspark import TaskContext

        total = np.zeros((d, d))
        for f in frames:
            for data, n in zip(f["x"], f["n"], strict=True):
                x = _large(data, d, n).astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % 64], "m": [total.tobytes()]})

    def add(f):
        return pd.DataFrame({"g": [0], "m": [sum(np.frombuffer(m) for m in f["m"]).tobytes()]})

    sums = packed.where(F.col("d") == d).select("x", "n").mapInPandas(partial, "g int, m binary")
    for _ in range(2):
        sums = sums.groupBy("g").applyInPandas(add, "g int, m binary")
    got = sums.collect()
    return np.frombuffer(got[0].m).reshape(d, d) if got else np.zeros((d, d))


def rotation(moments: np.ndarray) -> np.ndarray:
    """Orthonormal axes in rows, that of the largest moment first."""
    if not np.isfinite(moments).all():
        return np.eye(len(moments))
    return np.linalg.eigh(moments)[1].T[::-1].copy()


class Turned:
    """Vectors beside their turned selves, and the length that is left of each behind each cut."""

    def __init__(self, x: np.ndarray, axes: np.ndarray | None):
        self.x, y = x, x.astype(np.float64)
        self.norm = np.sqrt((y * y).sum(axis=1))
        self.y, d = (y if axes is None else y @ axes.T), x.shape[1]
        self.cuts = sorted({-(-d // 8), -(-d // 4), -(-d // 2), d} - {0}) or [0]
        behind = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1] if d else np.zeros((len(x), 0))
        self.left = [np.sqrt(behind[:, c]) if c < d else np.zeros(len(x)) for c in self.cuts]

    def take(self, rows) -> Turned:
        out = object.__new__(Turned)
        out.x, out.y, out.norm, out.cuts, out.left = self.x[rows], self.y[rows], self.norm[rows], self.cuts, [c[rows] for c in self.left]
        return out


def survivors(a: Turned, b: Turned, need: np.ndarray, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) whose product may lie between ``need`` and ``top`` of the row of ``a``. The
    product is added up cut by cut: for whole blocks while many pairs are left, then for the pairs left alone."""
    slack, ceiling = 16 * (a.x.shape[1] + 8) * EPS, np.full(len(need), np.inf) if top is None else np.where(top >= LAST, np.inf, top)
    # scores were cut at the last numbers, products are not
    need, total, start, i, j = np.where(need <= -LAST, -np.inf, need), np.zeros((len(a.x), len(b.x))), 0, None, None
    for cut, la, lb in zip(a.cuts, a.left, b.left, strict=True):
        if i is None:
            total += a.y[:, start:cut] @ b.y[:, start:cut].T
            more = np.outer(la, lb) + slack * np.outer(a.norm, b.norm)
            stay = (total + more >= need[:, None]) & (total - more <= ceiling[:, None])
            if stay.sum() * 8 < stay.size:
                i, j = np.nonzero(stay)
                total = total[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a.y[i, start:cut], b.y[j, start:cut])
            more = la[i] * lb[j] + slack * a.norm[i] * b.norm[j]
            stay = (total + more >= need[i]) & (total - more <= ceiling[i])
            i, j, total = i[stay], j[stay], total[stay]
        start = cut
    return np.nonzero(stay) if i is None else (i, j)


def exact(a: Turned, i: np.ndarray, b: Turned, j: np.ndarray) -> np.ndarray:
    """Inner products of the whole numbers: no sum on the way is larger than the product of both lengths, which says
    in what they are exact."""
    out, bound = np.zeros(len(i), np.int64), a.norm.max(initial=0) * b.norm.max(initial=0)
    for s in range(0, len(i), 1 << 16):
        x, y = a.x[i[s : s + (1 << 16)]], b.x[j[s : s + (1 << 16)]]
        if bound < 2.0**52:
            out[s : s + len(x)] = np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64)).astype(np.int64)
        elif bound < 2.0**62:
            out[s : s + len(x)] = np.einsum("ij,ij->i", x, y)
        else:
            out[s : s + len(x)] = [max(-LAST, min(LAST, sum(p * q for p, q in zip(u, v, strict=True)))) for u, v in zip(x.tolist(), y.tolist(), strict=True)]
    return out


class Best:
    """The ``k`` first of each row: largest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(i):
            return
        rows = np.unique(i)
        old = self.score[rows] > NONE
        i = np.concatenate((i, np.repeat(rows, self.k)[old.ravel()]))
        score, ids = np.concatenate((score, self.score[rows][old])), np.concatenate((ids, self.ids[rows][old]))
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        self.score[i[keep], place[keep]], self.ids[i[keep], place[keep]] = score[keep], ids[keep]

    def found(self):
        row, place = np.nonzero(self.score > NONE)
        return row, self.score[row, place], self.ids[row, place]


def _stretches(rows: pd.DataFrame, axes: np.ndarray | None, d: int):
    for r in rows.sort_values("part").to_dict("records"):
        yield Turned(_large(r["x"], d, r["n"]), axes), _longs(r["ids"]), _longs(r["labels"])


def _own(found: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """For each row whose id is divisible by ``every`` and each of its ``positives`` nearest rows of the same label: the
    ``negatives`` nearest rows of other labels that score at least ``least_percent`` of the positive's score and at most
    as much: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    packed = scratch.write(_pack(_clean(vectors, key, vector, label), scale), "packed", "none")
    sizes = packed.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(ROTATED).collect()
    axes = spark.sparkContext.broadcast({s.d: rotation(_moments(packed, s.d)) for s in sizes if 1 < s.d <= MAX_SIZE})

    def anchors_of(frames):
        for f in frames:
            for r in f.to_dict("records"):
                ids = _longs(r["ids"])
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x = _large(r["x"], r["d"], r["n"])[at]
                    yield pd.DataFrame({"akey": _longs(r["keys"])[at], "d": r["d"], "anchor_id": ids[at], "label": _longs(r["labels"])[at], "x": [_small(v) for v in x]})

    anchors = scratch.write(packed.mapInPandas(anchors_of, ANCHOR), "anchors", "none")
    facts = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    asked = anchors.agg(F.coalesce(F.sum(8 * F.col("d") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-facts.b // GROUP_BYTES), min(facts.n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    anchor_groups = max(1, -(-asked // ANCHOR_BYTES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = packed.withColumn("r", deal("part", groups)).withColumn("g", all_of(anchor_groups)).groupBy("d", "g", "r")

    def met(side: DataFrame, f, schema: str) -> DataFrame:
        side = side.withColumn("g", deal("akey", anchor_groups)).withColumn("r", all_of(groups))
        return rows.cogroup(side.groupBy("d", "g", "r")).applyInPandas(f, schema)

    def held(side: pd.DataFrame, d: int) -> Turned:
        return Turned(np.concatenate([_large(x, d, 1) for x in side["x"]]), axes.value.get(d))

    def near(cell, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"akey": [], "positive_id": [], "positive_score": []}, dtype=np.int64)
        d = int(cell[0])
        a, best = held(right, d), Best(len(right), positives)
        own, label_of = right["anchor_id"].to_numpy(np.int64), right["label"].to_numpy(np.int64)
        for b, ids, labels in _stretches(left, axes.value.get(d), d):
            for one in np.intersect1d(labels, label_of).tolist():
                who, whom = np.flatnonzero(label_of == one), np.flatnonzero(labels == one)
                for s in range(0, len(who), AT_ONCE):
                    some = who[s : s + AT_ONCE]
                    i, j = survivors(a.take(some), b.take(whom), best.score[some, -1])
                    i, j = some[i], whom[j]
                    other = own[i] != ids[j]
                    i, j = i[other], j[other]
                    best.add(i, exact(a, i, b, j), ids[j])
        row, score, other = best.found()
        return pd.DataFrame({"akey": right["akey"].to_numpy()[row], "positive_id": other, "positive_score": score})

    pairs = _own(met(anchors, near, "akey long, positive_id long, positive_score long"), ["akey"], "positive_score", "positive_id", positives)
    pairs = pairs.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    pairs = scratch.write(anchors.join(pairs, "akey").select(*anchors.columns, F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores")), "positives", "none")

    def far(cell, left, right):
        schema = ("akey", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in schema}, dtype=np.int64)
        d, n = int(cell[0]), len(right)
        a, label_of = held(right, d), right["label"].to_numpy(np.int64)
        high = np.full((n, positives), NONE)
        for k, scores in enumerate(right["p_scores"]):
            high[k, : len(scores)] = scores
        # 100 * negative >= least_percent * positive; for whole numbers of any size, without leaving 64 bits
        low = high // 100 * least_percent + -(-(high % 100 * least_percent) // 100)
        open_ = (high > NONE) & (low <= high)
        low = np.where(open_, low, LAST)
        top, bests = np.where(open_, high, NONE).max(axis=1), [Best(n, negatives) for _ in range(positives)]
        wanted = np.flatnonzero(open_.any(axis=1))
        for b, ids, labels in _stretches(left, axes.value.get(d), d):
            for s in range(0, len(wanted), AT_ONCE):
                some = wanted[s : s + AT_ONCE]
                need = np.stack([np.where(open_[some, k], np.maximum(low[some, k], bests[k].score[some, -1]), LAST) for k in range(positives)], axis=1)
                i, j = survivors(a.take(some), b, need.min(axis=1), top[some])
                differ = label_of[some[i]] != labels[j]
                i, j = i[differ], j[differ]
                score = exact(a, some[i], b, j)
                for k in range(positives):
                    may = open_[some[i], k] & (score >= need[i, k]) & (score <= high[some[i], k])
                    bests[k].add(some[i[may]], score[may], ids[j[may]])
        out = []
        for k in range(positives):
            row, score, other = bests[k].found()
            if len(row):
                own = right.iloc[row]
                out.append(pd.DataFrame({"akey": own["akey"].to_numpy(), "anchor_id": own["anchor_id"].to_numpy(), "place": k, "positive_id": [p[k] for p in own["p_ids"]], "positive_score": high[row, k], "negative_id": other, "negative_score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in schema}, dtype=np.int64)

    found = met(pairs, far, "akey long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _own(found, ["akey", "place"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

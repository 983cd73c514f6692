"""Approximate nearest neighbours by balanced posting lists.

Fit (on a sample of ``SAMPLE`` vectors, or ``PER_LIST`` a list if more: 131,072 at most): vectors are halved along the
line between two means, again and again, so that lists come out of equal size; their means are the centroids, numbered
so that neighbours in the tree of cuts have neighbouring numbers. Index (every vector): each goes to its nearest
centroid's list and, if it lies near a boundary, to the next ones whose distance is within a ratio of the nearest
(``COPIES`` lists at most). Search: a best-first walk over an in-memory neighbour graph of the centroids, which meets
only centroids next to those already found near, finds the nearest lists, ``PROBE`` of them or, if more, the fixed share
``PROBE_SHARE`` of all, so that recall does not fall as the index grows; those within a distance ratio of the nearest
are read, and their vectors are scored exactly. Largest inner product becomes least distance by one more coordinate
that fills all vectors up to the longest norm.

``REGION`` neighbouring lists lie in one task, to which a query goes once with the numbers of its lists, and which
answers with what a whole answer can use. A list larger than ``CHUNK`` is dealt over several tasks by a hash, and its
queries go to each of them, so no task gets a whole hot list. Equal vectors are one entry with its least ids (as many
as an answer can use, cut per task before the shuffle). The graph is broadcast; ``MAX_LISTS`` bounds it and the sample.
Beyond that many lists (two million vectors) lists grow longer instead of more, and are dealt.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
take no part; vectors are compared with those of as many components; equal (id, vector) rows count once; equal scores
go by the smaller id wherever a cut is made; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Scratch

SCHEMA = "query_id long, rank int, vec_id long, score double"
SAMPLE, PER_LIST, LIST, MAX_LISTS, CHUNK, REGION = 20_000, 8, 128, 16_384, 4096, 16
COPIES, COPY_RATIO, PROBE, PROBE_SHARE, PROBE_RATIO, DEGREE = 4, 1.1, 64, 1 / 6, 1.6, 16


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Means of ``n_lists`` equal parts (fewer if there are not so many vectors), in the order of the tree of cuts."""
    rng, out, left = np.random.default_rng(seed), [], [(np.arange(len(x)), n_lists)]
    while left:
        own, n = left.pop()
        y = x[own]
        if n < 2 or len(own) < 2:
            out.append(y.mean(axis=0))
            continue
        a, b = y[rng.choice(len(y), 2, replace=False)]
        for _ in range(4):
            near = ((y - a) ** 2).sum(axis=1) < ((y - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = y[near].mean(axis=0), y[~near].mean(axis=0)
        order, k = np.argsort(y @ (a - b), kind="stable"), n // 2
        cut = min(max(1, len(own) * k // n), len(own) - 1)
        left += [(own[order[cut:]], n - k), (own[order[:cut]], k)]
    return np.stack(out)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(d, 0))


class Graph:
    """Centroids with their nearest neighbours as links, walked best first for many queries at once."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c, n = centroids, len(centroids)
        degree = min(degree, max(1, n - 1))
        near = np.zeros((n, degree), np.int64)
        for a in range(0, n, 1024):
            d = distances(centroids[a : a + 1024], centroids)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        # both ways; of the links that come back to a centroid as many stay as it has itself
        to, back = near.ravel(), np.repeat(np.arange(n), degree)
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        self.links = np.concatenate((near, np.repeat(np.arange(n)[:, None], degree + 1, axis=1)), axis=1)
        some = place < degree
        self.links[to[some], degree + place[some]] = back[some]
        self.links[:, -1] = (np.arange(n) + 1) % n  # a ring over the centroids keeps every one in reach
        self.entry = int(((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1).argmin())

    def search(self, q: np.ndarray, width: int, at_once: int = 8):
        """Numbers of and distances to the ``width`` nearest centroids found, nearest first (inf: no more). Each round
        follows the links of the ``at_once`` nearest that were not followed yet, among the nearest found."""
        n, m = len(self.c), len(q)
        width = min(width, n)
        found, dist = np.full((m, width), -1), np.full((m, width), np.inf)
        done, seen = np.zeros((m, width), bool), np.zeros((m, n), bool)
        found[:, 0], seen[:, self.entry] = self.entry, True
        dist[:, 0] = np.sqrt(((q - self.c[self.entry]) ** 2).sum(axis=1))
        rows, k = np.arange(m), min(at_once, width)
        while len(rows):
            d = np.where(done[rows], np.inf, dist[rows])
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            go = np.isfinite(np.take_along_axis(d, best, axis=1))
            rows, best, go = rows[go.any(axis=1)], best[go.any(axis=1)], go[go.any(axis=1)]
            if not len(rows):
                break
            r, c = np.repeat(rows, k)[go.ravel()], best[go]
            done[r, c] = True
            to = self.links[found[r, c]]
            key = np.unique((np.repeat(r, to.shape[1]) * n + to.ravel())[~seen[np.repeat(r, to.shape[1]), to.ravel()]])
            r, c = key // n, key % n
            seen[r, c] = True
            far = np.sqrt(((q[r] - self.c[c]) ** 2).sum(axis=1))
            # the new ones beside the old ones of their row; the nearest stay
            line = np.searchsorted(rows, r)
            place = np.arange(len(r)) - np.searchsorted(line, line)
            more = int(place.max(initial=-1)) + 1
            own, own_dist, own_done = (np.concatenate((x[rows], np.full((len(rows), more), fill)), axis=1) for x, fill in ((found, -1), (dist, np.inf), (done, False)))
            own[line, width + place], own_dist[line, width + place] = c, far
            keep = np.argpartition(own_dist, width - 1, axis=1)[:, :width]
            found[rows], dist[rows], done[rows] = (np.take_along_axis(x, keep, axis=1) for x in (own, own_dist, own_done))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(found, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return v.where(f"vec_id is not null and v is not null and coalesce({finite}, false)").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def best_of(x: np.ndarray, least: np.ndarray, z: np.ndarray, n: int):
    """The ``n`` best rows of ``x`` for each row of ``z`` as (row of z, row of x, score): by inner product, summed one
    component after the other, then by ``least``. Products in any order choose whom to score; all that may reach the
    last place, which rounding bounds, are scored."""
    out, n = [], min(n, len(x))
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1).max(initial=0))
    for a in range(0, len(z), 32):
        y = z[a : a + 32]
        about = y @ x.T
        cut = np.partition(about, len(x) - n, axis=1)[:, len(x) - n] - slack * np.sqrt((y * y).sum(axis=1))
        row, col = np.nonzero(about >= cut[:, None])
        score = np.cumsum(x[col] * y[row], axis=1)[:, -1]
        out.append(_first(row + a, col, score, least[col], n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _first(row, col, score, least, n):
    """The ``n`` first of each row, by score from the largest and then by the least id."""
    order = np.lexsort((least, -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], col[keep], score[keep]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, probe: int = PROBE, probe_share: float = PROBE_SHARE, probe_ratio: float = PROBE_RATIO, scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest others found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch, rows = scratch or Scratch(spark), _clean(vectors, key, vector)
    sizes = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())
    out = spark.createDataFrame([], SCHEMA)
    for d in sizes:
        found = _nearest(rows.where(F.size("v") == d), k, every, sample, probe, probe_share, probe_ratio, scratch)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def _nearest(rows: DataFrame, k: int, every: int, sample: int, probe: int, probe_share: float, probe_ratio: float, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    first = Window.partitionBy("v").orderBy("vec_id")
    kinds = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def pack(frames):
        for f in frames:
            x = [np.asarray(v, np.float64) for v in f["v"]]
            yield pd.DataFrame({"name": f["name"], "ids": f["ids"], "raw": [v.tobytes() for v in x], "norm": [float(np.sqrt((v * v).sum())) for v in x]})

    kinds = scratch.write(kinds.withColumn("name", F.md5(F.to_json(F.struct("v")))).mapInPandas(pack, "name string, ids array<bigint>, raw binary, norm double"), "vectors")
    facts = kinds.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    n_lists = int(min(MAX_LISTS, max(1, facts.n // LIST)))
    probe, sample = max(probe, math.ceil(probe_share * n_lists)), max(sample, PER_LIST * n_lists)
    share = min(1.0, sample / facts.n)
    picked = kinds.where(F.pmod(F.xxhash64("name"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("name").limit(2 * sample).select("raw").collect() or kinds.limit(1).select("raw").collect()
    top = facts.norm

    def lift(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))[:, None]), axis=1)

    x = lift(_matrix([r.raw for r in picked]))
    graph = spark.sparkContext.broadcast(Graph(balanced_centroids(x, n_lists)))

    def place(frames):
        g = graph.value
        for frame in frames:
            for a in range(0, len(frame), 1024):
                f = frame.iloc[a : a + 1024]
                d = distances(lift(_matrix(f["raw"])), g.c)
                near = np.argpartition(d, min(COPIES, len(g.c)) - 1, axis=1)[:, :COPIES]
                dn = np.take_along_axis(d, near, axis=1)
                row, col = np.nonzero(dn <= COPY_RATIO * dn.min(axis=1, keepdims=True) + 1e-12)
                yield pd.DataFrame({"list": near[row, col], "name": f["name"].to_numpy()[row], "ids": f["ids"].to_numpy()[row], "raw": f["raw"].to_numpy()[row]})

    postings = scratch.write(kinds.select("name", "ids", "raw").mapInPandas(place, "list long, name string, ids array<bigint>, raw binary"), "postings")
    parts_of = np.ones(len(graph.value.c), np.int64)
    for r in postings.groupBy("list").count().where(F.col("count") > CHUNK).collect():
        parts_of[r["list"]] = -(-r["count"] // CHUNK)
    parts = spark.sparkContext.broadcast(parts_of)

    def dealt(frames):
        for f in frames:
            n = parts.value[f["list"].to_numpy()]
            hashed = np.array([int(x[:12], 16) for x in f["name"]], np.int64)
            yield f.assign(region=f["list"] // REGION, part=(hashed % n).astype(np.int32))

    def route(frames):
        """A row for each region and part that holds a list of the query's, with its lists there."""
        g = graph.value
        for f in frames:
            for a in range(0, len(f), 256):
                own = f.iloc[a : a + 256]
                q = _matrix(own["raw"])
                near, d = g.search(np.concatenate((q, np.zeros((len(q), 1))), axis=1), probe)
                row, col = np.nonzero((d <= probe_ratio * d[:, :1] + 1e-12) & np.isfinite(d))
                lists = near[row, col]
                n = parts.value[lists]
                row, lists, part = np.repeat(row, n), np.repeat(lists, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((lists, part, lists // REGION, row))
                row, lists, part = row[order], lists[order], part[order]
                key = np.stack((row, lists // REGION, part), axis=1)
                cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
                yield pd.DataFrame({"region": key[cut, 1], "part": key[cut, 2].astype(np.int32), "lists": np.split(lists, cut[1:]), "name": own["name"].to_numpy()[row[cut]], "raw": own["raw"].to_numpy()[row[cut]]})

    asking = scratch.write(rows.where(F.col("vec_id") % every == 0).distinct().select("vec_id", F.md5(F.to_json(F.struct("v"))).alias("name")), "asking")
    queries = kinds.join(asking.select("name").distinct(), "name", "left_semi").select("name", "raw").mapInPandas(route, "region long, part int, lists array<bigint>, name string, raw binary")
    postings = postings.mapInPandas(dealt, "list long, name string, ids array<bigint>, raw binary, region long, part int")

    def score(_, p, q):
        if not len(p) or not len(q):
            return pd.DataFrame({"query": [], "name": [], "ids": [], "score": []}, dtype=object)
        x, y = _matrix(p["raw"]), _matrix(q["raw"])
        own, least = p["list"].to_numpy(), np.array([i[0] for i in p["ids"]])
        asked = np.repeat(np.arange(len(q)), [len(c) for c in q["lists"]])
        lists, found = np.concatenate(q["lists"].to_list()), []
        for c in np.unique(lists).tolist():
            here, who = np.flatnonzero(own == c), asked[lists == c]
            if len(here):
                row, col, s = best_of(x[here], least[here], y[who], k + 1)
                found.append((who[row], here[col], s))
        if not found:
            return pd.DataFrame({"query": [], "name": [], "ids": [], "score": []}, dtype=object)
        row, col, s = (np.concatenate(c) for c in zip(*found, strict=True))
        # a copy of a vector in another list of the region counts once
        name = np.unique(p["name"].to_numpy().astype(str), return_inverse=True)[1]
        once = np.unique(np.stack((row, name[col]), axis=1), axis=0, return_index=True)[1]
        row, col, s = _first(row[once], col[once], s[once], least[col[once]], k + 1)
        return pd.DataFrame({"query": q["name"].to_numpy()[row], "name": p["name"].to_numpy()[col], "ids": p["ids"].to_numpy()[col], "score": s})

    found = postings.groupBy("region", "part").cogroup(queries.groupBy("region", "part")).applyInPandas(score, "query string, name string, ids array<bigint>, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.dropDuplicates(["query", "name"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    found = found.select("query", "score", F.explode("ids").alias("vec_id"))
    answer = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = found.join(asking.select(F.col("vec_id").alias("query_id"), F.col("name").alias("query")), "query").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", F.row_number().over(answer)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

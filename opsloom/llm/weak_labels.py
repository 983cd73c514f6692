"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on each whole text. Their votes over the whole corpus
are counted by pattern (at most 3 to the number of labellers) and expectation-maximisation estimates, for each
labeller, how often it votes which way on good and on bad documents, and how many documents are good. The
posterior of each pattern is the label on which a hashed linear scorer (logistic regression over byte n-gram
presence) is trained, on at most about ``SAMPLE`` documents; it then scores every whole text.

Defined results: null and empty texts get votes like any other and score on no n-grams; repeated rows are
scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .language_id import presence

SCHEMA = "doc_id long, votes string, label double, score double, keep boolean"
SAMPLE, EPOCHS, RATE, DECAY = 3000, 12, 0.5, 1e-4
NAMES = ("symbols", "symbol_words", "letters", "capitals", "word_length", "repetition", "repeated_triples", "sentences", "length")

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|@^~<>{}[]\\=_+`", np.uint8))
_UPPER, _LETTER = B.table([(65, 90)]), B.table([(65, 90), (97, 122), (128, 255)])
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def votes_of(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """One row a text, one column a labeller."""
    n = len(lens)
    start = np.concatenate(([0], np.cumsum(lens + 1)))[:n]
    buf = np.full(len(data) + n, 10, np.uint8)
    keep = np.ones(len(buf), bool)
    keep[start + lens] = False
    buf[keep] = data

    def share(table):
        sums = np.concatenate(([0], np.cumsum(table[buf])))
        return sums[start + lens] - sums[start]

    starts, ends = B.find_words(buf, B.BLANK)
    doc = np.searchsorted(start, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    h = B.hash_words(buf, starts, ends)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    # triples of words, in documents of a few words at least
    triple = B.Rolling(h, B.BASES[0]).windows(3)
    triple_doc = doc[: len(triple)]
    inside = triple_doc == doc[2 : 2 + len(triple)] if len(triple) else np.zeros(0, bool)
    triple, triple_doc = triple[inside], triple_doc[inside]
    order3 = np.lexsort((triple, triple_doc))
    new3 = np.ones(len(triple), bool)
    new3[1:] = (triple[order3][1:] != triple[order3][:-1]) | (triple_doc[order3][1:] != triple_doc[order3][:-1])
    triples = np.bincount(triple_doc, minlength=n)
    fresh = np.bincount(triple_doc[order3][new3], minlength=n) / np.maximum(triples, 1)
    odd = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
    odd_words = np.bincount(doc, odd[ends] > odd[starts], n)
    size, some, letters = np.maximum(lens, 1), np.maximum(words, 1), np.maximum(share(_LETTER), 1)
    symbols, upper, stops = share(_SYMBOL) / size, share(_UPPER) / letters, share(_STOP) / some
    odd_words, lettered = odd_words / some, share(_LETTER) / np.maximum(lens - share(B.BLANK), 1)
    mean = np.bincount(doc, ends - starts, n) / some
    varied = distinct / some

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack(
        [
            vote(symbols < 0.004, symbols > 0.02),
            vote(odd_words < 0.03, odd_words > 0.15),
            vote(lettered > 0.93, lettered < 0.88),
            vote(upper < 0.12, upper > 0.4),
            vote((mean > 3.2) & (mean < 10), (mean <= 2) | (mean >= 12)),
            vote((varied > 0.5) | (words < 60), (varied < 0.3) & (words >= 60)),
            vote((fresh > 0.7) | (triples < 20), (fresh < 0.5) & (triples >= 20)),
            vote((stops > 1 / 60) & (stops < 1 / 4), ((stops == 0) & (words > 30)) | (stops > 0.5)),
            vote(words >= 40, words < 12),
        ],
        axis=1,
    ).astype(np.int8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """EM over vote patterns: posterior of good for each, the labellers' accuracies on good and bad documents,
    and the share of good ones. Labellers are taken as independent given the label. Accuracies are estimated freely; that
    a bad vote starts as a bad label only says which of the two classes is which."""
    counts = counts.astype(np.float64)
    post = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        chance = []
        for w in (counts * (1 - post), counts * post):
            c = np.einsum("p,pjv->jv", w, hot) + 1.0
            chance.append(c / c.sum(axis=1, keepdims=True))
        prior = np.clip((counts * post).sum() / max(counts.sum(), 1e-9), 1e-3, 1 - 1e-3)
        log = np.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", hot, np.log(chance[1]) - np.log(chance[0]))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, {"good": chance[1][:, 2], "bad": chance[0][:, 0], "wrong": chance[1][:, 0], "prior": prior}


def _pattern(v: np.ndarray) -> str:
    return "".join("-0+"[x + 1] for x in v)


def train(bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the hashed scorer (the last is the constant): logistic regression by mini-batches, with good
    and bad posterior mass in balance; rows are scaled to unit length."""
    w = np.zeros(bits.shape[1] * 8 + 1)
    rng = np.random.default_rng(11)
    good = max(label.sum(), 1e-9)
    bad = max((1 - label).sum(), 1e-9)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bits))
        for a in range(0, len(order), 128):
            own = order[a : a + 128]
            x = np.unpackbits(bits[own], axis=1).astype(np.float32)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))
            y = label[own]
            g = (y * (1 - p) / good - (1 - y) * p / bad) * len(bits) / 2
            step = RATE * 8 / (1 + epoch)
            w[:-1] = (1 - DECAY * step) * w[:-1] + step * (x.T @ g) / len(own)
            w[-1] += step * g.mean() / 4
    return w


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, votes (one sign a labeller), label (posterior), score (0 to 1), keep."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def with_votes(batches, then):
        for batch in batches:
            data, lens = B.flat(batch.column(1))
            lens = np.maximum(lens, 0)
            at = np.concatenate(([0], np.cumsum(lens)))
            for a in range(0, len(lens), 256):
                z = min(a + 256, len(lens))
                own = data[at[a] : at[z]]
                yield then(batch.slice(a, z - a), own, lens[a:z], [_pattern(v) for v in votes_of(own, lens[a:z])])

    def only_votes(batch, _, __, names):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["votes"])

    counted = rows.mapInArrow(lambda b: with_votes(b, only_votes), "votes string").groupBy("votes").count().collect()
    if not counted:
        return spark.createDataFrame([], SCHEMA)
    counted.sort(key=lambda r: r.votes)
    patterns = np.array([["-0+".index(c) - 1 for c in r.votes] for r in counted])
    post, _ = estimate(patterns, np.array([r["count"] for r in counted]))
    label_of = {r.votes: float(p) for r, p in zip(counted, post, strict=True)}

    share = sample / sum(r["count"] for r in counted)

    def features(batch, data, lens, names):
        packed = np.packbits(presence(data, lens), axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([p.tobytes() for p in packed], pa.binary())], ["doc_id", "votes", "bits"])

    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).limit(2 * sample)
    taken = sorted((r.doc_id is None, r.doc_id or 0, r.votes, bytes(r.bits)) for r in picked.mapInArrow(lambda b: with_votes(b, features), "doc_id long, votes string, bits binary").collect())
    weights = train(np.stack([np.frombuffer(x[3], np.uint8) for x in taken]), np.array([label_of[x[2]] for x in taken])) if taken else None
    shared = spark.sparkContext.broadcast((label_of, None if weights is None else weights.astype(np.float32)))

    def scored(batch, data, lens, names):
        label_of, w = shared.value
        label = np.array([label_of.get(x, 0.5) for x in names])
        if w is None:
            score = label
        else:
            x = presence(data, lens).astype(np.float32)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            score = 1 / (1 + np.exp(-np.clip((x @ w[:-1] + w[-1]).astype(np.float64), -50, 50)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(label), pa.array(score), pa.array(score >= threshold)], ["doc_id", "votes", "label", "score", "keep"])

    return rows.mapInArrow(lambda b: with_votes(b, scored), SCHEMA)

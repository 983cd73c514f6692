"""Language ID with a string kernel.

Two texts are as alike as the n-grams present in both, over all lengths of a blended spectrum:
``k(x, y) = |P(x) & P(y)| / sqrt(|P(x)| * |P(y)|)``, where ``P`` are the hashed byte n-grams of one to four
bytes (ASCII letters lower-cased) that a whole text holds. ``LANDMARKS`` training texts give a Nyström map,
``phi(x) = k(x, Z) k(Z, Z)^(-1/2)``, on which one-versus-rest kernel ridge regression is solved in closed
form. Scoring a batch is two matrix products, presence by landmarks and kernel by weights.

Only the fit uses a sample: about ``SAMPLE`` training rows, or ``A_LANGUAGE`` a language if that is more, as many
from each language, picked by a hash, of which the driver gets 2 KB each. Every language that a training row has is
learned, so model and sample grow with the number of languages. Every document is scored, over its whole text.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all if no training
row has a language; a null id is never held out nor trained on; repeated rows are scored alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, flat

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
SAMPLE, LANDMARKS, BUCKETS, LONGEST = 4000, 200, 1 << 14, 4
RIDGE, SHARPNESS = 1e-2, 6.0
#: Training rows of each language at least, however many languages there are.
A_LANGUAGE = 20
STRETCH, BATCH = 1 << 19, 256


def presence(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """One row a text, one column a bucket: 1 where an n-gram of that bucket is present."""
    out = np.zeros((len(lens), BUCKETS), np.uint8)
    cells = out.reshape(-1)
    ends = np.cumsum(lens)
    for a in range(0, len(data), STRETCH):  # long texts go by in stretches that overlap
        low = LOWER[data[a : a + STRETCH + LONGEST - 1]].astype(np.uint32)
        doc = np.searchsorted(ends, np.arange(a, a + len(low)), "right")
        gram = np.zeros(len(low), np.uint32)
        for n in range(1, LONGEST + 1):
            m = len(low) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(256) + low[n - 1 :]
            ok = doc[:m] == doc[n - 1 :]
            bucket = ((gram ^ np.uint32(n * 0x1F35)) * np.uint32(0x9E3779B1)) >> np.uint32(18)
            cells[(doc[:m] * BUCKETS + bucket)[ok]] = 1
    return out


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    x, z = x.astype(np.float32), z.astype(np.float32)
    norm = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(z.sum(axis=1), 1))[None, :]
    return (x @ z.T) / norm


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray

    def score(self, x: np.ndarray):
        """Language number and probability-like score of each row of presences."""
        z = np.unpackbits(self.landmarks, axis=1)
        f = SHARPNESS * (kernel(x, z) @ self.weights)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        best = f.argmax(axis=1)
        return best, (e[np.arange(len(f)), best] / e.sum(axis=1)).astype(np.float64)


def fit_rows(bits: np.ndarray, labels: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nyström map and ridge regression on packed presences (landmarks are taken in turn from each language)."""
    turn = np.concatenate([np.flatnonzero(labels == k)[: -(-landmarks // len(languages))] for k in range(len(languages))])  # one each at least
    z = np.unpackbits(bits[turn], axis=1)
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([kernel(np.unpackbits(bits[a : a + BATCH], axis=1), z) for a in range(0, len(bits), BATCH)]).astype(np.float64) @ root
    y = np.where(labels[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, bits[turn], (root @ w).astype(np.float32))


def held_out(key) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, a_language: int = A_LANGUAGE) -> Model | None:
    """Learn from rows that are not held out and have a text and a language; None if there are none. Every language
    is learned, from about ``sample`` rows over the number of languages, ``a_language`` at least (fewer if it has
    fewer different ones)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    # copies of a row have one number, and count as one where they are picked
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()
    if not counts:
        return None
    share = max(a_language, sample // len(counts))
    below = docs.sparkSession.createDataFrame([(r.lang, max(r.least, share / r.n)) for r in counts], "lang string, below double")
    picked = rows.join(F.broadcast(below), "lang").where("u <= below").dropDuplicates(["lang", "u"]).limit(2 * share * len(counts))

    def bits(batches):
        for batch in batches:
            data, lens = flat(batch.column(1))
            at = np.concatenate(([0], np.cumsum(lens)))
            packed = [np.packbits(presence(data[at[i] : at[i + 1]], lens[i : i + 1])[0]).tobytes() for i in range(len(lens))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["u", "lang", "bits"])

    found = sorted((r.u, r.lang, bytes(r.bits)) for r in picked.select("u", "text", "lang").mapInArrow(bits, "u double, lang string, bits binary").collect())
    languages = sorted({x for _, x, _ in found})
    number = {x: i for i, x in enumerate(languages)}
    return fit_rows(np.stack([np.frombuffer(b, np.uint8) for *_, b in found]), np.array([number[x] for _, x, _ in found]), languages)


def _scored(model: Model | None, text, letter) -> tuple[np.ndarray, np.ndarray]:
    """Names and scores of a batch of texts."""
    data, lens = flat(text)
    lens = np.maximum(lens, 0)
    at = np.concatenate(([0], np.cumsum(lens)))
    letter = np.asarray(letter, bool) if len(lens) else np.zeros(0, bool)
    names, scores = np.full(len(lens), "und", object), np.zeros(len(lens))
    if model is not None:
        for a in range(0, len(lens), BATCH):
            z = min(a + BATCH, len(lens))
            best, score = model.score(presence(data[at[a] : at[z]], lens[a:z]))
            use = letter[a:z]
            names[a:z][use] = np.array(model.languages, object)[best[use]]
            scores[a:z][use] = score[use]
    return names, scores


def _letter(text) -> F.Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks: 2 KB each, as many as the fit allows
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(F.col(key)).alias("held_out"), _letter(F.col(text)).alias("letter"))

    def run(batches):
        for batch in batches:
            names, scores = _scored(shared.value, batch.column(1), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, SCHEMA)


def recognised(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose prediction is not ``und``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches):
        for batch in batches:
            names, _ = _scored(shared.value, batch.column(n), batch.column(n + 1))
            yield pa.RecordBatch.from_arrays(batch.columns[:n], batch.schema.names[:n]).filter(pa.array(names != "und", pa.bool_()))

    rows = docs.select("*", F.col(text).cast("string").alias("_text"), _letter(F.col(text)).alias("_letter"))
    return rows.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all."""
    return predict(docs, fit(docs, key, text, lang), key, text)

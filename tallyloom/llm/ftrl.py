"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 term keeps all coordinates at zero that no evidence moves, so the weights
that go to the executors are few: at most one a dimension, which bounds them (12 bytes times DIMS times classes).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, sliced
from .kernels import LOWER, U64, Words, combine, encode, mix, range_hash

DIMS = 1 << 20
#: Rows of the labelled table that a model is fitted on at most: those of the least hash of their id.
MAX_ROWS = 20_000
EPOCHS = 2
STEM = 5
#: Letters and digits, and all bytes beyond ASCII, make words.
BREAKS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


def features(texts: list[bytes], gaps: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers and feature numbers in order of place (unigrams, stems, bigrams, pairs with one word between), and words of each text.

    A stem is a longer word's first STEM bytes, as inflected words share it.

    gaps: what stands behind a word, up to the next one or the text's end, such as stops and junk, is a feature too.
    """
    words = Words([t.translate(LOWER) for t in texts], BREAKS)
    h = words.hashes
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    long_ = words.ends - words.starts > STEM
    stems = mix(range_hash(words.sums, words.starts[long_], words.starts[long_] + STEM))
    parts, owners = [h, stems], [owner, owner[long_]]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(h) > gap:
            pair = combine(np.stack([h[:-gap], h[gap:] ^ U64(salt)], 1).ravel(), 2)[::2]
            same = owner[:-gap] == owner[gap:]
            parts.append(pair[same]), owners.append(owner[:-gap][same])
    if gaps and len(h):
        last = np.append(owner[1:] != owner[:-1], True)
        until = np.where(last, words.at[owner + 1] - 1, np.append(words.starts[1:], 0))
        parts.append(mix(range_hash(words.sums, words.ends, until))), owners.append(owner)
    f = (np.concatenate(parts) >> U64(44)).astype(np.int64) % DIMS
    return np.concatenate(owners), f, np.diff(words.bounds)


class Ftrl:
    """One-against-rest models for `classes` targets; alpha, beta set the rates, l1 and l2 the shrinkage. The bias is not shrunk."""

    def __init__(self, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at)[..., None] == DIMS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, f: np.ndarray, y: np.ndarray) -> None:
        f = np.append(f, DIMS)
        w = self.weights(f)
        g = 1 / (1 + np.exp(-np.clip(w.sum(0), -35, 35))) - y
        sigma = (np.sqrt(self.n[f] + g * g) - np.sqrt(self.n[f])) / self.alpha
        self.z[f] += g - sigma * w
        self.n[f] += g * g


def fit(docs: DataFrame, labelled: DataFrame, classes: int, gaps: bool = False, max_rows: int = MAX_ROWS, epochs: int = EPOCHS):
    """docs: doc_id, text. labelled: doc_id, y (array of `classes` doubles), one row an id. Returns a broadcast (biases, coordinates, weights).

    The rows stream through one task in the order of a hash, `epochs` times over; their number is bounded by max_rows. Of several texts
    of one id the least counts, so that every run learns alike.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    sample = labelled.where("doc_id is not null").select("doc_id", "y", order.alias("at")).orderBy("at", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "at", "y").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch in sliced(batches):
            texts = [encode(t) for t in column(batch, "text").to_pylist()]
            who, f, _ = features(texts, gaps)
            order = np.argsort(who, kind="stable")
            cuts = np.searchsorted(who[order], np.arange(len(texts) + 1))
            f = f[order]
            yield {"at": column(batch, "at"), "doc_id": column(batch, "doc_id"), "y": column(batch, "y"), "f": [np.unique(f[a:b]).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]}

    def learn(batches):
        model = Ftrl(classes)
        for batch in batches:
            for y, f in zip(column(batch, "y").to_pylist(), column(batch, "f")):
                model.learn(f.values.to_numpy(), np.array(y))
        w = model.weights(np.arange(DIMS + 1))
        at = np.flatnonzero(w.any(1))
        yield {"at": at, "w": list(w[at])}

    examples = arrow_map(rows, extract, "at long, doc_id long, y array<double>, f array<int>")
    passes = examples.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", "at", "doc_id")
    model = arrow_map(ordered, learn, "at int, w array<double>").toPandas().sort_values("at")
    at = model["at"].to_numpy(np.int64)
    w = np.stack(model["w"].to_list()) if len(model) else np.zeros((0, classes))
    bias = w[at == DIMS].sum(0) if len(at) else np.zeros(classes)
    return spark.sparkContext.broadcast((bias, at[at < DIMS], w[at < DIMS]))


def dense(model) -> tuple[np.ndarray, np.ndarray]:
    """The biases, and all weights by coordinate."""
    bias, at, w = model
    out = np.zeros((DIMS, len(bias)), np.float32)
    out[at] = w
    return bias, out


def scores(texts: list[bytes], bias: np.ndarray, w: np.ndarray, used: np.ndarray, gaps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (texts x classes), and words of each text; a feature counts once a text. used: coordinates that have weights."""
    who, f, words = features(texts, gaps)
    sel = used[f]
    pairs = np.unique(who[sel] * DIMS + f[sel])
    total = np.zeros((len(texts), len(bias)))
    np.add.at(total, pairs // DIMS, w[pairs % DIMS])
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35))), words

"""A text classifier of learned subword embeddings.

Words, pairs of neighbouring words and the character n-grams within words are hashed to rows of a table of vectors; a document is the
mean of its features' vectors, and a softmax over a linear output gives the classes. Both are learnt by stochastic gradient descent in
numpy. As the output is linear in the mean, each row is put through it once after learning: what goes to the executors is one number a row
and class, 4 bytes times ROWS times the classes at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, keep_columns, sliced, tidied
from .kernels import SPACES, U64, combine, encode, mix, prefix_sums, range_value, runs
from .toxicity import held_out

#: Rows of the table of vectors, and their length.
ROWS, SIZE = 1 << 18, 16
#: Lengths in bytes of the n-grams within a word, which one space on each side belongs to.
NGRAMS = (3, 4, 5)
#: Rows of the labelled table that a model is fitted on at most: those of the least hash of their id.
MAX_ROWS = 3000
EPOCHS, RATE = 4, 4.0
THRESHOLD = 0.7
_BLANKS = bytes(32 if SPACES[b] else b for b in range(256))
_SALTS = mix(np.arange(1, 16, dtype=U64))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and table rows of all features: a constant one a text, words, pairs, n-grams. All pairs of a word with itself are one
    feature. Case and signs stand as they are, as they tell quality."""
    data = np.frombuffer(b" " + b" ".join(t.translate(_BLANKS) for t in texts) + b" ", np.uint8)
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    sums = prefix_sums(data)
    starts, ends = runs(data != 32)
    owner = np.searchsorted(at, starts, "right") - 1
    words = mix(range_value(sums, starts, ends) + (ends - starts).astype(U64))
    parts, owners = [_SALTS[:1].repeat(len(texts)), words ^ _SALTS[1]], [np.arange(len(texts)), owner]
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        pair = np.where(words[1:] == words[:-1], _SALTS[2], combine(words, 2))
        parts.append(pair[same]), owners.append(owner[1:][same])
    of_place = np.repeat(owner, ends - starts + 2)
    first = np.cumsum(ends - starts + 2) - (ends - starts + 2)
    place = np.arange(len(of_place)) - np.repeat(first, ends - starts + 2) + np.repeat(starts - 1, ends - starts + 2)
    left = np.repeat(ends + 1, ends - starts + 2) - place
    for k in NGRAMS:
        fits = left >= k
        parts.append(mix(range_value(sums, place[fits], place[fits] + k) ^ _SALTS[k])), owners.append(of_place[fits])
    return np.concatenate(owners), (np.concatenate(parts) >> U64(40)).astype(np.int64) % ROWS


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each text's features, their table rows (ascending), how often each stands there, and all features of each text."""
    who, row = features(texts)
    keys, n = np.unique(who * ROWS + row, return_counts=True)
    return np.searchsorted(keys, np.arange(len(texts) + 1) * ROWS), keys % ROWS, n, np.bincount(who, minlength=len(texts))


class Embeddings:
    """Vectors (ROWS x SIZE, small at first, by a fixed seed) and output (classes x SIZE, zero at first)."""

    def __init__(self, classes: int):
        self.vectors = ((np.random.default_rng(5).random((ROWS, SIZE), np.float32) - 0.5) / SIZE).astype(np.float32)
        self.output = np.zeros((classes, SIZE), np.float32)

    def learn(self, rows: np.ndarray, shares: np.ndarray, y: int, rate: float) -> None:
        """One step for one document: rows of its features and their shares, which sum to 1."""
        hidden = shares @ self.vectors[rows]
        p = softmax((self.output @ hidden)[None])[0]
        p[y] -= 1
        back = p @ self.output
        self.output -= rate * np.outer(p, hidden)
        self.vectors[rows] -= (rate * shares)[:, None] * back

    def table(self) -> np.ndarray:
        """What a feature adds to each class (ROWS x classes), before the division by the number of features."""
        return self.vectors @ self.output.T


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Of each text and class."""
    who, row = features(texts)
    n = np.bincount(who, minlength=len(texts))
    return softmax(np.stack([np.bincount(who, table[row, c], len(texts)) for c in range(table.shape[1])], 1) / n[:, None])


def fit(docs: DataFrame, labelled: DataFrame, classes: int, max_rows: int = MAX_ROWS, epochs: int = EPOCHS):
    """docs: doc_id, text. labelled: doc_id, y (a class from 0), one row an id. Returns a broadcast of what each feature adds to each class.

    The rows stream through one task in the order of a hash, `epochs` times over, at a rate that falls to 0; their number is bounded by
    max_rows. Of several texts of one id the least counts, so that every run learns alike. Without rows all classes are equally likely.
    """
    spark, order = docs.sparkSession, F.xxhash64("doc_id")
    sample = labelled.where("doc_id is not null and y is not null").select("doc_id", "y", order.alias("at")).orderBy("at", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "at", "y").agg(F.min("text").alias("text"))
    steps = epochs * max(min(max_rows, labelled.count()), 1)

    def extract(batches):
        for batch in sliced(batches):
            bounds, row, n, _ = counted([encode(t) for t in column(batch, "text").to_pylist()])
            each = list(zip(bounds[:-1], bounds[1:]))
            yield {"at": column(batch, "at"), "doc_id": column(batch, "doc_id"), "y": column(batch, "y"), "row": [row[a:b].astype(np.int32) for a, b in each], "n": [n[a:b].astype(np.int32) for a, b in each]}

    def learn(batches):
        model, step = Embeddings(classes), 0
        for batch in batches:
            for y, row, n in zip(column(batch, "y").to_pylist(), column(batch, "row"), column(batch, "n")):
                n = n.values.to_numpy()
                model.learn(row.values.to_numpy(), (n / n.sum()).astype(np.float32), y, RATE * max(0.0, 1 - step / steps))
                step += 1
        table = model.table()
        for a in range(0, ROWS, 1 << 16):
            yield {"at": [a], "part": [table[a : a + (1 << 16)].astype("<f4").tobytes()]}

    examples = arrow_map(rows, extract, "at long, doc_id long, y int, row array<int>, n array<int>")
    passes = examples.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    parts = arrow_map(passes.repartition(1).sortWithinPartitions("epoch", "at", "doc_id"), learn, "at int, part binary").collect()
    table = np.zeros((ROWS, classes), np.float32)
    for at, part in parts:
        table[at : at + (1 << 16)] = np.frombuffer(part, "<f4").reshape(-1, classes)
    return spark.sparkContext.broadcast(table)


def quality_model(docs: DataFrame, labels: DataFrame):
    """labels: doc_id, quality (0 or 1; null rows are left out; of several rows of an id the highest counts)."""
    known = keep_columns(labels, "doc_id", "quality").where("quality is not null").where(~held_out(F.col("doc_id")))
    return fit(keep_columns(docs, "doc_id", "text"), known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")), 2)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model=None) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns a row for each row: doc_id, held_out, score (double), predicted (int).

    A null text scores as an empty one: by the constant feature alone. Without labels every score is 0.5. Nothing but the text enters a score.
    """
    model = model or quality_model(docs, labels)

    def run(batches):
        for batch in sliced(batches):
            p = probabilities([encode(t) for t in column(batch, "text").to_pylist()], model.value)
            yield {"doc_id": column(batch, "doc_id"), "score": p[:, 1].astype(np.float64)}

    scored = arrow_map(keep_columns(docs, "doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score reaches the threshold."""
    model = quality_model(docs, labels)

    def run(batches):
        for batch in sliced(batches):
            p = probabilities([encode(t) for t in column(batch, "text").to_pylist()], model.value)
            yield batch.filter(pa.array(p[:, 1] >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)

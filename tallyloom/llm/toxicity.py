"""Toxicity scores by the model of ftrl.py."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, keep_columns, sliced, tidied
from .ftrl import dense, fit, scores
from .kernels import encode

THRESHOLD = 0.3


def held_out(doc_id):
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """labels: doc_id, toxic (0 or 1; null rows are left out; of several rows of an id the highest counts)."""
    known = keep_columns(labels, "doc_id", "toxic").where("toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.array(F.max("toxic").cast("double")).alias("y"))
    return fit(keep_columns(docs, "doc_id", "text"), known, 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model=None) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns a row for each row: doc_id, held_out, score (double), predicted (int).

    A null text scores as an empty one: by the bias alone. Without labels every score is 0.5. Nothing but the text enters a score.
    """
    model = model or toxicity_model(docs, labels)

    def run(batches):
        bias, w = dense(model.value)
        used = w.any(1)
        for batch in sliced(batches):
            p, _ = scores([encode(t) for t in column(batch, "text").to_pylist()], bias, w, used)
            yield {"doc_id": column(batch, "doc_id"), "score": p[:, 0]}

    scored = arrow_map(keep_columns(docs, "doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score stays under the threshold."""
    model = toxicity_model(docs, labels)

    def run(batches):
        bias, w = dense(model.value)
        used = w.any(1)
        for batch in sliced(batches):
            p, _ = scores([encode(t) for t in column(batch, "text").to_pylist()], bias, w, used)
            yield batch.filter(pa.array(p[:, 0] < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)

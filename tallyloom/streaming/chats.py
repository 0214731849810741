"""Streams of chats: the hash gate, order blocks, and slots that fill as follow-ups come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chat_hash
from ..plans.parse import pieces


def read_chat_stream(spark: SparkSession, path: str) -> DataFrame:
    """A row a file, as files come."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.col("value").alias("chat_text"))


def gate(chats: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each chat once; with a time column, state is kept for `delay` only."""
    hashed = chats.withColumn("chat_hash", chat_hash(F.col("chat_text")))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["chat_hash"]) if time else hashed.dropDuplicates(["chat_hash"])


def blocks(chats: DataFrame) -> DataFrame:
    return chats.select("*", F.posexplode(pieces(F.col("chat_text"))).alias("chunk_no", "chunk"))


#: Milliseconds after which an order without messages is forgotten.
IDLE = 60 * 24 * 3600 * 1000


def evolving_slots(units: DataFrame, idle: int = IDLE) -> DataFrame:
    """units: candidate_key, qty (slots that the message asks for, 0 for follow-ups), no_plat. Emits, for each batch of an order, its target,
    what is filled and what is left over; the state is the order's target and its plates, until it has been idle for so many milliseconds."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        target, plates = state.get if state.exists else (0, [])
        plates = list(plates)
        for rows in batches:
            target = max(target, int(rows["qty"].max()))
            plates += [p for p in dict.fromkeys(rows["no_plat"].dropna()) if p and p not in plates]
        state.update((target, plates))
        state.setTimeoutDuration(idle)
        n = len(plates)
        yield pd.DataFrame({"candidate_key": [key[0]], "target": [target], "filled": [min(n, target)], "overflow": [max(0, n - target)]})

    out = "candidate_key string, target long, filled long, overflow long"
    return units.groupBy("candidate_key").applyInPandasWithState(step, out, "target long, plates array<string>", "update", "ProcessingTimeTimeout")


def event_windows(events: DataFrame, time: str, width: str, by: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling windows (an addition of this engine)."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))

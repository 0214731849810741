"""Slots that fill while messages come: the rules of operators.distinct over an order's state, whatever the order of arrival."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distinct import UNIT, Filling, shaped

#: Milliseconds after which an order without messages is forgotten.
IDLE = 60 * 24 * 3600 * 1000
#: Groups of orders by which state is kept. A call of Python costs milliseconds whatever it holds: one an order costs more than the filling.
BUCKETS = 1 << 12
OUT = "filled_from long, outcome string, slot long, version long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams on each executor's disk instead of its heap; it goes to the checkpoint with each batch."""
    spark.conf.set(*PROVIDER)


def fill_stream(rows: DataFrame, key: str, told: str = "told", idle: int = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """rows: a stream of key, told (false: a stored row; true: an incoming one), seq, ROW_FIELDS, status_unit.

    An order's state is what filling needs of its rows, once a (told, seq). A row that comes again changes nothing; one that comes late
    takes its place in the sequence, and what that changes for others is told anew. Emits key, filled_from, outcome, slot and version for
    incoming rows whose outcome is new or another; of a row the one of the greatest version holds, and then equals fill_outcomes() over all
    rows. An order that has been idle is forgotten. Only orders that a batch touches are filled again; the state that it reads and writes is
    that of their buckets, by a hash of the key. A checkpoint keeps to one number of buckets: more of them for more orders.
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        orders = json.loads(state.get[0]) if state.exists else {}  # by key: [last touched, version, rows]; a row: told, seq, unit, ..., outcome, slot
        touched, out = {}, []
        if not state.hasTimedOut:
            for rows in batches:
                for key_, name, *row in zip(*(rows[c].tolist() for c in ("_key", "_name", "_told", "_seq", *UNIT, "_says", "_open", "_whole"))):
                    if name not in touched:
                        order = orders.setdefault(name, [now, 0, []])
                        touched[name] = key_, {(r[0], r[1]) for r in order[2]}
                    seen = touched[name][1]
                    if (row[0], row[1]) not in seen:
                        seen.add((row[0], row[1]))
                        orders[name][2].append([*row, None, None])
        for name, (key_, _) in touched.items():
            order, filling = orders[name], Filling()
            order[0], order[1] = now, order[1] + 1
            order[2].sort(key=lambda r: (r[0], r[1]))
            for r in order[2]:
                is_told, seq, driver, plate, phone, says, is_open, whole, what, slot = r
                if not is_told:
                    filling.stored(seq, (driver, plate, phone), says, is_open)
                elif (what, slot) != (new := filling.incoming((driver, plate, phone), says, whole)):
                    r[8:] = new
                    out.append((key_, seq, *new, order[1]))
        if idlers := [n for n, order in orders.items() if order[0] + idle <= now and n not in touched]:
            for n in idlers:
                del orders[n]
        if orders:
            state.update((json.dumps(orders, separators=(",", ":")),))
            state.setTimeoutDuration(max(min(order[0] for order in orders.values()) + idle - now, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=t) for i, (n, t) in enumerate(((key, object), ("filled_from", "int64"), ("outcome", object), ("slot", "Int64"), ("version", "int64")))})

    seen = shaped(rows, key, F.col(told)).select(F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket"), "_key", F.col("_key").cast("string").alias("_name"), "_told", "_seq", *UNIT, "_says", "_open", "_whole")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {OUT}"
    return seen.groupBy("_bucket").applyInPandasWithState(step, schema, "orders string", "update", "ProcessingTimeTimeout")


def run_fills(source: DataFrame, key: str, folder: str, told: str = "told") -> None:
    """Processes what a source has now into Parquet files under folder, and stops; started again on the same folder it goes on where it was."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that is done again writes the same place

    conf = source.sparkSession.conf
    # batches without rows, which time idle orders out, would go on for ever; all orders' state would fill the executors' heaps
    own = dict([("spark.sql.streaming.noDataMicroBatches.enabled", "false"), PROVIDER])
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        run = fill_stream(source, key, told).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    run.awaitTermination()


def filled_so_far(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The outcomes that hold: of each incoming row that of the greatest version."""
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy(key, "filled_from").agg(F.max_by(F.struct("outcome", "slot"), "version").alias("x")).select(key, "filled_from", "x.*")

"""Fills from a stream against the batch fill: late and repeated files, a restart, a batch that is done again."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import distinct
from tallyloom.streaming import fills
from test_told_once import FIELDS, made

COLUMNS = "k string, told boolean, seq long, status_unit string, " + ", ".join(f"{c} string" for c in FIELDS)


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(21)
    old = {f"o{i}": made(r, f"o{i}", 0, r.randint(0, 4)) for i in range(40)}
    new = {f"o{i}": made(r, f"o{i}", 100, r.randint(0, 7)) for i in range(40)}
    flat = [(x, told) for d, told in ((old, False), (new, True)) for rows in d.values() for x in rows]
    df = lambda part: spark.createDataFrame([tuple({**x, "told": told}[c.split()[0]] for c in COLUMNS.split(", ")) for x, told in part], COLUMNS)
    r.shuffle(flat)
    fills.use_rocksdb(spark)
    place, source = str(tmp_path / "f"), str(tmp_path / "in")
    parts = [flat[:100], flat[100:180], flat[150:], flat[:20]]  # in any order; some rows come twice
    for part in parts:
        df(part).coalesce(1).write.mode("append").parquet(source)
        fills.run_fills(spark.readStream.schema(df(flat).schema).option("maxFilesPerTrigger", 1).parquet(source), "k", place)
    got = {(x.k, x.filled_from): (x.outcome, x.slot) for x in fills.filled_so_far(spark, place, "k").collect()}
    want = distinct.fill_outcomes(df(flat).where(~F.col("told")), df(flat).where("told"), "k").collect()
    assert got == {(x.k, x.filled_from): (x.outcome, x.slot) for x in want} and len({x.outcome for x in want}) == 4
    again = spark.read.parquet(f"{place}/out")
    assert again.count() < 3 * len(want)  # only what has changed is told anew
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_orders_share_state(spark, tmp_path):
    """Many orders lie in one bucket's state, each with its own version and idle time."""
    unit = lambda k, told, seq, n: (k, told, seq, "" if told else "UNASSIGNED", *((f"{c} {n}" if told else "") for c in FIELDS))
    orders = [x for i in range(30) for x in (unit(f"o{i}", False, 0, 0), unit(f"o{i}", True, 100, i), unit(f"o{i}", True, 101, i + 1))]
    source, got, sizes = str(tmp_path / "in"), [], []

    def run(part, idle=fills.IDLE):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        stream = fills.fill_stream(spark.readStream.schema(spark.createDataFrame(part, COLUMNS).schema).parquet(source), "k", idle=idle, buckets=2)
        got.clear()
        q = stream.writeStream.foreachBatch(lambda batch, number: got.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return {(x.k, x.filled_from): (x.outcome, x.slot, x.version) for x in got}

    first = run(orders)
    assert first == {(f"o{i}", s): ("filled", 0, 1) if s == 100 else ("skipped", None, 1) for i in range(30) for s in (100, 101)}
    assert run(orders[:6]) == {}  # rows that come again
    assert run([unit("o3", True, 50, 77)]) == {("o3", 50): ("filled", 0, 2), ("o3", 100): ("skipped", None, 2)}
    assert run([x for x in orders if x[0] != "o5"], idle=1) == {}  # o5 alone is idle, and is forgotten
    assert run([unit("o5", True, 100, 5)]) == {("o5", 100): ("skipped", None, 1)}
    assert max(sizes) == 2

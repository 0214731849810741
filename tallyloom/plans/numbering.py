"""Running numbers over a whole table without sorting it in one task."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names, row for row and partition for partition; where it is unset and all is one
    machine (tests), to a folder of our own; on a cluster that is an error, as executors would not see each other's files."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="tallyloom-"))
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Asks the JVM's collector to run, so that Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their number from 1 in the order given, which should leave no ties. The rows are sorted in ranges, each a task's; what goes
    to the driver is the number of rows of each partition. An empty table stays empty."""
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = kept(rows.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    sizes = ordered.groupBy(part.cast("int").alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["_part"], total))
        total += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    return ordered.withColumn("_part", part.cast("int")).join(starts, "_part").withColumn(name, F.col("_before") + at + 1).drop("_part", "_before", "_id")

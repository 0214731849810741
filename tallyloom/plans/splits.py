"""Splits of labelled rows into training and test parts with exact shares of every class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: The labels whose numbers come first, in this order; others follow by name.
LABELS = ("NEW_ORDER", "UPDATE", "NON_ORDER")
#: Ranges of the hash in which a class is counted.
RANGES = 1 << 12


def labelled(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """The rows that have a text and a label, the label trimmed and in capitals, with label_id, its number among the labels that are there."""
    named = rows.where((strip(F.col(text)) != "") & (strip(F.col(label)) != "")).withColumn(label, F.upper(strip(F.col(label))))
    first = F.coalesce(F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)), F.lit(0))
    order = Window.orderBy(F.when(first == 0, len(LABELS) + 1).otherwise(first), label)  # a row a label
    numbers = named.select(label).distinct().withColumn("label_id", F.row_number().over(order) - 1)
    return named.join(numbers, label)


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42, least_rows: int = 20, least_classes: int = 2) -> DataFrame:
    """rows with split: test for ceil(share * all) rows, else train. Each class has its share of the test rows, rounded down, and the classes
    with the largest remainders (of equals the lesser label) one more; of a class the rows of the least hash of key and seed are taken, so
    the split is the same on any partitioning. rows that repeat a key count each; of those that tie some are taken.

    No class is sorted as a whole: it is counted in RANGES ranges of the hash, and only the one range in which its share ends is. Fewer rows
    or classes than the least ones are an error.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = hashed.groupBy(label, "_r").agg(F.count("*").alias("_n"))
    classes = counts.groupBy(label).agg(F.sum("_n").alias("_all"))
    total, found = classes.agg(F.sum("_all"), F.count("*")).first()
    if (total or 0) < least_rows or found < least_classes:
        raise ValueError(f"{total or 0} rows of {found} classes; at least {least_rows} of {least_classes}")
    tests = -(-total * round(share * 10**6) // 10**6)
    ideal = F.col("_all") * F.lit(tests)
    quota = classes.select(label, F.floor(ideal / total).alias("_whole"), F.pmod(ideal, F.lit(total)).alias("_rest"))
    left = tests - (quota.agg(F.sum("_whole")).first()[0] or 0)
    more = Window.orderBy(F.desc("_rest"), label)  # a row a class
    quota = quota.withColumn("_k", F.col("_whole") + F.when(F.row_number().over(more) <= left, 1).otherwise(0)).select(label, "_k")
    upto = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(label).orderBy("_r")) - F.col("_n")).join(quota, label)
    upto = upto.select(label, "_r", F.least(F.greatest(F.col("_k") - F.col("_before"), F.lit(0)), F.col("_n")).alias("_take"), (F.col("_k") - F.col("_before")).between(1, F.col("_n") - 1).alias("_cut"))
    placed = hashed.join(upto, [label, "_r"])
    split = lambda test: F.when(test, "test").otherwise("train")
    nth = F.row_number().over(Window.partitionBy(label, "_r").orderBy("_h", key))
    whole = placed.where("not _cut").withColumn("split", split(F.col("_take") > 0))
    part = placed.where("_cut").withColumn("split", split(nth <= F.col("_take")))
    return whole.unionByName(part).drop("_h", "_r", "_take", "_cut")

"""Entities in BIO tags with exact boundaries, and how many of them are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_spans(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """rows: key (once each), tags (array of O, B-type and I-type). Returns key, type, first and last (places from 0). An entity begins with
    B, or with an I that follows no tag of its type, as broken taggers write; it goes on over the I tags of its type. Other tags count as O;
    null or empty arrays have no entities."""
    each = rows.select(key, F.posexplode(tags).alias("at", "tag"))
    kind = F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 1 << 20))
    seq = Window.partitionBy(key).orderBy("at")
    each = each.withColumn("type", kind).withColumn("_before", F.lag("type").over(seq))
    begins = F.col("tag").startswith("B-") | ~F.col("type").eqNullSafe(F.col("_before"))
    numbered = each.withColumn("_n", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(seq)).where("type is not null")
    return numbered.groupBy(key, "_n").agg(F.first("type").alias("type"), F.min("at").alias("first"), F.max("at").alias("last")).drop("_n")


def _measures(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}


def entity_metric(rows: DataFrame, key: str, truth: str, found: str) -> DataFrame:
    """rows: key, two arrays of tags for the same tokens. Returns type (and a row `micro` over all), tp, fp, fn, precision, recall, f1; an
    entity is found if type, first and last place all agree. Types that neither side has have no row; without any, only micro's zeros."""
    side = lambda tags, mark: entity_spans(rows, key, tags).withColumn(mark, F.lit(1))
    both = side(truth, "t").join(side(found, "f"), [key, "type", "first", "last"], "full_outer")
    t, f = F.coalesce("t", F.lit(0)), F.coalesce("f", F.lit(0))
    counts = [F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("tp", t * f), ("fp", f - t * f), ("fn", t - t * f))]
    by_type = both.groupBy("type").agg(*counts)
    micro = by_type.agg(F.lit("micro").alias("type"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return by_type.unionByName(micro).withColumns(_measures(F.col("tp"), F.col("fp"), F.col("fn")))

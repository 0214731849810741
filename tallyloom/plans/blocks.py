"""Ordered-row operators of the office report: look-ahead fill, running blocks, quotas. All are windows within a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digits, filled, strip


def quantity(c: Column) -> Column:
    """All digits of the cell as one number, 0 without any."""
    return F.coalesce(F.nullif(digits(c), F.lit("")).try_cast("int"), F.lit(0))


def repair_headers(rows: DataFrame, batch: str, seq: str, columns: tuple[str, ...] = ("destination", "origin", "unit_type"), qty: str = "unit_qty") -> DataFrame:
    """Rows with a quantity take missing places and types from the next three rows, the nearest first."""
    w = Window.partitionBy(batch).orderBy(seq)
    own = {c: F.when(filled(F.col(c)), F.col(c)) for c in columns}
    ahead = lambda c: F.coalesce(own[c], *(F.lead(own[c], k).over(w) for k in (1, 2, 3)))
    return rows.withColumns({c: F.when(digits(F.col(qty)) != "", ahead(c)).otherwise(own[c]) for c in columns})


def mark_blocks(rows: DataFrame, batch: str, seq: str, qty: str = "unit_qty", kind: str = "unit_type") -> DataFrame:
    """block_id: how many headers there are up to the row; a header asks for several units, or for one with its type."""
    q = quantity(F.col(qty))
    head = (q > 1) | ((q == 1) & F.col(kind).isNotNull())
    w = Window.partitionBy(batch).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block_id", F.sum(head.cast("int")).over(w))


def fill_blocks(rows: DataFrame, batch: str, seq: str, columns: tuple[str, ...]) -> DataFrame:
    """Nulls take the last value before them in their block."""
    w = Window.partitionBy(batch, "block_id").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def enforce_quota(rows: DataFrame, batch: str, seq: str, header_columns: tuple[str, ...], unit_columns: tuple[str, ...], qty: str = "unit_qty") -> DataFrame:
    """Each block emits as many rows as its largest quantity asks: its units in order, then blank slots. What a unit lacks of
    header_columns it takes from the block's header (the last row that asks for several units, else the first row)."""
    q = quantity(F.col(qty))
    blocks = rows.where("block_id > 0").withColumn("_q", q)
    is_unit = (F.col("_q") <= 1) & sum((filled(F.col(c)).cast("int") for c in unit_columns), F.lit(0)).cast("boolean")
    header = F.coalesce(
        F.max_by(F.struct(*header_columns), F.when(F.col("_q") > 1, F.col(seq))),
        F.min_by(F.struct(*header_columns), F.col(seq)),
    )
    heads = blocks.groupBy(batch, "block_id").agg(header.alias("_h"), F.greatest(F.max("_q"), F.lit(1)).alias("_target"))
    slots = heads.withColumn("slot_no", F.explode(F.sequence(F.lit(1), F.col("_target"))))
    units = blocks.where(is_unit).withColumn("slot_no", F.row_number().over(Window.partitionBy(batch, "block_id").orderBy(seq)))
    units = units.select(batch, "block_id", "slot_no", *header_columns, *unit_columns)
    joined = slots.join(units, [batch, "block_id", "slot_no"], "left")
    return joined.select(
        batch, "block_id", "slot_no",
        *(F.when(filled(F.col(c)), F.col(c)).otherwise(F.col("_h")[c]).alias(c) for c in header_columns),
        *(strip(F.col(c)).alias(c) for c in unit_columns),
    )


def apply_revisions(rows: DataFrame, revisions: DataFrame, key: str, columns: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """Rows take each column's last filled revision of their key; others stay."""
    last = revisions.groupBy(key).agg(*(F.max_by(c, F.when(filled(F.col(c)), F.col(seq))).alias(f"_{c}") for c in columns))
    joined = rows.join(last, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def islands(rows: DataFrame, batch: str, seq: str, value: str) -> DataFrame:
    """island: the number of the run of equal neighbouring values that a row is in, from 1."""
    w = Window.partitionBy(batch).orderBy(seq)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_s", starts).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")

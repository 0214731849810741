"""Units that are told once: a running distinct by a rule that is no equality, and the filling of slots that rests on it.

Two units are one if their plates agree, or two of driver, plate and phone (functions.identity.same_unit). That is no equivalence, so
which units of an order count as new depends on their sequence: each is compared with those that were taken before it. Rows stream sorted
through a kernel that holds of one order at a time the keys of its taken units, in a hash index: plates, and drivers with phones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.identity import IDENTITY, ROW_FIELDS, complete_identity, signature
from ..functions.rules import known_status, status
from ..functions.text import filled


class Taken(set):
    """The keys of the units that an order has: plates, and drivers with their phones. Two fields of which one is the plate agree only where
    the plate does."""

    def has(self, unit: tuple[str, str, str]) -> bool:
        driver, plate, phone = unit
        return bool(plate) and plate in self or bool(driver and phone) and (driver, phone) in self

    def take(self, unit: tuple[str, str, str]) -> None:
        driver, plate, phone = unit
        if plate:
            self.add(plate)
        if driver and phone:
            self.add((driver, phone))


def sorted_stream(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """rows with all of a scope in one task, in order, for a kernel that takes one scope after the other.

    They are dealt by a hash of the scope and not by its columns: of a union whose sides are dealt by those columns already, Spark 4.1 leaves
    the dealing out, and then merges small partitions of each side by itself, so that a scope's rows lie in different tasks.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*scope)).sortWithinPartitions(*scope, *order)


def first_told(known: DataFrame, rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The rows, with all columns, that are a unit neither known of their scope nor told before among the rows that this returns.

    known: scope and IDENTITY columns, all of which count; rows: scope, order, IDENTITY and others. Sequence is that of the order columns;
    rows without a complete identity are left out. A scope (an order) streams through one task, which holds its units' keys only.
    """
    schema = rows.schema
    names = [f"_{c}" for c in ("driver", "no_plat", "kontak_driver")]
    with_keys = lambda df: df.withColumn("_sig", signature()).select("*", *(F.col(f"_sig.{c}").alias(n) for c, n in zip(IDENTITY, names))).drop("_sig")
    told = with_keys(rows.where(complete_identity())).withColumn("_told", F.lit(True))
    old = with_keys(known.select(*scope, *IDENTITY)).select(*scope, *names).distinct().withColumn("_told", F.lit(False))
    stream = sorted_stream(told.unionByName(old, allowMissingColumns=True), scope, ["_told", *order])
    out_schema, drop = StructType([StructField(f.name, f.dataType) for f in schema]), {*names, "_told"}

    def run(batches):
        at, taken = None, Taken()
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in drop or n in scope}
            keep = []
            for key, is_told, unit in zip(zip(*(col[s] for s in scope)), col["_told"], zip(*(col[n] for n in names))):
                if key != at:
                    at, taken = key, Taken()
                new = is_told and not taken.has(unit)
                if new or not is_told:
                    taken.take(unit)
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_())).select([f.name for f in schema])

    return stream.mapInArrow(run, out_schema)


#: What fill_outcomes tells of an incoming row.
FILLED, DUPLICATE, SKIPPED, INCOMPLETE = "filled", "duplicate", "skipped", "incomplete"
UNIT = ("_driver", "_plate", "_phone")


class Filling:
    """One order's slots and what it has taken, as its stored rows and then its incoming ones come in sequence."""

    def __init__(self):
        self.taken, self.slots, self.used = Taken(), [], 0

    def stored(self, seq: int, unit: tuple[str, str, str], says: int, is_open: bool) -> None:
        self.taken.take(unit)
        if is_open:
            self.slots.append((seq, says))

    def incoming(self, unit: tuple[str, str, str], says: int, whole: bool) -> tuple[str, int | None]:
        """The outcome, and the slot that it fills."""
        if not whole:
            return INCOMPLETE, None
        if self.taken.has(unit):
            return DUPLICATE, None
        if self.used < len(self.slots) and says & ~self.slots[self.used][1]:
            self.used += 1
            self.taken.take(unit)
            return FILLED, self.slots[self.used - 1][0]
        return SKIPPED, None


def shaped(rows: DataFrame, key: str, told: Column, seq: str = "seq") -> DataFrame:
    """What filling looks at: _key, _told (incoming or stored), _seq, the signature as _driver, _plate and _phone, _says (a mask of the filled
    fields), _open, _whole, and the fields."""
    said = status(*map(F.col, ROW_FIELDS))
    if "status_unit" in rows.columns:
        said = F.coalesce(F.nullif(known_status(F.coalesce("status_unit", F.lit(""))), F.lit("")), said)
    brings = sum((F.when(filled(F.col(c)), 1 << i).otherwise(0) for i, c in enumerate(ROW_FIELDS)), F.lit(0))
    sig = signature()
    return rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), told.alias("_told"), F.col(seq).cast("long").alias("_seq"), *(sig[c].alias(n) for c, n in zip(IDENTITY, UNIT)), brings.alias("_says"),
        (~told & said.isin("PARTIAL", "UNASSIGNED")).alias("_open"), complete_identity().alias("_whole"), *(F.col(c).cast("string").alias(c) for c in ROW_FIELDS),
    )


def fill_outcomes(table: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """What becomes of each incoming row of a key, in sequence: `key`, filled_from (its seq), outcome, slot (the seq of the row that it fills,
    else null) and its ROW_FIELDS.

    A complete unit that is one with a stored row of the key, open or not, or with a unit that has filled before it, is a duplicate. Else it
    goes into the first row that is PARTIAL or UNASSIGNED (as said, or else by what it holds) and not yet filled, if that row lacks anything
    that it brings; without such a row it is skipped. Rows that say less than driver, plate and phone are incomplete. Rows without a key
    take no part. A key streams through one task, which holds its open slots and its units' keys.
    """
    both = shaped(table, key, F.lit(False), seq).unionByName(shaped(incoming, key, F.lit(True), seq))
    schema = f"`{key}` {table.schema[key].dataType.simpleString()}, filled_from long, outcome string, slot long, " + ", ".join(f"{c} string" for c in ROW_FIELDS)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        at, order = None, Filling()
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n.startswith("_")}
            numbers, outcomes, into = [], [], []
            for i, (k, told, s, unit, says, is_open, whole) in enumerate(zip(get["_key"], get["_told"], get["_seq"], zip(*(get[n] for n in UNIT)), get["_says"], get["_open"], get["_whole"])):
                if k != at:
                    at, order = k, Filling()
                if not told:
                    order.stored(s, unit, says, is_open)
                    continue
                what, slot = order.incoming(unit, says, whole)
                numbers.append(i), outcomes.append(what), into.append(slot)
            rows = batch.take(pa.array(numbers, pa.int64()))
            pick = lambda n: rows.column(rows.schema.get_field_index(n))
            yield pa.RecordBatch.from_arrays([pick("_key").cast(arrow.field(0).type), pick("_seq"), pa.array(outcomes, pa.string()), pa.array(into, pa.int64()), *(pick(c) for c in ROW_FIELDS)], schema=arrow)

    return sorted_stream(both, ["_key"], ["_told", "_seq"]).mapInArrow(run, schema)


def fill_counts(table: DataFrame, incoming: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """By key of the incoming rows: filled, duplicates, skipped. Of a key without complete units all rows count as skipped; of a key that the
    table has not, all complete ones; incomplete rows beside complete ones count nowhere."""
    of = lambda *what: F.count_if(F.col("outcome").isin(*what))
    done = fill_outcomes(table, incoming, key, seq).groupBy(key).agg(of(FILLED).alias("filled"), of(DUPLICATE).alias("duplicates"), of(SKIPPED).alias("_s"), of(INCOMPLETE).alias("_i"), F.count("*").alias("_n"))
    here = table.select(key).distinct().withColumn("_here", F.lit(True))
    done = done.join(here, key, "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    skipped = F.when(F.col("_i") == F.col("_n"), F.col("_n")).when(~F.col("_here"), F.col("_n") - F.col("_i")).otherwise(F.col("_s"))
    return done.select(key, F.when(F.col("_here"), F.col("filled")).otherwise(0).alias("filled"), F.when(F.col("_here"), F.col("duplicates")).otherwise(0).alias("duplicates"), skipped.alias("skipped"))

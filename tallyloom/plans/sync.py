"""Follow-ups that go into stored orders: what an order would look like, the plan as one row set, and blocks one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import norm_key
from ..functions.identity import CONTEXT, IDENTITY, ROW_FIELDS, complete_identity, context_key, row_context_key
from ..functions.text import filled
from ..operators.merge import fill_slots
from ..sources.store import TableStore
from .evidence import compare
from .matching import candidates, decide, duplicates_anti, incoming_key, left_over, score_pairs, select_output, state_text, unit_counts
from .numbering import kept
from .ranking import ranked_candidates

#: The reasons that go with decisions.
REASONS = {
    "date": "Tgl RO berbeda setelah normalisasi nama bulan; merge diblokir oleh aturan bisnis.",
    "CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP": "NER belum menghasilkan unit lengkap dari Order Susulan.",
    "ABAIKAN_DUPLIKAT": "Identitas unit di Order Susulan sudah ada pada order Order Induk.",
    "REKOMENDASI_ISI_SLOT_ORDER_LAMA": "Model memprediksi MATCH, ada unit baru lengkap, dan jumlah unit tidak melebihi sisa slot.",
    "clear": "Score matcher sangat rendah; chat diperlakukan sebagai order baru sebelum rule conflict diterapkan.",
    "low": "Score matcher di bawah ambang review atau model memprediksi NO_MATCH.",
    "overflow": "Unit baru lebih banyak dari sisa slot order Order Induk.",
    "nothing": "Tidak ada slot yang bisa diisi dari unit baru.",
    "unsure": "Score masuk area review, belum cukup aman untuk auto-fill.",
}


def after_snapshot(orders: DataFrame, incoming: DataFrame, key: str = "candidate_key", seq: str = "seq") -> DataFrame:
    """The rows of orders as a follow-up would leave them: the k-th complete incoming unit that is new to the order goes into its k-th row
    without a complete identity, with all that it says. A preview: units that repeat each other are shown each. Adds marker (BARU where that
    happened, else empty) and filled_from."""
    fresh = duplicates_anti(incoming.where(complete_identity()), orders, [key])
    k = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    new = fresh.withColumn("_k", k).select(key, "_k", F.col(seq).alias("filled_from"), *(F.col(c).alias(f"_in_{c}") for c in ROW_FIELDS))
    slots = orders.withColumn("_open", ~complete_identity())
    slots = slots.withColumn("_k", F.when(F.col("_open"), F.row_number().over(Window.partitionBy(key, "_open").orderBy(seq))))
    done = slots.join(new, [key, "_k"], "left").withColumns({c: F.when(filled(F.col(f"_in_{c}")), F.trim(f"_in_{c}")).otherwise(F.col(c)) for c in ROW_FIELDS})
    return done.select(*orders.columns, "filled_from").withColumn("marker", F.when(F.col("filled_from").isNotNull(), "BARU").otherwise(""))


def reason(plan: DataFrame) -> Column:
    """The text that tells why a plan's decision was taken."""
    new_order = F.when(F.col("date_conflict"), REASONS["date"]).when((F.col("predicted") == "NO_MATCH") & (F.col("p_match") < rules.CLEAR_NEW) & (F.col("duplicates") == 0), REASONS["clear"]).otherwise(REASONS["low"])
    review = F.when(F.col("overflow") > 0, REASONS["overflow"]).when(F.col("fill") <= 0, REASONS["nothing"]).otherwise(REASONS["unsure"])
    known = F.create_map(*(F.lit(x) for a in ("CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP", "ABAIKAN_DUPLIKAT", "REKOMENDASI_ISI_SLOT_ORDER_LAMA") for x in (a, REASONS[a])))
    return F.coalesce(F.try_element_at(known, F.col("action")), F.when(F.col("action") == "TAHAN_AUDIT_CONFLICT", F.col("conflicts")).when(F.col("action") == "REVIEW_MANUAL", review).otherwise(new_order))


def plans(orders: DataFrame, incoming: DataFrame, event: str = "incoming_id", scorer=None, top: int = 8) -> DataFrame:
    """One row a message and each of its `top` best candidate orders by context: scores, unit counts, decision, reason, and whether it can
    be applied.

    orders: seq, ROW_FIELDS, status_unit. incoming: event, seq, unit_no, text, ROW_FIELDS. The model scores the best candidates only
    (ranking.ranked_candidates); a message that leaves fields blank is ranked by the others.
    """
    found = state_text(candidates(orders))
    of = incoming_key(incoming, event, "seq").join(incoming.groupBy(event).agg(F.min_by("text", "seq").alias("text")), event)
    best = ranked_candidates(of, found, event, top)
    met = best.join(found, "candidate_key").join(of.select(event, "text", *(F.col(c).alias(f"in_{c}") for c in CONTEXT)), event)
    scored = score_pairs(met, "state_text", "text", scorer=scorer)
    own = orders.withColumn("candidate_key", row_context_key())
    counted = unit_counts(scored.withColumnRenamed(event, "incoming_id"), incoming.withColumnRenamed(event, "incoming_id"), own)
    differs = lambda c: compare(F.col(c), F.col(f"in_{c}"), norm_key) == "BEDA"
    names = {"pickup": "Pickup", "tujuan": "Tujuan", "type_truck": "Type Truck"}
    told = rules.conflict_messages({n: (F.col(c), F.col(f"in_{c}")) for c, n in names.items()}, norm_key)
    judged = decide(counted.withColumns({"date_conflict": differs("tgl_ro"), "conflicts": F.array_join(told, " ")}).withColumn("conflict", F.col("conflicts") != ""))
    ready = rules.ready(F.col("decision_status"), F.col("fill"), F.col("overflow"), F.col("review_required"), F.col("candidate_key"))
    return judged.withColumn("policy_reason", reason(judged)).withColumn("ready", ready).withColumnRenamed("incoming_id", event)


def block_changes(orders: DataFrame, units: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What one block's unit rows (seq, unit_no, text, ROW_FIELDS) change in the orders: the rows of the order that its best plan may be
    applied to, with its slots filled; or else the block's own rows, a new order. Returns the order's rows afterwards, the new rows, and the
    plans."""
    one = units.withColumn("incoming_id", F.lit("block"))
    plan = kept(plans(orders, one, scorer=scorer).drop("snapshot"))  # written: all that follows reads it
    best = kept(select_output(plan.withColumn("seq", F.col("first_seq")), "incoming_id").where("ready").select("candidate_key").limit(1))
    chosen = orders.withColumn("candidate_key", row_context_key()).join(best, "candidate_key", "left_semi")
    new = units.crossJoin(best)  # at most one key
    filled_ = fill_slots(chosen, new.select("seq", "candidate_key", *ROW_FIELDS), "candidate_key")
    stored = units.join(best.select(F.lit(1).alias("_applied")), F.lit(True), "left").where("_applied is null")
    stored = stored.withColumn("status_unit", rules.status(*(F.col(c) for c in ROW_FIELDS)))
    return filled_, stored, plan


def apply_block(orders: DataFrame, units: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame]:
    """One block against the orders: the orders afterwards, and the plans."""
    filled_, stored, plan = block_changes(orders, units, scorer)
    stored = stored.select(*(c for c in orders.columns if c in (*ROW_FIELDS, "seq", "status_unit")))
    rest = orders.withColumn("candidate_key", row_context_key()).join(filled_.select("candidate_key").distinct(), "candidate_key", "left_anti").select(*orders.columns)
    return rest.unionByName(filled_.select(*orders.columns)).unionByName(stored, allowMissingColumns=True), plan


#: The rows of a store of orders; order_key is the order's context when it was stored, which later fills do not change.
STORED = "order_key string, seq long, " + ", ".join(f"{c} string" for c in ROW_FIELDS) + ", status_unit string"


def order_store(spark: SparkSession, folder: str, buckets: int = 64) -> TableStore:
    return TableStore(spark, folder, STORED, by="order_key", key="seq", buckets=buckets)


def sync_store(store: TableStore, units: DataFrame, block: str = "chunk_no", most: int = 500, scorer=None) -> list[DataFrame]:
    """sync_blocks() into a store: each block reads the orders as the one before has left them, and writes only the buckets of the rows that
    it changes. Returns the plans, a table a block. A crash leaves the blocks so far; a block that is applied again finds its units there."""
    numbers = [r[0] for r in units.select(block).distinct().orderBy(block).limit(most + 1).collect()]
    if len(numbers) > most:
        raise ValueError(f"more than {most} blocks in one text")
    shown, names = [], [f.name for f in store.schema]
    for n in numbers:
        filled_, stored, plan = block_changes(store.read(), units.where(F.col(block) == n).drop(block), scorer)
        changed = filled_.where("filled_from is not null").select(*names).unionByName(stored.withColumn("order_key", row_context_key()).select(*names))
        shown.append(plan.withColumn(block, F.lit(n)))
        store.upsert(kept(changed))
    return shown


def sync_blocks(orders: DataFrame, units: DataFrame, block: str = "chunk_no", most: int = 500, scorer=None) -> tuple[DataFrame, DataFrame]:
    """The blocks of one pasted text, one after the other: each sees the orders as the one before has left them. Returns the orders and all
    plans with their block. A paste's blocks are few (more than `most` is an error); each step's table is cut by checkpoint()."""
    spark = orders.sparkSession
    numbers = [r[0] for r in units.select(block).distinct().orderBy(block).limit(most + 1).collect()]
    if len(numbers) > most:
        raise ValueError(f"more than {most} blocks in one text")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            raise ValueError("set spark.checkpoint.dir or a checkpoint folder")
        spark.sparkContext.setCheckpointDir(place)
    shown = None
    for n in numbers:
        after, plan = apply_block(orders, units.where(F.col(block) == n).drop(block), scorer)
        plan = plan.withColumn(block, F.lit(n))
        shown = plan if shown is None else shown.unionByName(plan)
        orders = after.checkpoint()
    return orders, shown


def unmatched_units(units: DataFrame, orders: DataFrame, key: str = "candidate_key") -> DataFrame:
    """Complete units of messages that no registered unit of their order has found again: matching.match_units() pairs them one to one, so a
    unit that is told twice is left over once. units and orders: key, seq and the identity fields; seq is unique within a key."""
    return left_over(orders, units, key)


def context_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("candidate_key", context_key(*(F.col(c) for c in CONTEXT))).select("candidate_key", *CONTEXT, *IDENTITY)

"""Status, decision and evaluation rules: CASE expressions over joined columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, count_filled, filled, strip

#: Thresholds of the matcher and of the event gate.
STRONG, REVIEW, CLEAR_NEW, EVENT_GATE = 0.85, 0.50, 0.20, 0.75
STATUSES = ("ASSIGNED", "PARTIAL", "UNASSIGNED")


def status(*fields: Column, full: int | None = None) -> Column:
    """ASSIGNED with all fields filled, PARTIAL with three or more, else UNASSIGNED."""
    n = count_filled(*fields)
    return F.when(n >= (full or len(fields)), "ASSIGNED").when(n >= 3, "PARTIAL").otherwise("UNASSIGNED")


def known_status(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s.isin(*STATUSES), s).otherwise("")


def status_or_derived(c: Column, derived: Column) -> Column:
    return F.coalesce(F.nullif(known_status(c), F.lit("")), derived)


def is_open(c: Column, derived: Column) -> Column:
    """PARTIAL or UNASSIGNED as said, else whatever derives."""
    return known_status(c).isin("PARTIAL", "UNASSIGNED") | (derived != "ASSIGNED")


def fill_or_overwrite(current: Column, incoming: Column, overwrite: Column) -> Column:
    """Blanks take the incoming value; other values only give way where overwriting is allowed and they differ."""
    return F.when(blank(incoming), current).when(blank(current) | (overwrite & (strip(current) != strip(incoming))), incoming).otherwise(current)


def decision(date_conflict, complete, new, duplicates, predicted, p, conflict, fill, overflow, bypass=None) -> Column:
    """struct(decision_status, action, review_required) of a follow-up message for a candidate order: the first branch that holds."""
    bypass = F.lit(False) if bypass is None else bypass

    def out(s: str, a: str, review: bool) -> Column:
        return F.struct(F.lit(s).alias("decision_status"), F.lit(a).alias("action"), F.lit(review).alias("review_required"))

    new_order = out("TIDAK_COCOK", "SIMPAN_SEBAGAI_ORDER_BARU", False)
    return (
        F.when(date_conflict & ~bypass, new_order)
        .when(complete == 0, out("PERLU_REVIEW", "CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP", True))
        .when((new <= 0) & (duplicates > 0), out("DUPLIKAT", "ABAIKAN_DUPLIKAT", False))
        .when((predicted == "NO_MATCH") & (p < CLEAR_NEW) & (duplicates == 0), new_order)
        .when(conflict & ~bypass, out("CONFLICT", "TAHAN_AUDIT_CONFLICT", True))
        .when((predicted != "MATCH") | (p < REVIEW), new_order)
        .when((fill > 0) & ((overflow == 0) | bypass), out("SIAP_ISI_SLOT", "REKOMENDASI_ISI_SLOT_ORDER_LAMA", False))
        .otherwise(out("PERLU_REVIEW", "REVIEW_MANUAL", True))
    )


def operator_label(decision_status, action, applied, duplicates) -> Column:
    return (
        F.when(applied > 0, "GABUNG OTOMATIS")
        .when((duplicates > 0) | (decision_status == "DUPLIKAT"), "DUPLIKAT")
        .when(decision_status == "SIAP_ISI_SLOT", "SIAP GABUNG")
        .when(decision_status == "CONFLICT", "CONFLICT")
        .when(decision_status == "TIDAK_COCOK", "ORDER BARU")
        .when(action == "CHAT_TIDAK_MEMBAWA_UNIT_LENGKAP", "DATA KURANG")
        .otherwise("CEK MANUAL")
    )


def predicted_label(label: Column, p: Column, p_no: Column | None = None) -> Column:
    """The stored label, else the likelier one; a tie is a match."""
    said = F.upper(strip(label))
    other = F.greatest(F.lit(0.0), 1 - p) if p_no is None else F.coalesce(p_no, F.greatest(F.lit(0.0), 1 - p))
    return F.when(said.isin("MATCH", "NO_MATCH"), said).when(F.coalesce(p, F.lit(0.0)) >= other, "MATCH").otherwise("NO_MATCH")


def ready(decision_status, fill, overflow, review, key, bypass=None) -> Column:
    bypass = F.lit(False) if bypass is None else bypass
    return (decision_status == "SIAP_ISI_SLOT") & (fill > 0) & ((overflow <= 0) | bypass) & ~review & (key != "")


def anomaly(decision_status, reason, predicted, p, merged, date_conflict, complete, overflow, duplicates, fill) -> Column:
    """The label of the first anomaly that holds, else the empty text."""
    return (
        F.when(((predicted == "MATCH") & (p >= STRONG) & merged) | date_conflict, "")
        .when(decision_status == "CONFLICT", F.coalesce(F.nullif(strip(reason), F.lit("")), F.lit("Conflict atribut unit lama")))
        .when((predicted == "NO_MATCH") & (p < CLEAR_NEW), "")
        .when(overflow > 0, "Konflik slot")
        .when(complete <= 0, "Data unit belum lengkap")
        .when((predicted == "MATCH") & ~merged, F.when((duplicates > 0) & (fill <= 0), "Duplikat unit lama").otherwise("MATCH tidak aman"))
        .when(decision_status == "PERLU_REVIEW", "Perlu audit")
        .when((p >= CLEAR_NEW) & (p < STRONG), "Model ragu")
        .otherwise("")
    )


def output_rank(is_ready, predicted, date_ok, overflow, fill, p, seq) -> Column:
    """A comparable rank; the greatest is the row to show, and of equals the first."""
    return F.struct(is_ready.cast("int"), (predicted == "MATCH").cast("int"), date_ok.cast("int"), (-overflow), fill, p, (-seq))


def passes_event_gate(label: Column, score: Column, threshold: float = EVENT_GATE) -> Column:
    return ~((label == "NON_ORDER") & (score >= threshold))


def result(expected: Column, predicted: Column) -> Column:
    return F.when(expected == predicted, "PASS").when(predicted == "MATCH", "FALSE_MATCH").otherwise("FALSE_NO_MATCH")


def confusion_bucket(expected: Column, predicted: Column) -> Column:
    return F.concat(F.when(expected == predicted, "T").otherwise("F"), F.when(predicted == "MATCH", "P").otherwise("N"))


def evaluation_status(tp, fp, fn, swapped=None, duplicate_fp=None) -> Column:
    swapped = F.lit(False) if swapped is None else swapped
    duplicate_fp = F.lit(0) if duplicate_fp is None else duplicate_fp
    return (
        F.when((tp == 0) & (fp == 0) & (fn == 0), "EMPTY")
        .when((fp == 0) & (fn == 0), "CORRECT")
        .when(swapped, "LABEL_SWAP")
        .when((duplicate_fp > 0) & (fn == 0), "DUPLICATE")
        .when((tp == 0) & (fp == 0), "MISSING")
        .when((tp == 0) & (fn == 0), "SPURIOUS")
        .when((tp > 0) & (fn == 0), "OVEREXTRACTED")
        .when((tp > 0) & (fp == 0), "UNDEREXTRACTED")
        .when(tp > 0, "MIXED")
        .otherwise("WRONG")
    )


def quality_class(tp, fp, fn) -> Column:
    return F.when((tp == 0) & (fp == 0) & (fn == 0), "neutral").when((fp == 0) & (fn == 0), "good").when(tp > 0, "warn").otherwise("bad")


def confidence_bucket(score, captured) -> Column:
    return F.when(~captured, "MISSING").when(score >= 0.90, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def values_differ(a: Column, b: Column, key) -> Column:
    return filled(a) & filled(b) & (key(a) != key(b))


def conflict_messages(pairs: dict[str, tuple[Column, Column]], key) -> Column:
    """What changed, as distinct messages in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(values_differ(a, b, key), F.concat(F.lit(f"{name}: "), strip(a), F.lit(" -> "), strip(b))) for name, (a, b) in pairs.items()))))


#: Aliases of the event labels, and words that tell an event.
EVENTS = {"NEW_ORDER": "NEW_ORDER", "NEW ORDER": "NEW_ORDER", "ORDER": "NEW_ORDER", "UPDATE": "UPDATE", "REVISI": "UPDATE", "REVISION": "UPDATE", "NON_ORDER": "NON_ORDER", "NON ORDER": "NON_ORDER", "INFO": "NON_ORDER", "CANCEL": "NON_ORDER"}


def event_label(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair)), F.upper(strip(c)))


def event_from_words(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(t.rlike(r"\b(update|revisi|rev|ubah|ganti|perbaikan)\b"), "UPDATE")
        .when(t.rlike(r"\b(cancel|batal|info|fyi)\b"), "NON_ORDER")
        .when(t.rlike(r"\b(request|order|unit|oncall|loading)\b"), "NEW_ORDER")
        .otherwise("NON_ORDER")
    )


def is_junk(c: Column) -> Column:
    """Too short, or without any word of an order."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return ~t.rlike("unit|loading|tujuan|kirim|muat|driver|nopol|request") | (F.length(t) < 10)


def looks_like_revision(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)\b(rev|revisi|revision|update|ubah|ganti|perbaikan)\b")

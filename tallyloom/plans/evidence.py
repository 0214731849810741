"""Checks of text pairs and evidence about matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fields, rules
from ..functions.identity import normalize_route, normalize_value
from ..functions.text import filled, let, strip

#: Spellings of the labels in checked texts; values that name no driver.
PLACES, ROUTES = "lokasi|loksi|loaksi|lks", "rute/tujuan|rute tujuan|rute|route/tujuan|route|tujuan"
NO_DRIVERS = ("-", "belum ada", "kosong", "none", "nan")


def driver_records(c: Column) -> Column:
    """How many different drivers a text names."""
    found = F.transform(fields.field_values(c, r"driver(?:\s*\d+)?|nama"), lambda x: F.lower(strip(x)))
    return F.size(F.array_except(F.array_distinct(found), F.array(*map(F.lit, NO_DRIVERS))))


def pair_checks(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Adds what each text says (suffixes _a, _b), the advisories and the label that the rules expect."""
    said = pairs
    for side, c in (("a", F.col(a)), ("b", F.col(b))):
        state = fields.filled_state(c)
        said = said.withColumns({
            f"request_date_{side}": dates.request_date(c), f"location_{side}": fields.field_values(c, PLACES), f"route_{side}": fields.field_values(c, ROUTES), f"unit_type_{side}": fields.unit_type(c),
            f"qty_{side}": F.coalesce(state["target"], fields.unit_quantity(c)) if side == "a" else fields.unit_quantity(c), f"filled_{side}": state["filled"],
        })
    said = said.withColumn("incoming_drivers", driver_records(F.col(b)))

    def apart(x: str, norm) -> Column:
        keys = [F.array_distinct(F.filter(F.transform(F.col(f"{x}_{s}"), norm), lambda v: v != "")) for s in "ab"]
        return (F.size(keys[0]) > 0) & (F.size(keys[1]) > 0) & ~F.arrays_overlap(*keys)

    differ = lambda x: (F.col(f"{x}_a") != "") & (F.col(f"{x}_b") != "") & (F.col(f"{x}_a") != F.col(f"{x}_b"))
    advice = F.array_compact(F.array(
        F.when(differ("request_date"), "BLOCK: tanggal request beda"), F.when(apart("location", normalize_value), "BLOCK: lokasi beda"), F.when(apart("route", normalize_route), "BLOCK: rute/tujuan beda"),
        F.when(differ("unit_type"), "BLOCK: tipe unit beda"), F.when((F.col("filled_a") >= F.col("qty_a")) & (F.col("incoming_drivers") > 0), "BLOCK: target unit sudah penuh"),
        F.when(F.col("incoming_drivers") == 0, "REVIEW: pesan susulan tidak punya driver terisi"), F.when((F.col("qty_a") > 0) & (F.col("qty_b") > 0) & (F.col("qty_a") != F.col("qty_b")), "REVIEW: angka qty beda"),
    ))
    out = said.withColumn("rule_advisory", let(advice, lambda x: F.when(F.size(x) == 0, "OK").otherwise(F.array_join(x, "; "))))
    blocked = F.col("rule_advisory").contains("BLOCK:") | F.col("rule_advisory").contains("tidak punya driver terisi")
    return out.withColumn("expected", F.when(blocked, "NO_MATCH").otherwise("MATCH"))


def suite_results(pairs: DataFrame) -> DataFrame:
    """A suite's cases with expected and predicted labels, as results and confusion buckets."""
    return pairs.withColumns({"result": rules.result(F.col("expected"), F.col("predicted")), "bucket": rules.confusion_bucket(F.col("expected"), F.col("predicted"))})


def compare(a: Column, b: Column, key) -> Column:
    """COCOK, BEDA, or BELUM LENGKAP where a side is missing."""
    return F.when(~filled(a) | ~filled(b), "BELUM LENGKAP").when(key(a) == key(b), "COCOK").otherwise("BEDA")


def slot_evidence(empty: Column, new: Column) -> Column:
    return F.when(new <= 0, "BELUM ADA UNIT").when(empty <= 0, "PENUH").when(new > empty, "MELEBIHI").otherwise("CUKUP")


def values_agree(attribute: Column, found: Column, shown: Column) -> Column:
    """One set holds the other; of quantities, a number of one is in the other."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.lower(strip(x))), lambda x: filled(x)))

    def of(x: Column, y: Column) -> Column:
        numbers = F.flatten(F.transform(x, lambda v: F.regexp_extract_all(v, F.lit(r"(\d{1,3})"), F.lit(1))))
        quantity = F.exists(y, lambda v: F.exists(numbers, lambda n: v.contains(n)))
        subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
        return (F.size(x) > 0) & (F.size(y) > 0) & F.when(attribute == "UNIT_QTY", quantity).otherwise(subset)

    return let(F.struct(clean(found).alias("x"), clean(shown).alias("y")), lambda s: of(s["x"], s["y"]))


def contextual_confidence(attribute: Column, found: Column, shown: Column, raw: Column) -> Column:
    """At least 0.95 where the values agree and none wants a look."""
    flagged = F.when(attribute == "RO_DATE", F.exists(F.concat(found, shown), dates.needs_flag)).otherwise(F.lit(False))
    return F.when(values_agree(attribute, found, shown) & ~flagged, F.greatest(raw, F.lit(0.95))).otherwise(raw)


def value_is_problem(value: Column, truth: Column, found: Column, swapped: Column) -> Column:
    """An extracted value that the truth lacks, that another label should have, or that was found more often than it is true."""
    times = lambda a: F.size(F.filter(a, lambda x: x == value))
    return ~F.array_contains(truth, value) | swapped | (times(found) > F.greatest(times(truth), F.lit(1)))


def unit_changes(matches: DataFrame, columns: tuple[str, ...], key) -> DataFrame:
    """matches: old_ and new_ columns of matched units. A row for each field that changed."""
    each = [F.when(rules.values_differ(F.col(f"old_{c}"), F.col(f"new_{c}"), key), F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new"))) for c in columns]
    return matches.withColumn("_c", F.explode(F.array_compact(F.array(*each)))).select("*", "_c.*").drop("_c")

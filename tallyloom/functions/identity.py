"""Keys and identities of orders and units: plates, phones, routes, candidate keys, row hashes, duplicate tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import norm_date, norm_key
from .text import any_filled, collapse, count_filled, digits, extract, filled, norm_text, strip

#: The fields of a stored order row.
ROW_FIELDS = ("tgl_ro", "tgl_muat", "pickup", "tujuan", "no_plat", "type_truck", "driver", "kontak_driver")
IDENTITY = ("driver", "no_plat", "kontak_driver")
CONTEXT = ("tgl_ro", "pickup", "tujuan", "type_truck")

norm_plate = norm_text


def norm_phone(c: Column) -> Column:
    """Digits with the country code 62 as a leading 0, and a 0 before a number that starts with 8."""
    d = digits(c)
    return (
        F.when(d.startswith("620"), F.concat(F.lit("0"), F.substr(d, F.lit(4))))
        .when(d.startswith("62"), F.concat(F.lit("0"), F.substr(d, F.lit(3))))
        .when(d.startswith("8"), F.concat(F.lit("0"), d))
        .otherwise(d)
    )


def report_phone(c: Column) -> Column:
    """The office report's phones: digits, 62 as a leading 0, nothing else."""
    d = digits(c)
    return F.when(d.startswith("62"), F.concat(F.lit("0"), F.substr(d, F.lit(3)))).otherwise(d)


def plain_phone(c: Column) -> Column:
    """The signature's phones: letters and digits, no country code rule."""
    return norm_text(c)


def plate_in_text(c: Column) -> Column:
    """The first plate-like token of a text: one or two letters, up to four digits, up to three letters."""
    return F.coalesce(extract(F.upper(c), r"\b([A-Z]{1,2}\s?\d{1,4}\s?[A-Z]{1,3})\b"), F.lit(""))


def clean_plate(c: Column) -> Column:
    """Letters, digits and spaces; empty without both a letter and a digit, or with no digit but 0."""
    p = collapse(F.regexp_replace(F.upper(strip(c)), "[^A-Z0-9 ]", ""))
    return F.when(p.rlike("[A-Z]") & p.rlike("[1-9]"), p).otherwise("")


def normalize_value(c: Column) -> Column:
    return norm_text(F.replace(F.upper(norm_dates(c)), F.lit("ON CALL"), F.lit("ONCALL")))


def norm_dates(c: Column) -> Column:
    from .dates import normalize_dates

    return normalize_dates(c)


def normalize_route(c: Column) -> Column:
    """TENTATIVE is spelled TENTATIF, dashes lose the spaces around, then letters and digits."""
    return normalize_value(F.regexp_replace(F.replace(F.upper(strip(c)), F.lit("TENTATIVE"), F.lit("TENTATIF")), r"\s*-\s*", "-"))


def route_text(c: Column) -> Column:
    """A route's places joined by commas; empty without letters."""
    text = F.translate(F.replace(F.upper(strip(c)), F.lit("–"), F.lit("-")), "/*", "- ")
    parts = F.filter(F.transform(F.split(text, r"[-,\s]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.rlike("[A-Z]"), F.array_join(parts, ", ")).otherwise("")


def context_key(tgl_ro: Column, pickup: Column, tujuan: Column, type_truck: Column) -> Column:
    """The key that groups the rows of one order."""
    return F.concat_ws("|", *(norm_key(c) for c in (tgl_ro, pickup, tujuan, type_truck)))


def row_context_key() -> Column:
    return context_key(*map(F.col, CONTEXT))


def base_key(fields: tuple[str, ...] = (*ROW_FIELDS, "status_unit")) -> Column:
    return F.concat_ws("|", *(F.upper(strip(F.col(c))) for c in fields))


def chat_scope(raw_chat_id: Column) -> Column:
    return F.coalesce(F.nullif(strip(raw_chat_id), F.lit("")), F.lit("global"))


def row_hash(base: Column, occurrence: Column, scope: Column) -> Column:
    return F.sha2(F.concat(scope, F.lit("|"), base, F.lit("|occ:"), occurrence.cast("string")), 256)


def signature(prefix: str = "") -> Column:
    """struct(driver, no_plat, kontak_driver), normalised."""
    return F.struct(*(norm_text(F.col(prefix + c)).alias(c) for c in IDENTITY))


def identity_tokens(prefix: str = "") -> Column:
    return F.array_compact(F.array(*(F.when(filled(F.col(prefix + c)), F.concat(F.lit(c + ":"), norm_text(F.col(prefix + c)))) for c in IDENTITY)))


def same_unit(a: Column, b: Column) -> Column:
    """Two signatures are one unit: the same plate, or two of the three fields."""
    equal = [(a[c] != "") & (a[c] == b[c]) for c in IDENTITY]
    return equal[1] | (sum((e.cast("int") for e in equal), F.lit(0)) >= 2)


def overlap(a: Column, b: Column) -> Column:
    return sum((((a[c] != "") & (a[c] == b[c])).cast("int") for c in IDENTITY), F.lit(0))


def unit_match_score(a: Column, b: Column) -> Column:
    """4 for the plate, 3 for the phone, 2 for the driver."""
    return sum((F.when((a[c] != "") & (a[c] == b[c]), w).otherwise(0) for c, w in (("no_plat", 4), ("kontak_driver", 3), ("driver", 2))), F.lit(0))


def pair_score(a: Column, b: Column, gain: int, loss: int) -> Column:
    """gain where both are filled and agree, -loss where they differ, else 0."""
    return F.when(filled(a) & filled(b), F.when(norm_key(a) == norm_key(b), gain).otherwise(-loss)).otherwise(0)


def row_context_score(a: str, b: str) -> Column:
    """How well a stored row's context (columns with prefix a) fits an incoming row's (prefix b)."""
    day = lambda p: norm_date(F.col(p + "tgl_muat"))
    both = filled(F.col(a + "tgl_muat")) & filled(F.col(b + "tgl_muat"))
    out = F.when(both, F.when(day(a) == day(b), 3).otherwise(-3)).otherwise(0)
    both = filled(F.col(a + "tgl_ro")) & filled(F.col(b + "tgl_ro"))
    out = out + F.when(both, F.when(norm_date(F.col(a + "tgl_ro")) == norm_date(F.col(b + "tgl_ro")), 2).otherwise(-2)).otherwise(0)
    for c, gain, loss in (("pickup", 2, 3), ("tujuan", 2, 3), ("type_truck", 1, 2)):
        x, y = F.col(a + c), F.col(b + c)
        out = out + F.when(filled(x) & filled(y), F.when(norm_text(x) == norm_text(y), gain).otherwise(-loss)).otherwise(0)
    return out


def candidate_score(a: str, b: str) -> Column:
    """The ranking score of a candidate order (prefix a) for an incoming batch (prefix b)."""
    return sum((pair_score(F.col(a + c), F.col(b + c), w, w) for c, w in (("tgl_ro", 2), ("pickup", 3), ("tujuan", 3), ("type_truck", 2))), F.lit(0))


def has_payload(fields: tuple[str, ...] = ROW_FIELDS) -> Column:
    return any_filled(*(F.col(c) for c in fields))


def has_identity() -> Column:
    return any_filled(*(F.col(c) for c in IDENTITY))


def complete_identity() -> Column:
    return count_filled(*(F.col(c) for c in IDENTITY)) == 3


#: Truck names by which types are compared; the first that a type contains counts.
TRUCKS = ("TRONTON", "TWB", "CDDL", "CDD", "CDE", "FUSO", "ENGKEL")


def truth_key(label: str, c: Column) -> Column:
    """The key by which a request date, a truck type or another value is compared with the truth."""
    from .dates import first_date, full_year, month_id

    key = norm_key(c)
    if label == "Tgl RO":
        text = strip(c)
        word = r"^(\d{1,2})([a-z]+)(\d{2,4})$"
        month = month_id(extract(key, word, 2))
        return (
            F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
            .when(first_date(text) != "", first_date(text))
            .when(month.isNotNull(), F.format_string("%04d-%02d-%02d", full_year(extract(key, word, 3)), month, extract(key, word, 1).try_cast("int")))
            .when(key.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(key, 1, 4), F.substring(key, 5, 2), F.substring(key, 7, 2)))
            .otherwise(key)
        )
    if label == "Type Truck":
        upper = F.upper(key)
        out = F.when(F.lit(False), "")
        for t in TRUCKS:
            out = out.when(upper.contains(t), t)
        return out.otherwise(F.regexp_replace(F.regexp_replace(upper, r"\d+CBM", ""), r"\d+", ""))
    return key


def entity_value(attr: Column, value: Column) -> Column:
    """An extracted value in the form in which it is counted against the truth, by attribute."""
    from .text import clean_cell

    return clean_entity_value(attr, clean_cell(value))


def clean_entity_value(attr: Column, text: Column) -> Column:
    """entity_value() of a text that went through clean_cell()."""
    from .dates import month_id

    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[/\\,.\-]+", " "), r"\s+", " ")
    p = r"^(\d{1,2})\s+([a-z]+|\d{1,2})\s+(\d{2,4})$"
    token = extract(t, p, 2)
    month = F.when(token.rlike(r"^\d"), F.lpad(token, 2, "0")).otherwise(F.lpad(month_id(token).cast("string"), 2, "0"))
    year = extract(t, p, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"\s*([,/:-])\s*", "$1")
    return (
        F.when(~filled(text), "")
        .when(attr == "UNIT_QTY", F.coalesce(extract(text, r"(\d{1,3})").try_cast("int").cast("string"), F.lit("")))
        .when(attr == "PHONE", report_phone(text))
        .when(attr == "PLATE", norm_text(text))
        .when((attr == "RO_DATE") & month.isNotNull(), F.concat_ws("-", F.lpad(extract(t, p, 1), 2, "0"), month, year))
        .otherwise(plain)
    )

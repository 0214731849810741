"""From chat exports to order blocks, fields and unit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fields
from ..functions.identity import norm_phone
from ..functions.text import filled, let, strip

#: The spellings that open a request.
REQUEST = r"(?:requestt?|reqest|reques|requer)(?!\s+order\s+khusus)"
HEADER = rf"(?im)(?=^[^\S\n]*(?:\[[^\]]+\]\s*[^:\n]+:\s*)?(?:{REQUEST}|oncall|unit\s+on\s+call|on\s+call)\b)"
FALLBACK = rf"(?i)(?=\[[^\]\n]*\])|(?im)(?=^[^\S\n]*(?:waktu\s*loading|{REQUEST}|oncall|unit\s+on\s+call|on\s+call))"
UNIT_LINE = r"(?im)(?=^[^\S\n]*\d{1,3}\s*unit\b)"
#: Units whose numbers stand in one array at a time: an order may ask for any number of them.
UNITS = 10_000


def tidy(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("")), F.lit("﻿"), F.lit(""))


def pieces(c: Column) -> Column:
    """The order blocks of a chat: split before each request header, without one before brackets and loading times; then a block with
    several unit lines becomes one for each, with the block's head repeated. Pure expressions: a text is split in its own row."""
    text = tidy(c)
    by_head = F.split(text, HEADER, -1)
    blocks = F.filter(F.transform(F.when(text.rlike(HEADER), by_head).otherwise(F.split(text, FALLBACK, -1)), strip), lambda x: x != "")

    def by_unit(block: Column) -> Column:
        def of(parts: Column) -> Column:
            starts_with_unit = F.get(parts, 0).rlike(r"(?i)^\s*\d{1,3}\s*unit\b")
            head = F.when(starts_with_unit, "").otherwise(strip(F.get(parts, 0)))
            bodies = F.filter(F.when(starts_with_unit, parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), lambda x: strip(x) != "")
            return let(bodies, lambda bs: F.when(F.size(bs) <= 1, F.array(block)).otherwise(F.transform(bs, lambda b: F.when(head == "", strip(b)).otherwise(F.concat(head, F.lit("\n"), strip(b))))))

        return let(F.split(block, UNIT_LINE, -1), of)

    return F.flatten(F.transform(blocks, by_unit))


def split_chats(chats: DataFrame, text: str = "chat_text", key: str = "chat_id") -> DataFrame:
    """chats: key, text. Returns key, chunk_no (from 0), chunk."""
    return chats.select(key, F.posexplode(pieces(F.col(text))).alias("chunk_no", "chunk"))


def order_fields(chunk: Column) -> dict[str, Column]:
    """What a block says once: its request date, quantity, type and place."""
    first = lambda label: F.coalesce(F.get(fields.field_values(chunk, label), 0), F.lit(""))
    return {
        "tgl_ro": dates.request_date(chunk),
        "qty": fields.unit_quantity(chunk),
        "type_truck": fields.unit_type(chunk),
        "pickup": first("lokasi"),
        "tujuan": first("rute/tujuan|rute"),
        "loadings": fields.slot_values(chunk, "waktu loading"),
        "drivers": fields.slot_values(chunk, "driver"),
        "plates": fields.slot_values(chunk, "nopol"),
        "phones": fields.slot_values(chunk, "no hp"),
        "routes": fields.slot_values(chunk, "rute/tujuan|rute"),
    }


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Adds order_fields() and normal labels' spelling."""
    ready = chunks.withColumn("chunk", fields.normal_labels(F.col("chunk")))
    return ready.select("*", *(c.alias(n) for n, c in order_fields(F.col("chunk")).items()))


def unit_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row a unit: the i-th driver, plate, phone, loading time and route; the quantity asked for or the slots listed, whichever is more,
    and all of them."""
    slots = F.greatest(F.coalesce("qty", F.lit(1)), F.size("drivers"), F.size("plates"), F.size("phones"), F.lit(1))
    said = (*keys, "tgl_ro", "type_truck", "pickup", "tujuan", "loadings", "drivers", "plates", "phones", "routes")
    parts = parsed.select(*said, (slots - 1).alias("_last"), F.explode(F.sequence(F.lit(0), F.floor((slots - 1) / UNITS).cast("int"))).alias("_part"))
    first = F.col("_part") * UNITS
    each = parts.select(*said, F.explode(F.sequence(first, first + F.least(F.col("_last") - first, F.lit(UNITS - 1)))).alias("slot_no"))
    at = lambda a: F.coalesce(F.get(F.col(a), F.col("slot_no")), F.lit(""))
    shared = lambda a: F.when(F.size(a) == 1, F.get(F.col(a), 0)).otherwise(at(a))
    return each.select(
        *keys, "slot_no", "tgl_ro", "type_truck", "pickup", F.when(filled(shared("routes")), shared("routes")).otherwise(F.col("tujuan")).alias("tujuan"),
        dates.loading_date(shared("loadings"), F.col("tgl_ro")).alias("tgl_muat"), at("drivers").alias("driver"), at("plates").alias("no_plat"), norm_phone(at("phones")).alias("kontak_driver"),
    )


def carry_timestamps(chunks: DataFrame, chat: str, order: str, text: str = "chunk") -> DataFrame:
    """Blocks without a [hh.mm, d/m/y] head take the last one before them in their chat."""
    w = Window.partitionBy(chat).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(fields.timestamp_head(F.col(text)), ignorenulls=True).over(w)
    return chunks.withColumn("timestamp_head", head)


def carry_pickups(rows: DataFrame, chat: str, order: str) -> DataFrame:
    """Empty units whose pickup is a scrap of letters inherit the last good pickup of their block."""
    letters = F.regexp_replace(F.upper(strip(F.col("pickup"))), "[^A-Z]", "")
    scrap = (F.length(letters) <= 2) | F.lower(strip(F.col("pickup"))).isin("qu", "re", "st")
    empty = ~(filled(F.col("driver")) | filled(F.col("no_plat")) | filled(F.col("kontak_driver")))
    w = Window.partitionBy(chat).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~scrap, F.col("pickup")), ignorenulls=True).over(w)
    return rows.withColumn("pickup", F.when(scrap & empty & before.isNotNull(), before).otherwise(F.col("pickup")))


def loading_segments(chunk: Column) -> Column:
    """The parts of a block that start at its loading times, or at the last place named between the loading time before and its own."""
    pieces = F.split(strip(F.replace(F.coalesce(chunk, F.lit("")), F.lit("\r"), F.lit(""))), r"(?im)(?=^[^\S\n]*waktu\s*loading\s*:)", -1)
    place = r"(?is)^(.*?)((?:(?<=\n)|^)[^\S\n]*lokasi\s*:(?:(?!\n[^\S\n]*lokasi\s*:).)*)$"

    def of(parts: Column) -> Column:
        last = F.size(parts) - 1
        begins = lambda x: x.rlike(r"(?i)^\s*waktu\s*loading\s*:")

        def whole(x: Column, i: Column) -> Column:
            ahead = F.coalesce(F.get(parts, i - 1), F.lit(""))
            tail = F.when(i > 0, F.regexp_extract(ahead, place, 2)).otherwise("")
            return F.when(begins(x), F.concat(tail, F.when((i < last) & x.rlike(place), F.regexp_extract(x, place, 1)).otherwise(x)))

        return F.array_compact(F.transform(parts, whole))

    return let(pieces, of)


def segment_identities(chunk: Column) -> Column:
    return F.transform(loading_segments(chunk), fields.segment_identity)


def marked_segments(chunk: Column) -> Column:
    """Numbers of the segments that a line marks as a revision, where the chat is one and there are several."""
    marks = lambda parts: F.array_compact(F.transform(parts, lambda x, i: F.when(fields.has_revision_marker(x), i)))
    none = F.array().cast("array<int>")
    return let(loading_segments(chunk), lambda parts: F.when((F.size(parts) > 1) & F.coalesce(chunk.rlike(fields.REVISION), F.lit(False)), marks(parts)).otherwise(none))


def header_starts(chat: Column) -> Column:
    """Numbers of the lines at which requests begin: the header's own line, or the line of metadata that stands before it (blank lines
    between do not count)."""

    def of(ls: Column) -> Column:
        head = rf"(?i)^[^\S\n]*(?:\[[^\]]+\]\s*[^:\n]+:\s*)?(?:{REQUEST}|oncall|unit\s+on\s+call|on\s+call)\b"
        written = F.array_compact(F.transform(ls, lambda x, i: F.when(strip(x) != "", i)))

        def start(i: Column) -> Column:
            before = F.array_max(F.filter(written, lambda j: j < i))
            return F.when(fields.is_metadata(F.coalesce(F.get(ls, before), F.lit(""))) & (strip(F.regexp_replace(F.coalesce(F.get(ls, before), F.lit("")), fields.METADATA + r"\s*(?:[^:\n]{1,60}:)?", "")) == ""), before).otherwise(i)

        return F.transform(F.array_compact(F.transform(ls, lambda x, i: F.when(x.rlike(head), i))), start)

    return let(F.split(tidy(chat), "\n", -1), of)

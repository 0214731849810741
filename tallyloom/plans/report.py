"""The office report: extracted rows, repaired, revised, blocked and expanded, as one ordered table a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions.fields import phones
from ..functions.identity import clean_plate, report_phone, route_text
from ..functions.text import extract, filled, let, lines, strip
from . import blocks
from .numbering import numbered

#: Words that make a chat a prompt and no order.
PROMPTS = ("contoh chat", "latih ai", "minta contoh")
#: The head of a message, and a loading time with its date.
_HEAD = r"(?=\[\d{2}[.,:]\d{2}[, ]+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\]\s*[^:]+:)"
_DATED_LOADING = r"(?i)(Waktu loading\s*:\s*)(.*?)(\s+\d{1,2}[/-]\d{1,2}[/-]\d{4}|\s+\d{1,2}\s+[a-zA-Z]+\s+\d{4})"


def format_chat(c: Column) -> Column:
    """A pasted chat without prompts; a loading time with a date becomes a head with the date and the time below it."""
    chunks = F.split(F.coalesce(c, F.lit("")), _HEAD, -1)
    kept = F.array_join(F.filter(chunks, lambda x: (strip(x) != "") & ~F.lower(x).rlike("|".join(PROMPTS))), "")
    stamp = r"\[\d{2}[.,:]\d{2}\s*,\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\]"

    def line(x: Column) -> Column:
        parts = [F.regexp_extract(x, _DATED_LOADING, k) for k in (1, 2, 3)]
        return F.when(~x.rlike(stamp) & x.rlike(_DATED_LOADING), F.concat(F.lit("\nREQUEST ORDER KHUSUS "), F.trim(parts[2]), F.lit("\n"), parts[0], F.trim(parts[1]))).otherwise(x)

    return let(F.when(strip(kept) == "", F.coalesce(c, F.lit(""))).otherwise(kept), lambda t: F.array_join(F.transform(lines(t), line), "\n"))


#: Words that no driver's name holds; the reference's list also has two persons' names, which are left out here.
NO_NAMES = ("admin", "jne", "logistik", "expedisi", "pengirim", "oncall", "request")


def driver_name(c: Column, refused: tuple[str, ...] = NO_NAMES) -> Column:
    """A name with capitals after everything that is no letter; empty if a word that is no name is in it."""
    text = strip(c)
    parts = F.split(F.lower(text), r"(?<=[^a-z])(?=[a-z])", -1)
    title = F.array_join(F.transform(parts, F.initcap), "")
    return F.when(~filled(c) | F.lower(text).rlike("|".join(refused)), "").otherwise(title)


def driver_pair(c: Column) -> Column:
    """struct(first, second): the values of driver 1 and driver 2, up to the next label, letters only."""

    def one(k: int) -> Column:
        raw = F.coalesce(extract(c, rf"(?i)(?:driver|pengemudi)\s*\.?\s*{k}\s*[:=]?\s*([^\n\r]+)"), F.lit(""))
        return driver_name(F.regexp_replace(F.regexp_replace(raw, r"(?i)\b(?:nopol|no\s*hp|driver|kontak)\b.*$", ""), r"[^A-Za-z' .]", ""))

    return F.struct(one(1).alias("first"), one(2).alias("second"))


def pair_up(a: Column, b: Column) -> Column:
    return F.when(F.lower(a) == F.lower(b), a).otherwise(F.concat(a, F.lit(" & "), b))


def with_driver_pair(driver: Column, text: Column) -> Column:
    """Both drivers of a text, where the cell is blank, names one of them or a pair."""
    return let(
        driver_pair(text),
        lambda p: F.when((p["first"] == "") | (p["second"] == ""), driver)
        .when((strip(driver) == "") | F.lower(driver_name(driver)).isin(F.lower(p["first"]), F.lower(p["second"])) | driver.contains("&"), pair_up(p["first"], p["second"]))
        .otherwise(driver),
    )


def with_phone_pair(phone: Column, text: Column) -> Column:
    """Both phones of a text that names two drivers, where the cell is blank or holds one or both of them."""

    def of(found: Column) -> Column:
        a, b = F.coalesce(F.get(found, 0), F.lit("")), F.coalesce(F.get(found, 1), F.get(found, 0), F.lit(""))
        mine = strip(phone)
        fits = (mine == "") | mine.isin(a, b) | (mine == F.concat(a, b)) | (mine == F.concat(b, a))
        return F.when((a != "") & ~mine.contains("&") & fits, pair_up(a, b)).otherwise(phone)

    pair = driver_pair(text)
    return F.when((pair["first"] != "") & (pair["second"] != ""), let(phones(text), of)).otherwise(phone)


def sanitize(rows: DataFrame) -> DataFrame:
    """Rows (driver, plate, phone, time, date, origin, destination, text): misplaced times go to their cell, SEGERA anywhere becomes the
    time, bare hours get minutes, phones and routes their form."""
    cell = lambda c: F.when(filled(F.col(c)), strip(F.col(c))).otherwise("")
    day, time = cell("date"), cell("time")
    hurry = F.lower(F.concat_ws(" ", "time", "date", "driver", "text")).contains("segera")
    misplaced = day.rlike(r"^(\d{1,2}|\d{1,2}[:.]\d{2})$")
    told = F.when(misplaced & (time == ""), day).otherwise(time)
    clock = F.replace(F.replace(told, F.lit("."), F.lit(":")), F.lit("*"), F.lit(""))
    clock = F.when(clock.rlike(r"^\d{1,2}$"), F.concat(F.lpad(clock, 2, "0"), F.lit(":00"))).otherwise(clock)
    numbers = F.transform(F.regexp_extract_all(cell("phone"), F.lit(r"(\d{6,})"), F.lit(1)), report_phone)
    phone = F.when(F.size(numbers) >= 2, F.concat_ws(" & ", F.get(numbers, 0), F.get(numbers, 1))).otherwise(report_phone(cell("phone")))
    return rows.withColumns({
        "time": F.when(hurry, "SEGERA").otherwise(clock),
        "date": F.when(misplaced | F.lower(day).contains("segera"), "").otherwise(day),
        "phone": phone,
        "driver": with_driver_pair(driver_name(F.col("driver")), F.col("text")),
        "origin": route_text(cell("origin")),
        "destination": route_text(cell("destination")),
    })


def take_revisions(rows: DataFrame, batch: str, seq: str, columns: tuple[str, ...] = ("driver", "plate", "phone", "date")) -> DataFrame:
    """Rows whose text is a revision are taken out and update the batch's rows of their time, the last filled value of each column."""
    marked = rows.withColumn("_t", dates.norm_time(F.col("time"))).withColumn("_rev", F.lower(F.coalesce("text", F.lit(""))).rlike("rev|revisi|update"))
    last = marked.where("_rev and _t <> ''").groupBy(batch, "_t").agg(*(F.max_by(c, F.when(filled(F.col(c)), F.col(seq))).alias(f"_{c}") for c in columns))
    kept = marked.where("not _rev").join(last, [batch, "_t"], "left")
    return kept.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def office_report(rows: DataFrame, batch: str, seq: str, as_of_year: int, job: str = "%03d", first_job: int = 42) -> DataFrame:
    """rows: batch, seq, unit_qty, unit_type, origin, destination, driver, plate, phone, time, date, text. The report's columns, a row a unit
    in the order of blocks; job numbers run on from first_job in each batch. The request date is always empty, so the status
    ASSIGNED, which asks for all nine fields, is not reached."""
    fixed = take_revisions(blocks.repair_headers(rows, batch, seq), batch, seq)
    marked = blocks.fill_blocks(blocks.mark_blocks(fixed, batch, seq), batch, seq, ("unit_type", "origin", "destination", "date"))
    clean = sanitize(marked)
    out = blocks.enforce_quota(clean, batch, seq, ("unit_type", "origin", "destination", "date"), ("driver", "plate", "phone", "time", "text"))
    out = out.withColumns({"driver": with_driver_pair(F.col("driver"), F.col("text")), "phone": with_phone_pair(F.col("phone"), F.col("text")), "plate": clean_plate(F.col("plate"))})
    n = F.row_number().over(Window.partitionBy(batch).orderBy("block_id", "slot_no"))
    out = out.withColumn("no", n).withColumn("job_number", F.format_string(job, F.col("no") + first_job - 1))
    cell = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    report = out.select(
        batch, "no", "job_number", F.lit("").alias("tgl_ro"), F.when(filled(F.col("date")), dates.written_date(F.col("date"), as_of_year)).otherwise("").alias("tgl_muat"), F.lit("").alias("vendor"),
        cell("origin").alias("pickup"), F.replace(cell("destination"), F.lit(" - "), F.lit(",")).alias("tujuan"), cell("plate").alias("no_plat"), cell("unit_type").alias("type_truck"),
        F.coalesce("driver", F.lit("")).alias("driver"), F.coalesce("phone", F.lit("")).alias("kontak_driver"), F.coalesce("time", F.lit("")).alias("jam_loading"),
    )
    nine = ("job_number", "tgl_ro", "tgl_muat", "pickup", "tujuan", "no_plat", "type_truck", "driver", "kontak_driver")
    return report.withColumn("status_unit", rules.status(*map(F.col, nine)))


def number_batches(rows: DataFrame, chat: str, created: str, chunk: str, slot: str) -> DataFrame:
    """A replay's numbers: batch_index over all chats by time and id, chunk and row numbers that run on within a chat."""
    chats = rows.select(chat, created).distinct()
    index = numbered(chats, created, chat, name="batch_index")
    w = Window.partitionBy(chat).orderBy(chunk, slot)
    return rows.join(index.select(chat, "batch_index"), chat).withColumn("row_no", F.row_number().over(w))

"""Dates inside free text: word dates with Indonesian or English month names and numeric dates, two-digit years in this century."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, extract, let, norm_text, replace_matches, strip

#: Month names and their short forms.
MONTHS = {
    "JAN": 1, "JANUARI": 1, "JANUARY": 1, "FEB": 2, "FEBRUARI": 2, "FEBUARI": 2, "FEBRUARY": 2, "MAR": 3, "MARET": 3, "MARCH": 3,
    "APR": 4, "APRIL": 4, "MEI": 5, "MAY": 5, "JUN": 6, "JUNI": 6, "JUNE": 6, "JUL": 7, "JULI": 7, "JULY": 7,
    "AGS": 8, "AGU": 8, "AGUSTUS": 8, "AUG": 8, "AUGUST": 8, "SEP": 9, "SEPT": 9, "SEPTEMBER": 9,
    "OKT": 10, "OKTOBER": 10, "OCT": 10, "OCTOBER": 10, "NOV": 11, "NOVEMBER": 11, "DES": 12, "DESEMBER": 12, "DEC": 12, "DECEMBER": 12,
}
#: The names that dates are written with.
NAMES = ("JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI", "JULI", "AGUSTUS", "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER")

WORD_DATE = r"\b(\d{1,2})[\s./-]+([A-Za-z]{3,15})[\s./-]+(\d{2,4})\b"
NUMBER_DATE = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
#: What a text needs for a date of either kind; a cheap test before the rewriting.
DATED = r"\d[\s./-]+[A-Za-z0-9]{1,15}[\s./-]+\d"
CLOCK = r"\b\d{1,2}\s*[:.;]\s*\d{2}\b"
_ANY = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def canonical_month(token: Column) -> Column:
    """Letters only, in upper case, repeated letters once, one misspelling of February put right."""
    out = F.regexp_replace(F.regexp_replace(F.upper(strip(token)), "[^A-Z]", ""), r"([A-Z])\1+", "$1")
    return F.replace(F.replace(out, F.lit("FEBUARY"), F.lit("FEBRUARI")), F.lit("FEBUARI"), F.lit("FEBRUARI"))


def month_id(token: Column) -> Column:
    """1 to 12, or null. Names as they are in MONTHS need no rewriting."""
    return F.coalesce(_lookup(MONTHS, token), _lookup(MONTHS, canonical_month(token)))


def month_name(n: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, NAMES)), n)


def full_year(token: Column) -> Column:
    y = token.try_cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _spelled(day: Column, month: Column, year: Column) -> Column:
    return F.concat_ws(" ", _padded(day, 2), month_name(month), _padded(year, 4))


#: What may stand between the parts of a word date, and beside them.
_BETWEEN, _DIGITS, _LETTERS = " \t\n\x0b\f\r./-", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _word_parts(m: Column) -> Column:
    """struct(day, month, year) of a match of WORD_DATE: its two first characters, its letters and its four last characters, each without
    what else can stand there. Characters are cheaper than three searches by the pattern."""
    without = lambda c, drop: F.translate(c, drop, "")
    upper = F.upper(m)
    return F.struct(
        without(F.substring(m, 1, 2), _BETWEEN).try_cast("int").alias("day"), month_id(without(upper, _DIGITS + _BETWEEN)).alias("month"),
        full_year(without(F.substring(upper, -4, 4), _LETTERS + _BETWEEN)).alias("year"),
    )


def _number_parts(m: Column) -> Column:
    """struct(day, month, year) of a match of NUMBER_DATE, or of one without its year (null)."""
    parts = lambda p: F.struct(F.get(p, 0).try_cast("int").alias("day"), F.get(p, 1).try_cast("int").alias("month"), full_year(F.get(p, 2)).alias("year"))
    return let(F.split(F.translate(m, "-", "/"), "/"), parts)


def _valid(p: Column) -> Column:
    return p["day"].between(1, 31) & p["month"].between(1, 12)


def normalize_dates(c: Column) -> Column:
    """Every date in the text rewritten as DD MONTHNAME YYYY; what is no date stays."""
    spelled = lambda p: _spelled(p["day"], p["month"], p["year"])
    word = lambda m: let(_word_parts(m), lambda p: F.when(p["month"].isNotNull(), spelled(p)).otherwise(m))
    numeric = lambda m: let(_number_parts(m), lambda p: F.when(_valid(p), spelled(p)).otherwise(m))
    dated = lambda t: F.when(t.rlike(DATED), replace_matches(replace_matches(t, WORD_DATE, word), NUMBER_DATE, numeric)).otherwise(t)
    return let(strip(c), dated)


def _key(rewritten: Column) -> Column:
    return F.regexp_replace(F.lower(rewritten), "[^a-z0-9]+", "")


def norm_key(c: Column) -> Column:
    """The key that texts are compared by: dates rewritten, lower case, letters a-z and digits."""
    return _key(normalize_dates(c))


def date_tokens(c: Column) -> Column:
    """All word dates, then all numeric dates, as yyyy-mm-dd, each once."""
    text = F.upper(F.coalesce(c, F.lit("")))
    iso = lambda p: F.concat_ws("-", _padded(p["year"], 4), _padded(p["month"], 2), _padded(p["day"], 2))
    word = lambda m: let(_word_parts(m), lambda p: F.when(p["month"].isNotNull(), iso(p)))
    numeric = lambda m: let(_number_parts(m), lambda p: F.when(_valid(p), iso(p)))
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), f) for p, f in ((WORD_DATE, word), (NUMBER_DATE, numeric))]
    return F.array_distinct(F.array_compact(F.concat(*found)))


def first_date(c: Column) -> Column:
    """The first date as yyyy-mm-dd, or the empty text."""
    return F.coalesce(F.get(date_tokens(c), 0), F.lit(""))


def request_date(c: Column) -> Column:
    """The date that is called the request's, else one soon after ON CALL, else the first."""
    text = F.coalesce(c, F.lit(""))
    said = [F.get(date_tokens(extract(text, p)), 0) for p in (r"(?is)\btanggal\s*request\s*[:=]\s*([^\n|]+)", r"(?is)\bon\s*call\b(.{0,90})")]
    return F.coalesce(*said, F.get(date_tokens(text), 0), F.lit(""))


def month_without_day(c: Column) -> Column:
    """A month and a year, but no full date."""
    text = F.upper(normalize_dates(c))
    full = text.rlike(rf"\b\d{{1,2}}\s+(?:{_ANY})\s+\d{{2,4}}\b") | text.rlike(NUMBER_DATE)
    return ~full & text.rlike(rf"\b(?:{_ANY})\s+\d{{2,4}}\b")


def _month_year(text: Column) -> Column:
    pattern = rf"\b(?:\d{{1,2}}\s+)?({_ANY})\s+(\d{{2,4}})\b"
    return F.struct(month_id(extract(text, pattern, 1)).alias("month"), full_year(extract(text, pattern, 2)).alias("year"))


def month_year(c: Column) -> Column:
    """struct(month, year), both null where the text has none."""
    return let(F.upper(normalize_dates(c)), _month_year)


def display_date(iso: Column) -> Column:
    """yyyy-mm-dd as dd monthname yyyy in lower case, else the empty text."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})$"
    name = month_name(F.nullif(extract(iso, pattern, 2).try_cast("int"), F.lit(0)))
    return F.when(name.isNotNull(), F.concat_ws(" ", extract(iso, pattern, 3), F.lower(name), extract(iso, pattern, 1))).otherwise("")


def repair_request_date(ro_date: Column, chunk: Column) -> Column:
    """A request date of month and year only takes the day from the header, if that has the same month and year."""

    def repaired(said: Column) -> Column:
        year, month = (extract(said, r"^(\d{4})-(\d{2})-\d{2}$", k).try_cast("int") for k in (1, 2))
        agrees = let(month_year(ro_date), lambda own: F.coalesce(own["month"].isNull() | own["year"].isNull() | ((own["month"] == month) & (own["year"] == year)), F.lit(False)))
        return F.when((said != "") & agrees, display_date(said)).otherwise(strip(ro_date))

    return F.when(month_without_day(ro_date), let(request_date(chunk), repaired)).otherwise(strip(ro_date))


def _norm_date(c: Column, upper: Column) -> Column:
    numeric, word = r"\b(\d{1,2})[/-](\d{1,2})(?:[/-](\d{2,4}))?\b", r"\b(\d{1,2})\s+([A-Z]+)(?:\s+(\d{2,4}))?\b"

    def written(p: Column) -> Column:
        said = F.concat(_padded(p["day"], 2), _padded(p["month"], 2), F.coalesce(_padded(p["year"], 4), F.lit("")))
        return F.when(F.coalesce(_valid(p), F.lit(False)), said).otherwise(norm_text(c))

    def named(m: Column) -> Column:
        with_year = F.substring(m, -1, 1) <= "9"  # it ends with a digit
        return let(_word_parts(m), lambda p: written(F.struct(p["day"].alias("day"), p["month"].alias("month"), F.when(with_year, p["year"]).alias("year"))))

    by_name = lambda upper: let(F.regexp_extract(upper, word, 0), lambda m: F.when(m != "", named(m)).otherwise(norm_text(c)))
    return let(F.regexp_extract(upper, numeric, 0), lambda m: F.when(m != "", let(_number_parts(m), written)).otherwise(by_name(upper)))


def norm_date(c: Column) -> Column:
    """DDMM or DDMMYYYY of the first date, else the text's letters and digits."""
    return let(F.upper(normalize_dates(c)), lambda upper: _norm_date(c, upper))


def _canonical(c: Column, iso: Column) -> Column:
    day, month, year = (F.substring(iso, a, n) for a, n in ((9, 2), (6, 2), (1, 4)))
    name = F.substring(month_name(month.try_cast("int")), 1, 3)
    return F.when(iso != "", F.concat_ws("-", day.try_cast("int").cast("string"), name, year)).otherwise(F.upper(strip(c)))


def canonical_date(c: Column) -> Column:
    """d-MON-yyyy of the first date (three letters of the month's name), else the text in upper case."""
    return let(first_date(c), lambda iso: _canonical(c, iso))


def date_forms(c: Column) -> Column:
    """struct(spelled, iso, ddmmyyyy, norm_key, month, year, canonical): normalize_dates(), first_date(), norm_date(), norm_key(),
    month_year() and canonical_date() of one text, which is rewritten and searched once for all of them."""

    def of(x: Column) -> Column:
        both = _month_year(x["upper"])
        forms = {"spelled": x["text"], "iso": x["iso"], "ddmmyyyy": _norm_date(c, x["upper"]), "norm_key": _key(x["text"]), "month": both["month"], "year": both["year"], "canonical": _canonical(c, x["iso"])}
        return F.struct(*(v.alias(n) for n, v in forms.items()))

    once = let(normalize_dates(c), lambda t: F.struct(t.alias("text"), F.upper(t).alias("upper"), first_date(c).alias("iso")))
    return let(once, of)


def loading_date(raw: Column, ro_date: Column) -> Column:
    """SEGERA and bare clock times mean the request's date; a date of its own wins; else the text in upper case."""

    def of(text: Column) -> Column:
        by_own = let(
            canonical_date(text),
            lambda own: F.when((own != "") & (own != text), own).when(text.rlike(CLOCK), canonical_date(ro_date)).otherwise(text),
        )
        return F.when(text == "", "").when(text.contains("SEGERA"), canonical_date(ro_date)).otherwise(by_own)

    return let(F.upper(strip(raw)), of)


def strict_date(c: Column) -> Column:
    """A date that exists, or null."""
    return F.try_to_timestamp(F.nullif(first_date(c), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def written_date(c: Column, as_of_year: int) -> Column:
    """Free text as DD MONTHNAME yyyy; a missing year is as_of_year, a two-digit one is the nearest within 50 years of it."""
    text = F.upper(collapse(c))
    pattern = r"\b(\d{1,2})[\s./-]+([A-Z]{3,15}|\d{1,2})(?:[\s./-]+(\d{2,4}))?\b"
    day, token, year = (extract(text, pattern, k) for k in (1, 2, 3))
    month = F.coalesce(month_id(token), token.try_cast("int"))
    two = year.try_cast("int") + as_of_year // 100 * 100
    near = F.when(two - as_of_year > 50, two - 100).when(as_of_year - two > 50, two + 100).otherwise(two)
    chosen = F.when(year.isNull(), F.lit(as_of_year)).when(F.length(year) <= 2, near).otherwise(year.try_cast("int"))
    good = day.try_cast("int").between(1, 31) & month.between(1, 12)
    return F.when(F.coalesce(good, F.lit(False)), _spelled(day.try_cast("int"), month, chosen)).otherwise(text)


def norm_time(c: Column) -> Column:
    """Points as colons; hours stay as they are written."""
    return F.replace(strip(c), F.lit("."), F.lit(":"))


def year_only(c: Column) -> Column:
    return strip(c).rlike(r"^(?:19|20)\d{2}$")


def doubled_year(c: Column) -> Column:
    """d month yyyy yyyy with one year twice."""
    return strip(c).rlike(r"(?i)\b\d{1,2}\s+[a-z]{3,15}\s+(\d{4})\s+\1\b")


def needs_flag(ro_date: Column) -> Column:
    """A request date that wants a look: a year alone, a month without its day, or a year twice."""
    return year_only(ro_date) | month_without_day(ro_date) | doubled_year(ro_date)

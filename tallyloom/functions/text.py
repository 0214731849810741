"""Text expressions. All are Column -> Column, in the JVM; null counts as the empty text unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank, after trimming and in lower case.
BLANKS = ("", "-", "null", "none", "nan", "undefined")
#: Unicode's white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(c: Column, body) -> Column:
    """body(c) with c computed once: the one element of an array, bound by a lambda."""
    return F.get(F.transform(F.array(c), body), 0)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends. Every rule strips, most many times a row, so it looks at the ends only: a pattern would
    search the whole text."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITE))


def blank(c: Column, vocabulary: tuple[str, ...] = BLANKS) -> Column:
    return F.lower(strip(c)).isin(*vocabulary)


def filled(c: Column, vocabulary: tuple[str, ...] = BLANKS) -> Column:
    return ~blank(c, vocabulary)


def count_filled(*cs: Column) -> Column:
    return sum((filled(c).cast("int") for c in cs), F.lit(0))


def any_filled(*cs: Column) -> Column:
    return count_filled(*cs) > 0


def all_filled(*cs: Column) -> Column:
    return count_filled(*cs) == len(cs)


def norm_text(c: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(strip(c)), "[^A-Z0-9]+", "")


def compact(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(strip(c)), r"\s+", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def tidy_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n{3,}", "\n\n"))


def clean_cell(c: Column) -> Column:
    """White space made single, none before stops and around slashes and dashes' colons."""
    out = collapse(c)
    out = F.regexp_replace(out, r"\s+([,.;:])", "$1")
    return strip(F.regexp_replace(out, r"\s*/\s*", "/"))


def lines(c: Column) -> Column:
    return F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("")), "\n", -1)


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_int(c: Column, pattern: str, group: int = 1) -> Column:
    return extract(c, pattern, group).try_cast("int")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]+", "")


def chat_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def distinct_filled(a: Column) -> Column:
    """The filled values, trimmed, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(a, strip), lambda x: filled(x)))


def distinct_by(a: Column, key) -> Column:
    """The first value of each key, in order."""
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def replace_matches(c: Column, pattern: str, render) -> Column:
    """Every match of the pattern replaced by render(match): the pieces between matches and the rendered matches, alternating. A text without
    a match, or that is one, is not cut: split() compiles its pattern for each row."""

    def of(text: Column) -> Column:
        def with_(found: Column) -> Column:
            pieces = F.zip_with(F.split(text, pattern, -1), F.transform(found, render), lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))))
            whole = F.coalesce(F.get(F.transform(found, render), 0), F.lit(""))
            return F.when(F.size(found) == 0, text).when(F.get(found, 0) == text, whole).otherwise(F.array_join(pieces, ""))

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_)

    return let(F.coalesce(c, F.lit("")), of)


def join_wordpieces(tokens: Column) -> Column:
    """Tokens joined by spaces, those that start with ## glued to the one before, stops without a space before."""
    glued = F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(glued, r"\s+([,.;:!?])", "$1"), r"\s*([/:-])\s*", "$1"))


def unstutter(token: Column) -> Column:
    """A token of even length over 4 whose halves agree becomes one half."""
    half = (F.length(token) / 2).cast("int")
    doubled = (F.length(token) > 4) & (F.length(token) % 2 == 0) & (F.substring(token, F.lit(1), half) == F.substring(token, half + 1, half))
    return F.when(doubled, F.substring(token, F.lit(1), half)).otherwise(token)


def number(c: Column, default: float = 0.0) -> Column:
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", number(c) * 100)


def percent_or_dash(c: Column, evaluated: Column) -> Column:
    return F.when(evaluated, percent(c)).otherwise(F.lit("-"))


def duration_text(ms: Column) -> Column:
    """Milliseconds under a second, seconds (dtk) under a minute, else minutes and seconds (m, d)."""
    x = number(ms)
    return (
        F.when(x <= 0, F.lit("-"))
        .when(x < 1000, F.format_string("%.0f ms", x))
        .when(x < 60000, F.format_string("%.2f dtk", x / 1000))
        .otherwise(F.format_string("%d m %d d", F.floor(x / 60000), F.floor(x / 1000) % 60))
    )


def metric_text(name: Column, value: Column) -> Column:
    """Losses with 4 places, run times in seconds, rates with 2 places, shares as percent."""
    x = value.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("-"))
        .when(name.contains("loss"), F.format_string("%.4f", x))
        .when(name.contains("runtime"), F.format_string("%.2fs", x))
        .when(name.contains("per_second"), F.format_string("%.2f", x))
        .when(F.abs(x) <= 1.5, F.format_string("%.2f%%", x * 100))
        .otherwise(F.format_string("%.4f", x))
    )

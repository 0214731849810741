"""The rule-based annotator: entities with their places in a text, and the text's intent. Matches' places are not to be had from
expressions, so an Arrow function looks for them, a batch of texts at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each entity looks like; the group that holds it is named v. Rules that may begin anywhere name both cases of their
#: first letter, as re then looks for these instead of trying each place.
RULES = {
    "RO_DATE": r"[oO](?<!\w[oO])(?i:n\s*call\s+(?P<v>\d{1,2}[\s/-]+(?:[a-z]{3,10}|\d{1,2})[\s/-]+\d{2,4}))",
    "LOAD_DATE": r"[wW](?i:aktu\s*loading\s*:[^\n]*?(?P<v>\d{1,2}/\d{1,2}/\d{2,4}))",
    "UNIT_QTY": r"(?im)^\s*(?P<v>\d{1,3})\s*unit\b",
    "UNIT_TYPE": r"(?im)^\s*\d{1,3}\s*unit\s+(?P<v>[^\n:]+?)\s*$",
    "ORIGIN": r"(?im)^\s*lokasi\s*:\s*(?P<v>[^\n]+?)\s*$",
    "DESTINATION": r"(?im)^\s*rute(?:/tujuan)?\s*:\s*(?P<v>[^\n]+?)\s*$",
    "DRIVER": r"(?im)^\s*driver\s*:\s*(?P<v>[^\n]+?)\s*$",
    "PLATE": r"(?im)^\s*nopol\s*:\s*(?P<v>[^\n]+?)\s*$",
    "PHONE": r"(?im)^\s*no\s*hp\s*:\s*(?P<v>\+?[\d\s-]{8,20}\d)",
    "TIME": r"[wW](?i:aktu\s*loading\s*:\s*(?P<v>segera|\d{1,2}[:.]\d{2}))",
}
#: Rules of one line begin so, and go on with a digit or one of these letters, which have no other case than the two of ASCII.
LINE, FIRST = r"(?im)^\s*", "abcdefghjlmnopqrtuvwxyz"
SPANS = "array<struct<label string, start int, stop int, value string, confidence double>>"
SPAN_TYPES = {"label": pa.string(), "start": pa.int32(), "stop": pa.int32(), "value": pa.string(), "confidence": pa.float64()}
#: Texts whose tuples a Python worker holds at a time.
TEXTS = 256


def lists_of(texts: pa.Array, found_in: Callable[[list[str]], list[Iterable[tuple]]], types: dict[str, pa.DataType]) -> pa.Array:
    """What found_in finds in texts (null: empty), a list of structs a text. Tuples become Arrow's arrays TEXTS texts at a time: a batch's
    would fill the worker, and as dictionaries several times so."""
    done = []
    for at in range(0, len(texts), TEXTS):
        found = [list(f) for f in found_in([t or "" for t in texts.slice(at, TEXTS).to_pylist()])]
        ends = [0]
        for f in found:
            ends.append(ends[-1] + len(f))
        columns = zip(*(x for f in found for x in f)) if ends[-1] else ((),) * len(types)
        structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))
        done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.struct(list(types.items()))))


def by_first(rules: dict[str, str]) -> tuple[list, list, dict[str, list]]:
    """(label, compiled rule) of rules that may begin anywhere, of those of lines that begin with a digit, and of those of lines by their
    first letter. A line's rule need be tried at the starts of lines that are not blank only, as blanks before its first letter are skipped."""
    anywhere, digits, letters = [], [], {}
    for label, rule in rules.items():
        pair, then = (label, re.compile(rule)), rule.removeprefix(LINE)
        if then != rule and "|" not in re.sub(r"\(.*?\)|\[.*?\]", "", then) and then.startswith(("\\d{1", r"(?P<v>\d{1")):
            digits.append(pair)
        elif then != rule and "|" not in re.sub(r"\(.*?\)|\[.*?\]", "", then) and re.match(rf"[{FIRST}](?![*?{{|])", then):
            for x in (then[0], then[0].upper()):
                letters.setdefault(x, []).append(pair)
        else:
            anywhere.append(pair)
    return anywhere, digits, letters


def annotate(texts: DataFrame, text: str = "text", rules: dict[str, str] = RULES, extractor=None) -> DataFrame:
    """Adds spans, ordered by place. extractor: a function from a list of texts to lists of (label, start, stop, value, confidence), for
    models; the default applies the rules, with confidence 1."""
    anywhere, digits, letters = by_first(rules)

    def by_rules(values: list[str]) -> list[list[tuple]]:
        found = []
        for t in values:
            some = [(*m.span("v"), label, m["v"]) for label, p in anywhere for m in p.finditer(t)]
            at, ends = 0, {}
            for line in t.split("\n"):
                if bare := line.lstrip():
                    first = bare[0]
                    for label, p in letters.get(first, ()) or (digits if first.isdecimal() else ()):
                        if at >= ends.get(label, 0) and (m := p.match(t, at)):
                            some.append((*m.span("v"), label, m["v"]))
                            ends[label] = m.end()
                at += len(line) + 1
            found.append([(label, a, b, v, 1.0) for a, b, label, v in sorted(some)])
        return found

    @F.arrow_udf(SPANS)
    def spans(column: pa.Array) -> pa.Array:
        return lists_of(column, extractor or by_rules, SPAN_TYPES)

    return texts.withColumn("spans", spans(F.col(text)))


def intent(c: Column) -> Column:
    """CANCEL before UPDATE before INFO before NEW_ORDER."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"\b(cancel|batal)\b"), "CANCEL").when(t.rlike(r"\b(update|revisi|rev|ubah|ganti)\b"), "UPDATE").when(t.rlike(r"\b(info|fyi|mohon)\b") & ~t.rlike(r"\bunit\b"), "INFO").otherwise("NEW_ORDER")


def values_of(spans: Column, label: str) -> Column:
    return F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: s["value"])


def grouped(rows: DataFrame, keys: list[str], once: tuple[str, ...] = ("RO_DATE", "ORIGIN", "UNIT_TYPE")) -> DataFrame:
    """spans as a row a label with its values in order; labels in `once` have each value once, phones of under eight digits are left out."""
    each = rows.select(*keys, F.posexplode("spans").alias("at", "s")).where("s.label <> 'PHONE' or length(regexp_replace(s.value, '[^0-9]', '')) >= 8")
    g = each.groupBy(*keys, F.col("s.label").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s.value"))), lambda x: x["value"]).alias("v"), F.avg("s.confidence").alias("confidence"))
    return g.select(*keys, "label", F.when(F.col("label").isin(*once), F.array_distinct("v")).otherwise(F.col("v")).alias("values"), "confidence")


def loading_values(spans: Column) -> Column:
    """Neighbouring TIME and LOAD_DATE spans as one value."""
    some = F.filter(spans, lambda s: s["label"].isin("TIME", "LOAD_DATE"))

    def merged(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["label"] == "TIME") & (s["label"] == "LOAD_DATE"), F.lit(False))
        one = F.struct(s["label"].alias("label"), s["value"].alias("value"))
        both = F.struct(F.lit("LOAD_DATE").alias("label"), F.concat_ws(" ", last["value"], s["value"]).alias("value"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(one)))

    empty = F.array().cast("array<struct<label:string,value:string>>")
    return F.transform(F.aggregate(some, empty, merged), lambda x: x["value"])

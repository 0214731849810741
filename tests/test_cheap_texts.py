"""Stripping and dates without needless searches against a plain version, and the merge's rows in few batches."""

import itertools
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallyloom.functions import dates, text
from tallyloom.functions.identity import ROW_FIELDS
from tallyloom.operators import merge


def _month(token):
    m = re.sub("[^A-Z]", "", token.upper())
    m = re.sub(r"([A-Z])\1+", r"\1", m).replace("FEBUARY", "FEBRUARI").replace("FEBUARI", "FEBRUARI")
    return dates.MONTHS.get(m)


def _year(y):
    return int(y) + 2000 if int(y) < 100 else int(y)


def _normalized(s):
    spelled = lambda d, m, y: f"{int(d):02d} {dates.NAMES[m - 1]} {_year(y):04d}"
    word = lambda m: spelled(m[1], _month(m[2]), m[3]) if _month(m[2]) else m[0]
    number = lambda m: spelled(m[1], int(m[2]), m[3]) if 1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12 else m[0]
    s = s.strip("".join(text.WHITE))
    return re.sub(dates.NUMBER_DATE, number, re.sub(dates.WORD_DATE, word, s, flags=re.A), flags=re.A) if re.search(dates.DATED, s, re.A) else s


def _tokens(s):
    s, out = s.upper(), []
    for m in re.finditer(dates.WORD_DATE, s, re.A):
        out += [f"{_year(m[3]):04d}-{_month(m[2]):02d}-{int(m[1]):02d}"] if _month(m[2]) else []
    for m in re.finditer(dates.NUMBER_DATE, s, re.A):
        out += [f"{_year(m[3]):04d}-{int(m[2]):02d}-{int(m[1]):02d}"] if 1 <= int(m[1]) <= 31 and 1 <= int(m[2]) <= 12 else []
    return list(dict.fromkeys(out))


def test_dates_equal_a_plain_version(spark):
    whole = [f"{d}{a}{m}{b}{y}" for d, m, y, (a, b) in itertools.product(("5", "05", "31", "99"), ("mei", "JULLI", "Febuary", "febuari", "Septt", "abc", "3", "13"), ("97", "199", "2024"), (("/", "-"), (" ", " "), ("-", "/"), (" .\t", "\n- ")))]
    texts = whole + [f" tgl {w} pagi" for w in whole[::5]] + [f"{a} dan {b}x {a}" for a, b in zip(whole, whole[7:])][::3]
    texts += ["", "-", "x5 mei 2024", "5 mei 2024a 5 mei 2024", "1/2/3/2024", "1/2/2024/5", "12345", "　 5 mei 24 \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, normal, tokens in df.select("t", dates.normalize_dates(F.col("t")), dates.date_tokens(F.col("t"))).collect():
        assert (normal, tokens) == (_normalized(t), _tokens(t)), t
    short = {"5/3": "0503", "5 mei": "0505", "5 AB": "5AB", "5 a 24": "5A24", "5 mei 97": "05052097", "32/1": "321", "9 JULLI x": "0907"}
    df = spark.createDataFrame([(t,) for t in short], "t string")
    assert {t: k for t, k in df.select("t", dates.norm_date(F.col("t"))).collect()} == short


def test_strip_takes_white_space_of_any_kind_and_searches_nothing(spark):
    chars = "".join(c for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000)
    ends = spark.createDataFrame([(c, f"{c}\n{c}a{c}b{c}") for c in chars], "c string, t string")
    by_pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert ends.select("c", text.strip(F.col("t")).alias("x"), by_pattern.alias("y")).where("x <> y").count() == 0
    assert "regexp" not in str(text.strip(F.col("t"))).lower()


def test_merged_rows_of_many_scopes_go_out_in_few_batches(spark, monkeypatch):
    columns = "scope string, seq long, " + ", ".join(f"{c} string" for c in ROW_FIELDS) + ", status_unit string"
    rows = [(f"s{i}", 1, "5 mei 2024", "", "A", "B", "", "CDD", "", "", "") for i in range(300)]
    new = [(f"s{i}", 1, "5 mei 2024", "", "A", "B", f"B {i} X", "CDD", "ANI", "0811", "") for i in range(300)]
    kept = {}

    def keep(self, fn, schema):
        kept.update(df=self, fn=fn)
        return self

    monkeypatch.setattr(DataFrame, "mapInArrow", keep)
    merge.smart_merge(spark.createDataFrame(rows, columns), spark.createDataFrame(new, columns))
    monkeypatch.undo()
    out = list(kept["fn"](iter(kept["df"].toArrow().to_batches())))
    assert sum(b.num_rows for b in out) == 300 and len(out) == 1
    assert set(pa.Table.from_batches(out)["outcome"].to_pylist()) == {"updated"}

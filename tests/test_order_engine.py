"""The order engine: expressions against plain Python, kernels against plain models, queries against DuckDB."""

from __future__ import annotations

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.functions import dates, fields, identity, rules, text
from tallyloom.operators import merge
from tallyloom.plans import annotate, blocks, datasets, evaluate, evidence, matching, parse, report, workspace
from tallyloom.sources import io
from tallyloom.streaming import chats as stream

SF = "/root/testdata/sf0.001"


def ask(spark, expression, *values):
    """The expression's value for each text."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.v for r in df.select("i", expression(F.col("c")).alias("v")).orderBy("i").collect()]


def test_blank_and_clean(spark):
    assert ask(spark, text.blank, None, "", " - ", "NaN", "None", "undefined", "x", "0") == [True] * 6 + [False] * 2
    assert ask(spark, text.strip, "\t x \n", "  a") == ["x", "a"]
    assert ask(spark, text.norm_text, " b-12 xy ", None) == ["B12XY", ""]
    assert ask(spark, text.tidy_newlines, "a\n\n\n\nb ") == ["a\n\nb"]
    assert ask(spark, text.unstutter, "XAXA12XAXA12", "abcab", "aa") == ["XAXA12", "abcab", "aa"]
    assert ask(spark, lambda c: text.join_wordpieces(F.split(c, " ")), "ban ##dung , kota") == ["bandung, kota"]


def test_distinct_by(spark):
    got = ask(spark, lambda c: F.array_join(text.distinct_by(F.split(c, ","), lambda x: F.lower(x)), "|"), "A,b,a,B,c")
    assert got == ["A|b|c"]


def test_dates(spark):
    texts = ["tgl 5 Jan 24 dan 07/3/2024", "31-12-99", "5 foo 2024", "12/13/2024", "11/2/24 1/2/24", None]
    assert ask(spark, dates.normalize_dates, *texts) == ["tgl 05 JANUARI 2024 dan 07 MARET 2024", "31 DESEMBER 2099", "5 foo 2024", "12/13/2024", "11 FEBRUARI 2024 01 FEBRUARI 2024", ""]
    assert ask(spark, dates.date_tokens, texts[0], texts[2])[0] == ["2024-01-05", "2024-03-07"]
    assert ask(spark, dates.first_date, "x", "1 Febuari 2024") == ["", "2024-02-01"]
    assert ask(spark, dates.month_id, "agustus", "AGS", "Aagguussttuuss", "zz") == [8, 8, 8, None]
    assert ask(spark, dates.norm_date, "5/1", "5/1/24", "5 mei 2024", "40/1/2024", "hari") == ["0501", "05012024", "05052024", "4012024", "HARI"]
    assert ask(spark, dates.request_date, "UNIT ON CALL 3 Mei 2024\n1/1/2023", "tanggal request: 2/2/2024 | 1/1/2023") == ["2024-05-03", "2024-02-02"]
    assert ask(spark, dates.month_without_day, "MEI 2024", "5 MEI 2024", "x") == [True, False, False]
    assert ask(spark, lambda c: dates.loading_date(c, F.lit("5/1/2024")), "SEGERA", "08.00", "08:00 6/1/2024", "malam", "") == ["5-JAN-2024", "5-JAN-2024", "6-JAN-2024", "MALAM", ""]
    assert ask(spark, lambda c: dates.written_date(c, 2026), "5 mei", "5-5-24", "1/2/99") == ["05 MEI 2026", "05 MEI 2024", "01 FEBRUARI 1999"]
    assert ask(spark, dates.strict_date, "30/2/2024", "29/2/2024") == [None, dt.date(2024, 2, 29)]
    assert ask(spark, dates.doubled_year, "5 mei 2024 2024", "5 mei 2024") == [True, False]
    assert ask(spark, dates.display_date, "2024-05-03", "x", "2024-00-01") == ["03 mei 2024", "", ""]


def test_identities(spark):
    assert ask(spark, identity.norm_phone, "+62 812", "620812", "812", "0812", None) == ["0812", "0812", "0812", "0812", ""]
    assert ask(spark, identity.report_phone, "+62 812", "812") == ["0812", "812"]
    assert ask(spark, identity.clean_plate, "b 1234 xy", "B 000 X", "1234", "abc") == ["B 1234 XY", "", "", ""]
    assert ask(spark, identity.plate_in_text, "nopol b 1234 xy ok", "x") == ["B 1234 XY", ""]
    assert ask(spark, identity.route_text, "Bekasi – kota/jauh", "123") == ["BEKASI, KOTA, JAUH", ""]
    assert ask(spark, lambda c: identity.truth_key("Type Truck", c), "cddl 24 cbm", "Box 10CBM") == ["CDDL", "BOX"]
    assert ask(spark, lambda c: identity.truth_key("Tgl RO", c), "2024-05-03", "3 mei 24", "20240503") == ["2024-05-03"] * 3


def test_fields(spark):
    t = "[08.15, 1/2/2024] Budi: REQUEST order\n3 unit TRONTON\nlokasii: GUDANG\nwaktu loadng : 08:00\nNopl: B 1 X\nno hp: +62 812-3456-789\nmohon bantu"
    ready = ask(spark, fields.prepared, t)[0]
    assert ready.splitlines() == ["REQUEST order", "3 unit TRONTON", "Lokasi : GUDANG", "Waktu loading : 08:00", "Nopol : B 1 X", "No hp : +62 812-3456-789"]
    assert ask(spark, fields.unit_quantity, t, "qty target: 7", "x") == [3, 7, None]
    assert ask(spark, fields.unit_type, "3 unit tronton 20 cbm\nLokasi : X", "x") == ["TRONTON 20 CBM", ""]
    assert ask(spark, fields.phones, t) == [["08123456789"]]
    assert ask(spark, lambda c: fields.rewrite_summary(c, F.lit(2), F.lit(3)), "a terisi 1/3 b terisi 0/1", "a") == ["a terisi 2/3 b terisi 0/1", "a | terisi 2/3"]
    assert ask(spark, lambda c: fields.filled_state(c)["filled"], "Terisi: 2/5", "") == [2, None]


def test_splitting(spark):
    chat = "﻿halo\r\nREQUEST satu\n1 unit A\n2 unit B\nreques dua\n1 unit C\n[08.00, 1/2/2024] Ani: ONCALL tiga\nREQUEST ORDER KHUSUS bukan kepala"
    got = ask(spark, parse.pieces, chat, "Waktu loading: 08:00\nWaktu loading: 09:00", "", None)
    assert got[0] == ["halo", "REQUEST satu\n1 unit A", "REQUEST satu\n2 unit B", "reques dua\n1 unit C", "[08.00, 1/2/2024] Ani: ONCALL tiga\nREQUEST ORDER KHUSUS bukan kepala"]
    assert got[1] == ["Waktu loading: 08:00", "Waktu loading: 09:00"] and got[2:] == [[], []]
    assert ask(spark, parse.marked_segments, "Waktu loading : 1\nrevisi x\nWaktu loading : 2") == [[0]]


def test_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    l = F.lit  # noqa: E741
    d = lambda *x: value(rules.decision(*map(l, x))).decision_status
    assert d(True, 1, 1, 0, "MATCH", 0.9, False, 1, 0) == "TIDAK_COCOK"
    assert d(False, 0, 0, 0, "MATCH", 0.9, False, 0, 0) == "PERLU_REVIEW"
    assert d(False, 1, 0, 1, "MATCH", 0.9, False, 0, 0) == "DUPLIKAT"
    assert d(False, 1, 1, 0, "NO_MATCH", 0.1, True, 1, 0) == "TIDAK_COCOK"
    assert d(False, 1, 1, 0, "MATCH", 0.9, True, 1, 0) == "CONFLICT"
    assert d(False, 1, 1, 0, "MATCH", 0.4, False, 1, 0) == "TIDAK_COCOK"
    assert d(False, 1, 1, 0, "MATCH", 0.9, False, 1, 0) == "SIAP_ISI_SLOT"
    assert d(False, 2, 2, 0, "MATCH", 0.9, False, 1, 1) == "PERLU_REVIEW"
    s = lambda *x: value(rules.evaluation_status(*map(l, x)))
    assert [s(0, 0, 0), s(1, 0, 0), s(1, 1, 1, True), s(1, 1, 0, False, 1), s(0, 0, 1), s(0, 1, 0), s(1, 1, 0), s(1, 0, 1), s(1, 1, 1), s(0, 1, 1)] == ["EMPTY", "CORRECT", "LABEL_SWAP", "DUPLICATE", "MISSING", "SPURIOUS", "OVEREXTRACTED", "UNDEREXTRACTED", "MIXED", "WRONG"]
    assert value(rules.predicted_label(l(""), l(0.5))) == "MATCH" and value(rules.predicted_label(l(""), l(0.4))) == "NO_MATCH"
    assert [value(rules.confidence_bucket(l(x), l(True))) for x in (0.95, 0.7, 0.1)] == ["HIGH", "MEDIUM", "LOW"]
    assert [value(rules.quality_class(*map(l, x))) for x in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))] == ["neutral", "good", "warn", "bad"]
    assert value(rules.passes_event_gate(l("NON_ORDER"), l(0.75))) is False


FIELDS = ("tgl_ro", "tgl_muat", "pickup", "tujuan", "no_plat", "type_truck", "driver", "kontak_driver")


def order_rows(spark, rows):
    return spark.createDataFrame([(i, *(r.get(c, "") for c in FIELDS), r.get("status_unit", "PARTIAL")) for i, r in rows], "seq long, " + ", ".join(f"{c} string" for c in FIELDS) + ", status_unit string")


IDENT = ("driver", "no_plat", "kontak_driver")


def plain_merge(stored, incoming, chat):
    """The save of a chat's rows in plain Python, on dictionaries of raw values: the stored rows as they end, and what is inserted."""
    blank = lambda v: (v or "").strip().lower() in text.BLANKS
    key = lambda c, v: plain_phone(v) if c == "kontak_driver" else re.sub("[^A-Z0-9]", "", (v or "").upper())
    eq = lambda c, r, x: key(c, r[c]) == key(c, x[c])
    said = lambda c, x: key(c, x[c]) != ""
    clash = lambda r, x: any(said(c, r) and said(c, x) and not eq(c, r, x) for c in IDENT)
    missing = lambda r: sum(blank(r[c]) for c in IDENT)
    rows, used, new, seen_segments = [dict(r) for r in stored], set(), [], set()
    revision = bool(re.search(r"(?i)\b(rev|revisi|update)\b", chat["text"]))

    def state(r):
        if r["status_unit"] in ("ASSIGNED", "PARTIAL", "UNASSIGNED"):
            return r["status_unit"]
        n = sum(not blank(r[c]) for c in FIELDS)
        return "ASSIGNED" if n == 8 else "PARTIAL" if n >= 3 else "UNASSIGNED"

    def score(r, x):
        out = 0
        for c, plus, minus in (("tgl_muat", 3, 3), ("tgl_ro", 2, 2), ("pickup", 2, 3), ("tujuan", 2, 3), ("type_truck", 1, 2)):
            if not blank(r[c]) and not blank(x[c]):
                same = plain_day(r[c]) == plain_day(x[c]) if c.startswith("tgl") else eq(c, r, x)
                out += plus if same else -minus
        return out

    def write(i, x, over):
        r = rows[i]
        now = {c: x[c].strip() for c in FIELDS if not blank(x[c]) and (blank(r[c]) or (over and not eq(c, r, x)))}
        r.update(now)
        if now:
            r["status_unit"] = ""
            r["status_unit"] = state(r)
            used.add(i)
        return bool(now)

    def match(x, segment):
        if missing(x) == 3:
            return False
        every, free = list(range(len(rows))), [i for i in range(len(rows)) if i not in used]
        if revision:
            old = [i for i in free if (chat["plate"] and key("no_plat", rows[i]["no_plat"]) == chat["plate"]) or (chat["phone"] and plain_phone(rows[i]["kontak_driver"]) == chat["phone"])]
            if not all(blank(x[c]) for c in ("tgl_ro", "tgl_muat", "pickup", "tujuan", "type_truck")):
                old = [i for i in old if score(rows[i], x) >= 3]
            if len(old) == 1:
                return write(old[0], x, True)
            if segment is not None:
                fit = [i for i in every if score(rows[i], x) >= 5]
                fit = fit[-chat["declared"] :] if chat["declared"] else fit
                if segment < len(fit):
                    return write(fit[segment], x, True)
        for i in every:
            s = score(rows[i], x)
            if (s > 2 or (s == 2 and not (blank(x["tgl_ro"]) and blank(x["tgl_muat"])))) and any(said(c, x) for c in IDENT) and all(eq(c, rows[i], x) for c in IDENT if said(c, x)):
                used.add(i)
                return True
        over = [i for i in free if revision and state(rows[i]) == "ASSIGNED" and score(rows[i], x) >= 7 and clash(rows[i], x)]
        options = []
        for i in free:
            r, s = rows[i], score(rows[i], x)
            is_open = state(r) != "ASSIGNED"
            if s < 3:
                continue
            if said("no_plat", x) and eq("no_plat", r, x):
                level = 3 * (is_open or revision)
            elif revision and said("driver", x) and said("kontak_driver", x) and eq("driver", r, x) and eq("kontak_driver", r, x):
                level = 2
            else:
                level = 1 * (over == [i] or (is_open and (any(said(c, x) and blank(r[c]) for c in IDENT) or (revision and clash(r, x)))))
            if level:
                options.append((level, 10 * s + missing(r), -i))
        return bool(options) and write(-max(options)[2], x, revision)

    for k, x in enumerate(incoming):
        if all(blank(x[c]) for c in FIELDS):
            continue
        if revision and chat["marked"]:
            share = [sum(said(c, x) and key(c, x[c]) == s[c] for c in IDENT) for s in chat["segments"]]
            seg = share.index(max(share)) if share and max(share) and share.count(max(share)) == 1 else k
            if seg in chat["marked"] and seg not in seen_segments and match(x, seg):
                seen_segments.add(seg)
            continue
        if match(x, None):
            continue
        if missing(x) == 3:
            hold = [(10 * score(r, x) + missing(r), -i) for i, r in enumerate(rows) if i not in used and state(r) != "ASSIGNED" and missing(r) and score(r, x) >= 3]
            if hold:
                used.add(-max(hold)[1])
                continue
        elif any(all(eq(c, r, x) for c in FIELDS) for r in rows):
            continue
        new.append(dict(x, status_unit=x["status_unit"] or state(x)))
    return sorted((o, *(r[c] for c in FIELDS), r["status_unit"]) for o, side in (("stored", rows), ("incoming", new)) for r in side)


def plain_phone(v):
    d = re.sub(r"\D", "", v or "")
    return "0" + d[3:] if d.startswith("620") else "0" + d[2:] if d.startswith("62") else "0" + d if d.startswith("8") else d


def plain_day(v):
    """Of the test's spellings: d/m/yyyy and d MONTH yyyy."""
    m = re.match(r"(\d+)[ /](\w+)[ /](\d+)", v.strip())
    return (int(m[1]), {"FEB": 2, "FEBRUARI": 2, "MARET": 3}.get(m[2].upper()) or int(m[2]), int(m[3])) if m else re.sub("[^A-Z0-9]", "", v.upper())


def merge_cases(n, seed):
    """Scopes with mismatches, blanks, other spellings, plain and revised chats."""
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    row = lambda: {
        "tgl_ro": pick("1/2/2024", "01 FEB 2024", "1 FEBRUARI 2024", "2/2/2024", "", "-"), "tgl_muat": pick("3/2/2024", "3 FEB 2024", "4/3/2024", "4 MARET 2024", "", "null"), "pickup": pick("GUDANG A", "gudang-a", "GUDANG A", "B", ""),
        "tujuan": pick("KOTA 1", "kota 1", "KOTA 1", "KOTA 2", ""), "type_truck": pick("CDD", "CDD", "cdd ", "FUSO", ""), "driver": pick("ani", "ANI", "budi", "cici", "", "-"),
        "no_plat": pick("B 1 X", "b1x", "B 2 Y", "B 3 Z", "", "none"), "kontak_driver": pick("0811", "+62811", "62 811", "08220000", "0833", ""), "status_unit": pick("", "", "", "PARTIAL", "ASSIGNED", "partial"),
    }
    full = lambda: row() | {"tgl_ro": "1/2/2024", "tgl_muat": pick("3/2/2024", "4/3/2024"), "pickup": "GUDANG A", "tujuan": "KOTA 1", "type_truck": "CDD"}
    for k in range(n):
        make = full if k % 2 else row
        stored, incoming = ([make() for _ in range(r.randint(1, m))] for m in (6, 5))
        stored = [x | {"status_unit": x["status_unit"].upper()} for x in stored]
        incoming = [x | {"status_unit": ""} for x in incoming] + [{c: "" for c in (*FIELDS, "status_unit")}]
        r.shuffle(incoming)
        chat = {"text": "request", "plate": "", "phone": "", "declared": 0, "marked": [], "segments": []}
        if k % 4 >= 2:
            lines = ["revisi nopol : B 1 X" if k % 3 == 0 else "update"] + (["revisi no hp : 08220000"] if k % 5 == 0 else [])
            chat |= {"plate": "B1X" if k % 3 == 0 else "", "phone": "08220000" if k % 5 == 0 else ""}
            if k % 7 < 3:
                chat["declared"] = r.randint(1, 4)
                lines.insert(0, f"{chat['declared']} UNIT CDD")
            if k % 3 != 0 and k % 5 != 0 and k % 2:  # loading segments, some of them marked
                for i in range(r.randint(2, 4)):
                    s = {"driver": pick("ani", "budi"), "no_plat": pick("B 1 X", "B 2 Y"), "kontak_driver": pick("0811", "08220000")}
                    lines += ["Lokasi : GUDANG A"] * r.randint(0, 1) + ["Waktu loading : 08:00", f"Driver : {s['driver']}", f"Nopol : {s['no_plat']}", f"No hp : {s['kontak_driver']}"]
                    if r.random() < 0.6:
                        lines.append("revisi")
                        chat["marked"] = [*chat["marked"], i]
                    chat["segments"] = [*chat["segments"], {"driver": s["driver"].upper(), "no_plat": s["no_plat"].replace(" ", ""), "kontak_driver": s["kontak_driver"]}]
            chat["text"] = "\n".join(lines)
        yield f"s{k}", stored, incoming, chat


def test_merge_against_plain_model(spark):
    cases = list(merge_cases(400, 11))
    schema = "scope string, seq long, " + ", ".join(f"{c} string" for c in FIELDS) + ", status_unit string"
    side = lambda k: spark.createDataFrame([(c[0], 1000 * k + i, *(x[f] for f in FIELDS), x["status_unit"]) for c in cases for i, x in enumerate(c[k])], schema)
    chats = spark.createDataFrame([(c[0], c[3]["text"]) for c in cases], "scope string, chat_text string")
    got = {}
    for x in merge.smart_merge(side(1), side(2), chats).collect():
        got.setdefault(x.scope, []).append((x.origin, *(x[c] for c in FIELDS), x.status_unit))
    changed = 0
    for scope, stored, incoming, chat in cases:
        want = plain_merge(stored, incoming, chat)
        assert sorted(got[scope]) == want, (scope, chat, stored, incoming)
        changed += want != plain_merge(stored, [], chat)
    assert changed > 200


def test_save_chat(spark):
    """One chat against a large table: the same as over all rows; a replay inserts no row that it had inserted."""
    (_, stored, incoming, chat), other = list(merge_cases(8, 5))[5], {"tgl_ro": "9/9/2023", "pickup": "X", "status_unit": "PARTIAL"}
    table = order_rows(spark, [*enumerate(stored), *((100 + i, other | {"tujuan": str(i)}) for i in range(50))])
    new = order_rows(spark, enumerate(incoming, 1000)).withColumn("status_unit", F.lit(""))
    got = merge.save_chat(table, new, "chat-1", chat["text"])
    rows = sorted((x.origin, *(x[c] for c in FIELDS), x.status_unit) for x in got.collect())
    assert rows == sorted([*plain_merge(stored, incoming, chat), *(("stored", *((other | {"tujuan": str(i)}).get(c, "") for c in FIELDS), "PARTIAL") for i in range(50))])
    again = merge.save_chat(got.select("seq", *FIELDS, "status_unit", "row_hash").withColumn("raw_chat_id", F.lit("chat-1")), new, "chat-1", chat["text"])
    hashes = [r.row_hash for r in again.collect() if r.row_hash]
    assert len(hashes) == len({*hashes}) and {r.row_hash for r in got.collect()} <= {None, *hashes}


def test_loading_segments(spark):
    text_ = "REQUEST\nLokasi : A\nWaktu loading : 1\nNopol : B 1 X\nLokasi : B\nx\nLokasi : C\nWaktu loading : 2\nrevisi nopol : B 2 Y\nLokasi : D"
    df = spark.createDataFrame([(text_,), ("no segments",), (None,)], "t string")
    got = [r.s for r in df.select(parse.loading_segments(F.col("t")).alias("s")).collect()]
    assert [[x.strip() for x in s] for s in got] == [["Lokasi : A\nWaktu loading : 1\nNopol : B 1 X\nLokasi : B\nx", "Lokasi : C\nWaktu loading : 2\nrevisi nopol : B 2 Y\nLokasi : D"], [], []]
    assert df.select(parse.marked_segments(F.col("t")).alias("m")).first().m == [1]


def test_save_is_idempotent_on_hashes(spark):
    rows = order_rows(spark, [(i, {"pickup": "A", "driver": "x"}) for i in (1, 2)])
    numbered = merge.number_repeats(rows, "seq", F.lit("chat"))
    assert len({r.row_hash for r in numbered.collect()}) == 2
    once = merge.insert_absent(numbered.limit(0), numbered)
    assert once.count() == 2 and merge.insert_absent(once, numbered).count() == 2


def test_fill_slots(spark):
    rows = [(1, {"pickup": "A", "status_unit": "PARTIAL"}), (2, {"pickup": "A", "status_unit": "UNASSIGNED"}), (3, {"pickup": "A", "driver": "x", "no_plat": "B 1", "kontak_driver": "08", "status_unit": "ASSIGNED"})]
    inc = [(11, {"driver": "x", "no_plat": "B 1", "kontak_driver": "08"}), (12, {"driver": "y", "no_plat": "B 2", "kontak_driver": "09"}), (13, {"driver": "z"}), (14, {"driver": "y2", "no_plat": "B 2", "kontak_driver": "07"})]
    got = {r.seq: (r.no_plat, r.filled_from) for r in merge.fill_slots(order_rows(spark, rows).withColumn("k", F.lit("k")), order_rows(spark, inc).withColumn("k", F.lit("k")), "k").collect()}
    assert got == {1: ("B 2", 12), 2: ("", None), 3: ("B 1", None)}


def test_numbered(spark):
    from tallyloom.plans.numbering import numbered

    r = random.Random(3)
    values = [(r.choice([None, r.randint(0, 50)]), i) for i in range(500)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = sorted((x.place, x.a, x.b) for x in numbered(df, F.asc_nulls_first("a"), F.desc("b")).collect())
    assert got == [(k, *v) for k, v in enumerate(sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, -v[1])), 1)]
    assert numbered(df.where("false"), "a").count() == 0


def test_date_forms(spark):
    said = ["tgl 5 Mar 26 pagi", "05/03/2026", "MARET 2026", "31-12-24 dan 1 jan 2025", "", None, "x 99/99/2024", "2 FEBUARY 2025"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, c string")
    c = F.col("c")
    my = dates.month_year(c)
    one = df.orderBy("i").select(dates.date_forms(c).alias("x")).select("x.*").collect()
    each = df.orderBy("i").select(dates.normalize_dates(c).alias("spelled"), dates.first_date(c).alias("iso"), dates.norm_date(c).alias("ddmmyyyy"), dates.norm_key(c).alias("norm_key"), my["month"].alias("month"), my["year"].alias("year"), dates.canonical_date(c).alias("canonical")).collect()
    assert one == each and one[0].iso == "2026-03-05"


def test_top_candidates_by_context(spark):
    """Against all pairs, with ties, nulls and more than k orders of one context."""
    r = random.Random(8)
    pick = lambda: [r.choice([None, "", "1/2/2024"]), r.choice(["a", "b"]), r.choice(["x", "y", None]), r.choice(["CDD", "FUSO"])]
    inc, old = [(i, r.choice("pq"), *pick()) for i in range(30)], [(f"k{i}", i, r.choice("pq"), *pick()) for i in range(60)]
    names = ("tgl_ro", "pickup", "tujuan", "type_truck")
    a = spark.createDataFrame(inc, "incoming_id int, block string, " + ", ".join(f"in_{c} string" for c in names))
    b = spark.createDataFrame(old, "candidate_key string, first_seq long, block string, " + ", ".join(f"ca_{c} string" for c in names))
    got = sorted((x.incoming_id, x["rank"], x.candidate_key, x.context_score) for x in matching.top_candidates(a, b, "block", 3).collect())
    w = {"tgl_ro": 2, "pickup": 3, "tujuan": 3, "type_truck": 2}
    score = lambda x, y: sum(v * (1 if p == q else -1) for (c, v), p, q in zip(w.items(), x, y) if p and q)
    want = []
    for i, block, *x in inc:
        best = sorted((-score(x, y), n, k) for k, n, z, *y in old if z == block)[:3]
        want += [(i, j, k, -s) for j, (s, n, k) in enumerate(best, 1)]
    assert got == sorted(want)


def test_update_where_given(spark):
    t = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "id string, ms double, run string")
    u = spark.createDataFrame([("a", 0.0, "new"), ("b", 5.0, "-")], "id string, ms double, run string")
    assert sorted(tuple(r) for r in merge.update_where_given(t, u, "id", ("ms",), ("run",)).collect()) == [("a", 1.0, "new"), ("b", 5.0, "y")]


def test_units_are_matched_greedily(spark):
    def rows(units):
        return spark.createDataFrame([("s", i, *u) for i, u in units], "k string, seq long, driver string, no_plat string, kontak_driver string")

    old = rows([(1, ("a", "B 1", "01")), (2, ("a", "B 2", "02")), (3, ("c", "", "03"))])
    new = rows([(11, ("a", "X", "09")), (12, ("a", "B 2", "02")), (13, ("a", "B 1", "05"))])
    assert sorted((r.existing_seq, r.incoming_seq, r.score) for r in matching.match_units(old, new, "k").collect()) == [(1, 13, 6), (2, 12, 9)]


def test_every_line_is_matched(spark):
    """Plainly: the unit of every line of every order is found by its plate, also those of lines 4 to 7."""
    li = {(r.l_orderkey, r.l_linenumber) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").collect()}
    got = sorted((r.existing_seq, r.incoming_seq, r.score) for r in entry.queries()["registered_unit_match"](spark, SF).collect())
    assert max(n for _, n in li) == 7 and got == sorted((10 * k + n, 10 * k + n + 5, 4 if n == 2 else 9) for k, n in li)


def test_preview_and_proof(spark):
    df = spark.createDataFrame([(1, "TIDAK_COCOK", False, 0.1), (2, "SIAP_ISI_SLOT", False, 0.9), (3, "CONFLICT", True, 0.5)], "seq int, decision_status string, date_conflict boolean, p_match double")
    assert [r.seq for r in matching.preview_order(df).collect()] == [3, 2, 1]
    p = spark.createDataFrame([("A ", "a", "x", "-")], "c1 string, i1 string, c2 string, i2 string")
    assert [r.status for r in matching.proof_rows(p, {"one": ("c1", "i1"), "two": ("c2", "i2")}, text.norm_text).collect()] == ["Cocok", "-"]


def test_revision_lines(spark):
    t = "halo\nrevisi nopol lama B 12 XY\nganti no hp +62 811-222-333\nubah plat D 9 Z"
    a = ask(spark, fields.old_anchors, t, "nopol B 1 X")
    assert (a[0].no_plat, a[0].kontak_driver, a[1].no_plat) == ("D9Z", "0811222333", None)
    assert ask(spark, fields.has_revision_marker, t, "ada update driver", "update saja kah", "nopol") == [True, True, True, False]
    rows = spark.createDataFrame([(("ani", "B1", ""), [("ani", "", ""), ("x", "B1", "")]), (("ani", "B1", ""), [("ani", "B1", ""), ("x", "B1", "")]), (("", "", ""), [("", "", "")])], "r struct<driver:string,no_plat:string,kontak_driver:string>, s array<struct<driver:string,no_plat:string,kontak_driver:string>>")
    assert [r.v for r in rows.select(matching.segment_of(F.col("r"), F.col("s")).alias("v")).collect()] == [None, 0, None]


def test_truth_and_texts(spark):
    truth = spark.createDataFrame([("Order A", "order b", "match"), ("x" * 60, "y" * 60, "NO_MATCH")], "text_a string, text_b string, label string")
    pairs = spark.createDataFrame([("ORDERb", "order a"), ("x" * 59 + "z", "y" * 60), ("q", "r"), ("", None)], "text_a string, text_b string")
    assert {r.text_a: r.truth for r in matching.truth_labels(pairs, truth).collect()} == {"ORDERb": "MATCH", "x" * 59 + "z": "NO_MATCH", "q": "", "": ""}
    e = spark.createDataFrame([("k", 1, "a"), ("k", 2, ""), ("k", 3, "a"), ("k", 4, "b")], "key string, seq int, t string")
    assert matching.join_texts(e, "key", "seq", "t").first().texts == "Order Susulan #1\na\n\nOrder Susulan #4\nb"


def test_datasets(spark):
    rows = spark.createDataFrame([(["O", "B-A"],), (["I-A"],)], "ner_tags array<string>")
    assert [(r.tag, r.id) for r in datasets.label_vocabulary(rows).orderBy("id").collect()] == [("O", 0), ("B-A", 1), ("I-A", 2)]
    n = spark.createDataFrame([(i, f"r{i % 3}", f"s{i}") for i in range(30)], "record_id int, route string, sig string")
    neg = datasets.hard_negatives(n, "route", "sig").collect()
    assert len(neg) == 30 and all(r.negative_id != r.record_id and r.negative_id % 3 == r.record_id % 3 for r in neg)
    templates = spark.createDataFrame([(1, "08:00 1/2/2024 B 1234 XY 081234567890")], "template_id int, text string")
    a, b = (datasets.augmented(templates, 20).orderBy("pair_id").collect() for _ in range(2))
    assert a == b and len({r.text for r in a}) == 20 and not any("1234 XY" in r.text for r in a)
    assert datasets.sample(n, 5, 1, "record_id").collect() == datasets.sample(n.repartition(7), 5, 1, "record_id").collect()


def plain_augmented(spark, templates, n):
    """(pair_id, template_id, text) of n rows, from the hashes alone."""
    h = lambda *x: F.xxhash64(*x)
    ids = [F.col("id")]
    cols = [h(*ids, F.lit(k)).alias(f"h{k}") for k in range(1, 9)] + [h(F.concat("id", F.lit(c))).alias(c) for c in "pq"]
    hashes = spark.range(n).select("id", *cols).collect()
    of = {r.t: r.h for r in spark.createDataFrame([(t,) for t, _ in templates], "t long").select("t", h("t").alias("h")).collect()}
    known, out = sorted(templates, key=lambda t: (of[t[0]] % datasets.BUCKETS, t)), []
    for r in hashes:
        t, s = known[r.h1 % len(known)]
        plate = f"{'BDFL'[r.p % 4]} {r.h7 % 9000 + 1000} {('AB', 'KQ', 'UXS', 'TEY')[r.q % 4]}"
        for pattern, new in (
            (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", f"{r.h2 % 28 + 1:02}/{r.h3 % 12 + 1:02}/{r.h4 % 3 + 2024:04}"), (r"\b\d{1,2}[:.]\d{2}\b", f"{r.h5 % 24:02}:{r.h6 % 60:02}"),
            (r"\b[A-Z]{1,2}\s?\d{3,4}\s?[A-Z]{1,3}\b", plate), (r"\b08\d{8,11}\b", "08" + str(r.h8 % 10**10).rjust(10, "1")),
        ):
            s = re.sub(pattern, new, s)
        out.append((f"aug_spc_{r.id + 1:05}", t, s))
    return out


def test_augmented(spark):
    templates = [(k, f"no {k}: 08:00 1/2/2024 B 1234 XY 081234567890") for k in range(3000)]
    df = spark.createDataFrame(templates, "template_id long, text string")
    got = datasets.augmented(df.repartition(5), 700)
    assert sorted(map(tuple, got.collect())) == plain_augmented(spark, templates, 700)
    assert datasets.augmented(df.where("false"), 5).count() == 0
    parts = [(r.p_partkey, f"REQUEST 1/2/2024 08:00 B 1234 XY 081234567890 {r.p_name}") for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    rows = entry.queries()["augmented_templates"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(plain_augmented(spark, parts, 25 * len(parts)))
    assert max(r.template_id for r in rows) > 20


def test_random_negatives(spark):
    """Plainly: in the order of a hash every record meets the next signature, in one ring."""
    from tallyloom import queries

    records = queries._records(spark, SF)
    sig = F.col("signature")
    rows = records.select("record_id", "signature", F.xxhash64(sig, F.lit(7)).alias("h"), datasets.candidate_text().alias("t")).collect()
    assert len({r.signature for r in rows}) == len(rows)
    ring = sorted(rows, key=lambda r: (r.h, r.signature))
    want = [(a.record_id, b.t) for a, b in zip(ring, ring[1:] + ring[:1])]
    got = datasets.pair_dataset(records).where("pair_kind = 'random'").collect()
    assert sorted((r.source_id, r.text_b) for r in got) == sorted(want) and {r.label for r in got} == {"NO_MATCH"}
    counts = {r.pair_kind: r.n for r in entry.queries()["pair_dataset"](spark, SF).collect()}
    assert counts["random"] == len(want) > 0


def test_rings_of_repeated_signatures(spark):
    """Groups of a few and of many signatures, which records share; each record meets the least record of the next signature, none alone."""
    r = random.Random(8)
    rows = [(i, r.choice("aaabc"), f"s{r.randrange(120)}") for i in range(400)] + [(900, "alone", "s1"), (901, "alone", "s1")]
    df = spark.createDataFrame(rows, "record_id long, route string, sig string")
    h = dict(df.select("sig", F.xxhash64("sig")).distinct().collect())
    want = []
    for route in "abc":
        least = {s: min(i for i, x, y in rows if (x, y) == (route, s)) for s in {y for _, x, y in rows if x == route}}
        ring = sorted(least, key=lambda s: (h[s], s))
        following = dict(zip(ring, ring[1:] + ring[:1]))
        want += [(i, least[following[s]]) for i, x, s in rows if x == route]
    got = datasets.hard_negatives(df, "route", "sig").select("record_id", "negative_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert datasets.random_negatives(df, "sig").count() == len(rows)
    assert datasets.random_negatives(df.where("route = 'alone'"), "sig").count() == 0 == datasets.random_negatives(df.where("false"), "sig").count()


def test_blocks_helpers(spark):
    rows = spark.createDataFrame([(1, 1, "2 unit", None), (1, 2, "", "X"), (1, 3, "", None)], "b int, seq int, unit_qty string, origin string")
    assert [r.origin for r in blocks.repair_headers(rows, "b", "seq", ("origin",)).orderBy("seq").collect()] == ["X", "X", None]
    carried = parse.carry_pickups(spark.createDataFrame([(1, 1, "GUDANG", "a", "", ""), (1, 2, "qu", "", "", ""), (1, 3, "qu", "b", "", "")], "chat int, seq int, pickup string, driver string, no_plat string, kontak_driver string"), "chat", "seq")
    assert [r.pickup for r in carried.orderBy("seq").collect()] == ["GUDANG", "GUDANG", "qu"]


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "e boolean, p boolean")
    m = evaluate.binary_metrics(none, F.col("e"), F.col("p")).first()
    assert (m.tp, m.accuracy, m.f1, m.macro_f1) == (0, 0.0, 0.0, 0.0)


def test_report_cells(spark):
    two = "driver 1: ani wati nopol B 1\ndriver 2: budi\nno hp 081234567 dan no hp 628987654321"
    assert ask(spark, lambda c: report.driver_pair(c)["first"], two, "x") == ["Ani Wati", ""]
    assert ask(spark, report.driver_name, "m.rizki o'neil-budi", "sopir jne", None) == ["M.Rizki O'Neil-Budi", "", ""]
    assert ask(spark, lambda c: report.with_driver_pair(c, F.lit(two)), "", "budi", "cici") == ["Ani Wati & Budi", "Ani Wati & Budi", "cici"]
    assert ask(spark, lambda c: report.with_phone_pair(c, F.lit(two)), "", "081234567", "0800") == ["081234567 & 08987654321", "081234567 & 08987654321", "0800"]
    got = ask(spark, report.format_chat, "a\nWaktu loading : 08:00 1/2/2024\nb", "[08.00, 1/2/2024] A: contoh chat x[09.00, 1/2/2024] B: ya")
    assert got == ["a\n\nREQUEST ORDER KHUSUS 1/2/2024\nWaktu loading : 08:00\nb", "[09.00, 1/2/2024] B: ya"]


def test_office_report(spark):
    cols = "batch int, seq int, unit_qty string, unit_type string, origin string, destination string, driver string, plate string, phone string, time string, date string, text string"
    rows = [
        (1, 1, "3 unit", "cdd", "bekasi", None, "", "", "", "", "5 mei", "x"),
        (1, 2, "", None, None, "jakarta-bogor", "ani", "b 1 x", "62811111", "8", "", "x"),
        (1, 3, "", None, None, None, "budi", "b 2 y", "0822222222", "09.00", "10.00", "x"),
        (1, 4, "", None, None, None, "cici", "", "", "09:00", "", "revisi driver"),
    ]
    got = report.office_report(spark.createDataFrame(rows, cols), "batch", "seq", 2026, "%03d/A").orderBy("no").collect()
    assert [(r.job_number, r.driver, r.no_plat, r.jam_loading) for r in got] == [("042/A", "Ani", "B 1 X", "08:00"), ("043/A", "Cici", "B 2 Y", "09:00"), ("044/A", "", "", "")]
    assert {r.pickup for r in got} == {"BEKASI"} and {r.tgl_muat for r in got} == {"05 MEI 2026"} and {r.status_unit for r in got} == {"PARTIAL"}


def test_evidence(spark):
    df = spark.createDataFrame([("UNIT_QTY", ["3 unit"], ["3"], 0.5), ("PLATE", ["A", "b"], ["B"], 0.5), ("PLATE", ["A"], ["B"], 0.5), ("RO_DATE", ["2024"], ["2024"], 0.5), ("PLATE", [], ["B"], 0.5)], "a string, x array<string>, y array<string>, c double")
    got = [r.v for r in df.select(evidence.contextual_confidence(F.col("a"), F.col("x"), F.col("y"), F.col("c")).alias("v")).collect()]
    assert got == [0.95, 0.95, 0.5, 0.5, 0.5]
    one = spark.range(1)
    slot = lambda e, n: one.select(evidence.slot_evidence(F.lit(e), F.lit(n)).alias("v")).first().v
    assert [slot(1, 0), slot(0, 1), slot(1, 2), slot(2, 2)] == ["BELUM ADA UNIT", "PENUH", "MELEBIHI", "CUKUP"]
    m = spark.createDataFrame([("a", "b", "x", "X ")], "old_driver string, new_driver string, old_plate string, new_plate string")
    assert [(r.field, r.old, r.new) for r in evidence.unit_changes(m, ("driver", "plate"), text.norm_text).collect()] == [("driver", "a", "b")]


def test_annotator(spark):
    t = "REQUEST UNIT ON CALL 5 Mei 2024\n3 unit CDD\nLokasi : GUDANG\nWaktu loading : 08:00 6/5/2024\ndriver : ani\nNo hp : 0811-2222-333"
    a = annotate.annotate(spark.createDataFrame([(1, t), (2, None)], "id int, text string"))
    spans = {r.id: r.spans for r in a.collect()}
    assert all(t[s.start : s.stop] == s.value for s in spans[1]) and spans[2] == []
    assert {s.label: s.value for s in spans[1]} == {"RO_DATE": "5 Mei 2024", "UNIT_QTY": "3", "UNIT_TYPE": "CDD", "ORIGIN": "GUDANG", "TIME": "08:00", "LOAD_DATE": "6/5/2024", "DRIVER": "ani", "PHONE": "0811-2222-333"}
    assert a.where("id = 1").select(annotate.loading_values(F.col("spans")).alias("v")).first().v == ["08:00 6/5/2024"]
    assert ask(spark, annotate.intent, "batal", "revisi unit", "fyi", "request 3 unit") == ["CANCEL", "UPDATE", "INFO", "NEW_ORDER"]


def test_sources(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("﻿REQUEST a\nb", encoding="utf-8")
    assert io.read_chats(spark, str(tmp_path / "chat.txt")).first().chat_text == "REQUEST a\nb"
    (tmp_path / "p.json").write_text('[{"pair_id": "1", "text_a": "x", "label": "MATCH"}]')
    assert io.read_json_rows(spark, str(tmp_path / "p.json"), io.PAIRS).first().label == "MATCH"
    (tmp_path / "bad.json").write_text("no json")
    assert io.read_json_state(spark, str(tmp_path / "bad.json"), "a int").first().state in (None, (None,))
    (tmp_path / "checkpoint-7").mkdir()
    (tmp_path / "checkpoint-7" / "trainer_state.json").write_text('{"global_step": 7, "log_history": [{"loss": 0.5}, {"eval_f1": 0.9}]}')
    train, evaluation = io.training_logs(spark, str(tmp_path / "checkpoint-*" / "trainer_state.json"))
    assert train.count() == 1 and evaluation.count() == 1
    rows = order_rows(spark, [(1, {"pickup": "a"})]).withColumn("job_number", F.lit("J"))
    shown = io.to_display(rows, "seq")
    assert shown.columns[:3] == ["No.", "Tgl RO", "Tgl Muat"] and io.to_stored(shown).first().pickup == "a"
    assert io.upper_cells(rows).first().pickup == "A" and "| pickup |" in io.markdown(rows.select("pickup"))
    assert len(io.export_bundle({"id": 1}, rows, rows, rows)) > 100
    io.write_csv(rows.select("pickup", "driver"), str(tmp_path / "c"))
    assert io.read_csv_orders(spark, str(tmp_path / "c"), ["pickup", "driver"]).first().pickup == "a"


def test_workspace(spark):
    import uuid

    w = workspace.Workspace(spark, f"default.sessions_test_{uuid.uuid4().hex}")
    a = w.create("  My   session ")
    b = w.create()
    assert {r.name for r in w.sessions().collect()} == {"My session", "Session 2"}
    w.archive(b)
    assert w.sessions().count() == 1
    with pytest.raises(ValueError):
        w.activate(b)
    w.restore(b)
    w.auto_name(a, "auto")
    w.auto_name(b, "auto")
    w.activate(a)
    assert spark.table("raw_chats").count() == 0
    w.refresh_counts(a)
    assert {r.name for r in w.sessions().collect()} == {"My session", "auto"} and w.reset(a) == dict.fromkeys(workspace.TABLES, 0)
    spark.catalog.setCurrentDatabase("default")
    w.delete(a), w.delete(b)
    assert w.sessions(True).count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, t in enumerate(("REQUEST a", "REQUEST b\n1 unit X\n2 unit Y", "REQUEST a ")):
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    q = stream.blocks(stream.gate(stream.read_chat_stream(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.chunk for r in spark.table("chunks").collect()) in (["REQUEST a", "REQUEST b\n1 unit X", "REQUEST b\n2 unit Y"],)
    units = spark.createDataFrame([("k", 2, "A"), ("k", 0, "B"), ("k", 0, "B"), ("k", 0, "C")], "candidate_key string, qty long, no_plat string")
    units.write.parquet(str(tmp_path / "u"))
    live = stream.evolving_slots(spark.readStream.schema(units.schema).parquet(str(tmp_path / "u")))
    q = live.writeStream.format("memory").queryName("slots").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("slots").orderBy(F.desc("overflow")).first()
    assert (last.target, last.filled, last.overflow) == (2, 2, 1)


SQL = {n: s for n, s in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canonical(rows):
    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = canonical(tuple(r[c] for c in names) for r in df.collect())
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    want = canonical(tuple(r[columns.index(c)] for c in names) for r in cur.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", ["augmented_templates", "pair_scores", "office_report"])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20

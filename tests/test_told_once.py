"""Units told once and slots that they fill, against a plain model on random orders with repeated fields."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import distinct, merge
from tallyloom.plans import generate, matching, sync

FIELDS = ("tgl_ro", "tgl_muat", "pickup", "tujuan", "no_plat", "type_truck", "driver", "kontak_driver")
SCHEMA = "k string, seq long, status_unit string, note int, " + ", ".join(f"{c} string" for c in FIELDS)
UNIT = ("driver", "no_plat", "kontak_driver")


def norm(v):
    return re.sub("[^A-Z0-9]", "", (v or "").upper())


def is_filled(v):
    return (v or "").strip().lower() not in ("", "-", "null", "none", "nan", "undefined")


def same(a, b):
    equal = [norm(a[c]) == norm(b[c]) != "" for c in UNIT]
    return equal[1] or sum(equal) >= 2


def complete(r):
    return all(is_filled(r[c]) for c in UNIT)


def made(r, key, first, n):
    out = []
    for i in range(n):
        unit = {"driver": r.choice(["ani", "Budi", "ci", "-", ""]), "no_plat": r.choice(["B 1", "b-1", "B 2", "B 3", "", None]), "kontak_driver": r.choice(["081", "082", "083", "084", ""])}
        if r.random() < 0.3:
            unit = dict.fromkeys(UNIT, "")
        rest = {c: r.choice(["", "x", "y"]) for c in FIELDS if c not in UNIT}
        out.append({"k": key, "seq": first + i, "status_unit": r.choice(["PARTIAL", "UNASSIGNED", "ASSIGNED", "partial", "", None, "?"]), "note": i, **unit, **rest})
    return out


def status(row):
    n = sum(is_filled(row[c]) for c in FIELDS)
    return "ASSIGNED" if n == len(FIELDS) else "PARTIAL" if n >= 3 else "UNASSIGNED"


def plain_fill(stored, incoming):
    """The rule told in Python: outcomes by incoming seq, and the table afterwards."""
    table, out = {r["seq"]: dict(r) for r in stored}, {}
    known = [dict(r) for r in stored]
    said = lambda r: s if (s := (r["status_unit"] or "").strip().upper()) in ("ASSIGNED", "PARTIAL", "UNASSIGNED") else status(r)
    targets = [r["seq"] for r in stored if said(r) in ("PARTIAL", "UNASSIGNED")]
    for x in incoming:
        if not complete(x):
            out[x["seq"]] = "incomplete", None
        elif any(same(u, x) for u in known):
            out[x["seq"]] = "duplicate", None
        elif targets and (gives := [c for c in FIELDS if is_filled(x[c]) and not is_filled(table[targets[0]][c])]):
            row = table[targets[0]]
            row.update({c: x[c] for c in gives})
            row["status_unit"] = status(row)
            known.append(x)
            out[x["seq"]] = "filled", targets.pop(0)
        else:
            out[x["seq"]] = "skipped", None
    return out, table


@pytest.fixture(scope="module")
def orders():
    r = random.Random(12)
    return {f"o{i}": (made(r, f"o{i}", 0, r.randint(0, 5)), made(r, f"o{i}", 100, r.randint(0, 8))) for i in range(300)}


def frame(spark, rows):
    return spark.createDataFrame([tuple(x[n.split()[0]] for n in SCHEMA.split(", ")) for x in rows], SCHEMA).repartition(5)


def test_fill_equals_a_plain_model(spark, orders):
    stored, incoming = (frame(spark, [x for pair in orders.values() for x in pair[i]]) for i in (0, 1))
    got = {(r.k, r.filled_from): (r.outcome, r.slot) for r in distinct.fill_outcomes(stored, incoming, "k").collect()}
    want, after = {}, {}
    for k, (old, new) in orders.items():
        out, table = plain_fill(old, new)
        want |= {(k, s): o for s, o in out.items()}
        after |= {(k, s): row for s, row in table.items()}
    assert got == want and {o for o, _ in want.values()} == {"filled", "duplicate", "skipped", "incomplete"}
    rows = merge.fill_slots(stored, incoming, "k").collect()
    assert len(rows) == len(after)
    by_slot = {(k, slot): s for (k, s), (_, slot) in want.items() if slot is not None}
    for r in rows:
        assert r.filled_from == by_slot.get((r.k, r.seq)) and all((r[c] or "") == (after[r.k, r.seq][c] or "") for c in FIELDS)
        if r.filled_from is not None:
            assert r.status_unit == after[r.k, r.seq]["status_unit"]


def test_fill_counts(spark, orders):
    stored, incoming = (frame(spark, [x for pair in orders.values() for x in pair[i]]) for i in (0, 1))
    got = {r.k: (r.filled, r.duplicates, r.skipped) for r in distinct.fill_counts(stored, incoming, "k").collect()}
    for k, (old, new) in orders.items():
        whole = [x for x in new if complete(x)]
        outcomes = [o for o, _ in plain_fill(old, new)[0].values()]
        if new:
            want = (0, 0, len(new)) if not whole else (0, 0, len(whole)) if not old else tuple(outcomes.count(o) for o in ("filled", "duplicate", "skipped"))
            assert got[k] == want


def test_first_told_equals_a_plain_model(spark, orders):
    known, rows = (frame(spark, [x for pair in orders.values() for x in pair[i]]) for i in (0, 1))
    got = {(r.k, r.seq) for r in distinct.first_told(known, rows, ["k"], ["seq"]).collect()}
    want = set()
    for k, (old, new) in orders.items():
        taken = list(old)
        for x in new:
            if complete(x) and not any(same(u, x) for u in taken):
                taken.append(x)
                want.add((k, x["seq"]))
    assert got == want
    assert distinct.first_told(known, rows, ["k"], ["seq"]).columns == rows.columns
    assert distinct.first_told(known.where("false"), rows.where("false"), ["k"], ["seq"]).count() == 0


def test_repeated_units_as_the_rules_give_them(spark):
    """Cases of units that repeat each other by phone and driver, not by plate."""
    row = lambda seq, plate, driver, phone, s="UNASSIGNED": {"k": "o", "seq": seq, "status_unit": s, "note": 0, **dict.fromkeys(FIELDS, ""), "no_plat": plate, "driver": driver, "kontak_driver": phone}
    open_ = frame(spark, [row(i, "", "", "") for i in (1, 2)])
    twice = frame(spark, [row(11, "B 1 X", "ani", "0811"), row(12, "B 2 Y", "ani", "0811")])
    assert {r.seq: r.no_plat for r in merge.fill_slots(open_, twice, "k").collect()} == {1: "B 1 X", 2: ""}
    shown = sync.after_snapshot(open_, frame(spark, [row(11, "B 1 X", "ani", "0811"), row(12, "B 1 X", "budi", "0812")]), "k")
    assert sorted(r.filled_from for r in shown.collect()) == [11, 12]
    stored, told = frame(spark, [row(1, "B 1 X", "ani", "0811")]), frame(spark, [row(11, "B 1 X", "ani", "0811"), row(12, "B 1 X", "ani", "0811"), row(13, "B 9 Z", "ci", "09")])
    assert sorted(r.seq for r in sync.unmatched_units(told, stored, "k").collect()) == [12, 13]
    partial = frame(spark, [row(1, "B 1 X", "", "")]).select("*", F.lit("o").alias("candidate_key"))
    pairs = spark.createDataFrame([("i", "o")], "incoming_id string, candidate_key string")
    counts = matching.unit_counts(pairs, told.select("*", F.lit("i").alias("incoming_id"), F.col("seq").alias("unit_no")), partial).first()
    assert (counts.complete, counts.duplicates, counts.new) == (3, 2, 1)


def test_state_text_takes_units_line_by_line(spark):
    text = "REQUEST ON CALL 5 MEI 2026\n2 UNIT CDD\nWaktu : 08:00\nNama : ANI\nNopol : B 1 X\nWaktu : 09:00\nDriver : BUDI\nNopol : B 2 Y\nNo hp : 0822"
    got = spark.createDataFrame([(text,)], "t string").select(generate.state_of(F.col("t"))).first()[0]
    assert "complete=1; empty=1" in got and got.endswith("existing_driver=09:00 BUDI B 2 Y 0822")


def test_orders_stay_whole_where_the_sides_are_dealt_already(spark):
    """Both sides of the union are dealt by the order's key before, and differ in size, so that small partitions are merged differently."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        k = F.col("id") % 20_000
        said = spark.range(60_000).select(k.alias("k"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("no_plat"))
        said = said.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("seq")))
        rows = said.select("k", "seq", "nth", *(F.lit("x").alias(c) for c in FIELDS if c != "no_plat"), "no_plat", F.lit("PARTIAL").alias("status_unit"))
        stored, new = rows.where("nth = 1").withColumns({"driver": F.lit(""), "no_plat": F.lit("")}), rows.where("nth > 1").withColumn("driver", F.col("no_plat"))
        known = stored.groupBy("k").agg(F.max("seq").alias("seq"), *(F.max(c).alias(c) for c in (*FIELDS, "status_unit")))
        done = distinct.fill_outcomes(known, new, "k").groupBy("outcome").count().collect()
        assert {r["outcome"]: r["count"] for r in done} == {"filled": 20_000, "skipped": 20_000}
        same_plate = rows.withColumn("no_plat", F.lit("B 1"))
        assert distinct.first_told(same_plate.where("nth = 1").groupBy("k").agg(*(F.max(c).alias(c) for c in UNIT)), same_plate.where("nth > 1"), ["k"], ["seq"]).count() == 0
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_known_units_by_two_joins(spark):
    """Units of many orders against a plain model; the stored side, often dear to make, is read for two anti-joins and no more."""
    r = random.Random(14)
    old = [x for i in range(30) for x in made(r, f"o{i}", 0, r.randint(0, 4))]
    new = [x for i in range(30) for x in made(r, f"o{i}", 100, r.randint(1, 6))]
    df = lambda rows: spark.createDataFrame([tuple(x[c.split()[0]] for c in SCHEMA.split(", ")) for x in rows], SCHEMA)
    found = matching.duplicates_anti(df(new), df(old), ["k"])
    want = sorted((x["k"], x["seq"]) for x in new if not any(x["k"] == y["k"] and same(x, y) for y in old))
    assert sorted((x.k, x.seq) for x in found.collect()) == want and 0 < len(want) < len(new)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti") == 2

"""Ranked candidates against scoring all pairs, with blanks, ties and messages that name no place."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import sync
from tallyloom.plans.ranking import WEIGHTS, context_index, ranked_candidates

CONTEXT = ("tgl_ro", "pickup", "tujuan", "type_truck")
SCHEMA = ", ".join(f"{c} string" for c in CONTEXT)


def made(r):
    return tuple(r.choice([None, "", "-", f"A{r.randrange(n)}", f"a {r.randrange(n)}", "!!"]) for n in (3, 2, 4, 2))


def score(a, b):
    blank = lambda v: (v or "") in ("", "-")
    key = lambda v: v.lower().replace(" ", "").replace("!", "")
    return sum(0 if blank(x) or blank(y) else w if key(x) == key(y) else -w for x, y, w in zip(a, b, (WEIGHTS[c] for c in CONTEXT)))


@pytest.mark.parametrize("seed,messages,orders,k", [(1, 60, 300, 8), (2, 30, 5, 8), (3, 40, 200, 1), (4, 25, 0, 8)])
def test_all_pairs(spark, seed, messages, orders, k):
    r = random.Random(seed)
    asked, old = [(i, *made(r)) for i in range(messages)], [(f"k{i}", r.randrange(50), *made(r)) for i in range(orders)]
    got = {(x.m, x["rank"]): (x.candidate_key, x.context_score) for x in ranked_candidates(spark.createDataFrame(asked, f"m int, {SCHEMA}"), spark.createDataFrame(old, f"candidate_key string, first_seq long, {SCHEMA}"), "m", k).collect()}
    want = {}
    for m, *fields in asked:
        best = sorted((-score(fields, o[2:]), o[1], o[0]) for o in old)[:k]
        want |= {(m, i): (key, -s) for i, (s, _, key) in enumerate(best, 1)}
    assert got == want


def test_plan_meets_no_order_by_place_alone(spark):
    asked = spark.createDataFrame([(1, "1 MEI 2026", "GUDANG", "", "CDD")], f"m int, {SCHEMA}")
    old = spark.createDataFrame([("k", 1, "1 MEI 2026", "GUDANG", "X", "CDD")], f"candidate_key string, first_seq long, {SCHEMA}")
    text = ranked_candidates(asked, old, "m")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and not any("Cross" in j for j in joins) and all("_k[1]" not in j for j in joins)
    assert context_index(old).count() == 16


def test_plans_without_a_place(spark):
    """A message that names no place meets the order that its other fields tell; only the best eight are scored."""
    row = "seq long, tgl_ro string, tgl_muat string, pickup string, tujuan string, no_plat string, type_truck string, driver string, kontak_driver string"
    orders = spark.createDataFrame([(i, "5 MEI 2026", "", f"GUDANG {i}", f"KOTA {i}", "", "CDD", "", "", "UNASSIGNED") for i in range(20)], row + ", status_unit string")
    message = spark.createDataFrame([("m", 100, 1, "REQUEST KOTA 13 CDD", "5 MEI 2026", "", "", "KOTA 13", "B 1 X", "CDD", "ani", "08")], "incoming_id string, seq long, unit_no long, text string, " + row.split(", ", 1)[1])
    got = sync.plans(orders, message).orderBy("rank").collect()
    assert len(got) == 8 and got[0].tujuan == "KOTA 13" and [r.context_score for r in got] == [7, *[1] * 7]
    assert [r.first_seq for r in got[1:]] == [0, 1, 2, 3, 4, 5, 6]


def test_lists_get_few_of_a_context(spark):
    """Of orders that share a context the k earliest go into the lists, however many there are; the limit stands below the explosion."""
    index = context_index(spark.range(500).select(F.col("id").cast("string").alias("candidate_key"), (500 - F.col("id")).alias("first_seq"), *(F.lit(v).alias(c) for c, v in zip(("tgl_ro", "pickup", "tujuan", "type_truck"), ("1/2/2024", "A", "B", "")))), 3)
    rows = index.collect()
    assert len(rows) == 8 and all(sorted(x.candidates) == [(1, "499"), (2, "498"), (3, "497")] for x in rows)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("Generate") :]

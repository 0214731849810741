"""Ranks with ties against a plain sort, with groups and runs of equal pairs that span tasks."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm.ranking import Cuts, Key, coded, rank_sale_lines, rank_ties

PAIR, ORDER = [Key("b", descending=True), Key("c")], [Key("d", nulls_last=True)]


def plain(rows, top):
    up = lambda x: (x is not None, x or 0)
    pair = lambda r: ((r[1] is not None, -(r[1] or 0)), up(r[2]))
    out = []
    for a in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == a), key=lambda r: (pair(r), (r[3] is None, r[3] or 0)))
        for pos, r in enumerate(group, 1):
            place = 1 + sum(pair(x) < pair(r) for x in group)
            if place <= top:
                out.append((*r, pos, place, sum(pair(x) == pair(r) for x in group)))
    return sorted(out, key=str)


def made(r, n, groups):
    some = lambda k: r.choice([None, *range(-k, k)])
    return [(r.choice(groups), some(2), some(2), some(3)) for _ in range(n)]


@pytest.mark.parametrize("seed,n,groups", [(1, 400, [1, 1, 1, 1, 2, None]), (2, 300, [1]), (3, 200, list(range(60))), (4, 7, [1, 2]), (5, 1, [None])])
def test_ranks_match_a_plain_sort(spark, seed, n, groups):
    rows = made(random.Random(seed), n, groups)
    df = spark.createDataFrame([(*x, "x", 9, 8) for x in rows], "a long, b int, c long, d long, task string, pos long, kind int").repartition(3)
    got = sorted((tuple(r) for r in rank_ties(df, ["a"], PAIR, ORDER, 3).collect()), key=str)
    assert got == plain(rows, 3)


def test_one_repeated_row_spreads_over_tasks(spark):
    rows = [(1, 1, 1, 1)] * 500 + [(1, 0, 0, 0)] * 3
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    assert sorted((tuple(r) for r in rank_ties(df, ["a"], PAIR, ORDER, 3).collect()), key=str) == plain(rows, 3)
    columns = [pa.array([x[i] for x in rows], pa.int64()) for i in range(4)]
    keys = [Key("a"), *PAIR, *ORDER]
    codes = coded(columns, keys)
    assert np.bincount(Cuts(codes, 8).tasks(codes), minlength=8).max() < 80


def test_batches_end_within_runs(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = made(random.Random(8), 300, [1, 1, 1, 2, 3])
        df = spark.createDataFrame(rows, "a long, b long, c long, d long")
        assert sorted((tuple(r) for r in rank_ties(df, ["a"], PAIR, ORDER, 5).collect()), key=str) == plain(rows, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_extreme_values_and_no_rows(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, low, high, 0), (low, high, low, 0), (low, 0, None, None), (high, None, None, low), (low, low, high, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    assert sorted((tuple(r) for r in rank_ties(df, ["a"], PAIR, ORDER, 9).collect()), key=str) == plain(rows, 9)
    assert rank_ties(df.where("a = 0"), ["a"], PAIR, ORDER, 3).collect() == []


def test_sale_lines_with_nulls(spark):
    schema = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
    when = datetime(2024, 3, 4)
    rows = [(None, None, None, None, None, None, None, None, None), (7, 1, 23, 5, 39, 1.005, 0.07, "x", when), (7, 1, 23, 5, 39, 1.005, 0.07, "x", when), (8, 2, 13, 5, 30, 2.0, 0.07, "x", when)]
    got = {tuple(r) for r in rank_sale_lines(spark.createDataFrame(rows, schema)).collect()}
    assert (None, -1, -1, 1, 1, None, None, None, None, None, 1) in got
    assert {(5, 3, 202403, p, 1, 7, 1, 39, 7, 100, 3) for p in (1, 2)} | {(5, 3, 202403, 3, 1, 8, 2, 30, 7, 200, 3)} <= got

"""The stratified split against sorting each class."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest

from tallyloom.plans import splits


@pytest.mark.parametrize("seed,n,classes", [(1, 500, 5), (2, 33, 2), (3, 200, 3)])
def test_split_equals_a_sort(spark, seed, n, classes):
    r = random.Random(seed)
    rows = [(i, r.choice("abcde"[:classes]) if r.random() < 0.6 else "a") for i in range(n)]
    df = spark.createDataFrame([(i, c, "s") for i, c in rows], "id long, label string, split0 string")
    got = {x.id: x.split for x in splits.stratified_split(df.repartition(7), "label", "id").collect()}
    counts, tests = Counter(c for _, c in rows), -(-n // 5)
    ideal = {c: Fraction(m * tests, n) for c, m in counts.items()}
    quota = {c: int(x) for c, x in ideal.items()}
    for c in sorted(ideal, key=lambda c: (-(ideal[c] - quota[c]), c))[: tests - sum(quota.values())]:
        quota[c] += 1
    order = lambda i: hashlib.md5(f"42/{i}".encode()).hexdigest()
    want = {i: "test" if k < quota[c] else "train" for c in counts for k, i in enumerate(sorted((i for i, x in rows if x == c), key=order))}
    assert got == want and sum(v == "test" for v in got.values()) == tests
    assert {x.id: x.split for x in splits.stratified_split(df.coalesce(1), "label", "id").collect()} == got


def test_too_little_to_split(spark):
    df = spark.createDataFrame([(i, "a") for i in range(30)], "id long, label string")
    for part in (df, df.where("id < 5"), df.where("false")):
        with pytest.raises(ValueError):
            splits.stratified_split(part, "label", "id")


def test_label_numbers(spark):
    rows = spark.createDataFrame([("x", " update"), ("y", "NON_ORDER"), ("z", "extra"), ("", "NEW_ORDER"), (None, "a"), ("w", None)], "text string, label string")
    assert {(r.label, r.label_id) for r in splits.labelled(rows).collect()} == {("UPDATE", 0), ("NON_ORDER", 1), ("EXTRA", 2)}

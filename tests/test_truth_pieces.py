"""Pieces of texts over few letters, of which short ones are in all texts."""

import hashlib

import pytest

from tallyloom.plans import likeness


def digest(i, n):
    return "".join(hashlib.sha256(f"{i}/{k}".encode()).hexdigest() for k in range(8))[:n]


def test_unlike_digests_are_no_candidates(spark):
    texts = [digest(i, 150 + i % 300) for i in range(400)]
    a = spark.createDataFrame([(t,) for t in texts], "a string")
    b = spark.createDataFrame([(t[:70] + "x" + t[71:],) for t in texts[:100]] + [(digest(1000 + i, 150 + i % 300),) for i in range(400)], "b string")
    got = {(r.a, r.b) for r in likeness.candidate_pairs(a, b, "a", "b", 0.95).collect()}
    assert {(t, t[:70] + "x" + t[71:]) for t in texts[:100]} <= got and len(got) <= 105


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 0.95, 0.99])
def test_one_piece_more_than_edits(least):
    q, longer, border = likeness.sizes(least)
    share, _ = likeness.edits(least)
    for n in range(1, 4000):
        d = int(n * share + 1e-9)
        assert d == 0 or n // (longer if n >= border else q) > d

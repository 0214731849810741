"""The index of q-grams against difflib over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tallyloom.plans.likeness import candidate_pairs, edits
from tallyloom.plans.matching import truth_labels


def changed(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text) + 1)
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("abcé") + text[i:], text[:i] + r.choice("xyz") + text[i + 1 :]])
    return text


@pytest.mark.parametrize("seed,least,letters", [(1, 0.95, "abcdefghij"), (2, 0.9, "ab"), (3, 0.95, "a"), (4, 0.8, "abcé ")])
def test_no_like_pair_is_lost(spark, seed, least, letters):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.choice([1, 3, 5, 9, 10, 11, 19, 20, 21, 40, 120, 260]))) for _ in range(60)]
    other = [changed(r, t, r.randint(0, max(1, len(t) // 12))) for t in base for _ in range(2)] + base[:5]
    a, b = spark.createDataFrame([(t,) for t in [*base, None, ""]], "a string"), spark.createDataFrame([(t,) for t in [*other, None, ""]], "b string")
    got = {(x.a, x.b) for x in candidate_pairs(a, b, "a", "b", least).collect()}
    like = {(s, t) for s in set(base) for t in set(other) if s and t and SequenceMatcher(None, t, s).ratio() >= least}
    assert like <= got and len(like) >= 20


def test_few_candidates_among_unlike_texts(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(60, 200))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    near = spark.createDataFrame([(changed(r, t, 2),) for t in texts[:400]], "b string")
    assert 400 <= candidate_pairs(df, near, "a", "b", 0.95).count() <= 440


def test_edits():
    assert edits(0.95)[1] == 5 and edits(0.9)[1] == 2 and edits(0.8)[1] == 1
    for least in (0.7, 0.8, 0.9, 0.95, 0.99):
        share, q = edits(least)
        for n in range(1, 2000):
            d = int(n * share + 1e-9)
            assert d == 0 or n - q + 1 >= d * q + 1 or q == 1


def test_nothing_is_broadcast_that_grows_with_the_texts(spark):
    """Compressed shuffle files of alike texts are small, and what a driver would build of them is not."""
    a = spark.createDataFrame([(str(i) * 12,) for i in range(100, 200)], "a string")
    pairs = a.withColumnsRenamed({"a": "text_a"}).selectExpr("text_a", "reverse(text_a) AS text_b")
    labels = truth_labels(pairs, pairs.limit(60).selectExpr("upper(text_a) AS text_a", "text_b", "'match' AS label"))
    assert sum(r["truth"] == "MATCH" for r in labels.collect()) >= 60
    assert "Broadcast" not in labels._jdf.queryExecution().executedPlan().toString()

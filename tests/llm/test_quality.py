"""The classifier of subword embeddings: its features by hand, learning against a plain loop, held-out accuracy, odd input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality
from tallyloom.llm.quality import Embeddings, counted, features, fit, keep_good, probabilities, score_quality

SCHEMA = "doc_id long, text string, lang string, score string, held_out string, at string, y string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "h", "a", "y") for i, t in rows], SCHEMA)


def made(n=160):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, " ".join(word() + (r.choice(["$$$", "!!", "***"]) if bad else "") for _ in range(r.randint(5, 60)))))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_features_by_hand():
    who, row = features([b"ab  ab\tcde", b"", b"x", b"cde ab"])
    n = np.bincount(who, minlength=4)
    # constant, words, pairs, n-grams of " ab " (2 of 3, 1 of 4) and " cde " (3, 2, 1) and " x " (1)
    assert n.tolist() == [1 + 3 + 2 + 3 + 3 + 6, 1, 1 + 1 + 1, 1 + 2 + 1 + 3 + 6]
    of = lambda i: sorted(row[who == i])
    again = features([b"ab ab cde"])
    assert sorted(again[1]) == of(0) and of(1)[0] in of(0)
    same = features([b"q q", b"w w"])
    assert len(set(same[1][same[0] == 0]) & set(same[1][same[0] == 1])) == 2  # the constant, and the pair of a word with itself
    bounds, rows, count, total = counted([b"ab ab cde", b""])
    assert count[: bounds[1]].sum() == total[0] == n[0] and total[1] == 1 and (np.diff(rows[: bounds[1]]) > 0).all()


def test_learning_matches_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 512)
    rows, labels = made(30)
    m, plain = Embeddings(2), Embeddings(2)
    for k, ((_, t), (_, y)) in enumerate(zip(rows, labels)):
        bounds, row, n, _ = counted([t.encode()])
        m.learn(row, (n / n.sum()).astype(np.float32), y, 1.0)
        _, each = features([t.encode()])
        hidden = sum(plain.vectors[x] for x in each) / len(each)
        z = plain.output @ hidden
        p = np.exp(z) / np.exp(z).sum()
        g = p - np.eye(2)[y]
        back = g @ plain.output
        plain.output = plain.output - np.outer(g, hidden)
        for x in each:
            plain.vectors[x] -= back / len(each)
    assert np.allclose(m.output, plain.output, atol=1e-4) and np.allclose(m.vectors, plain.vectors, atol=1e-4)
    got = probabilities([rows[0][1].encode()], m.table())[0]
    _, each = features([rows[0][1].encode()])
    z = plain.output @ (sum(plain.vectors[x] for x in each) / len(each))
    assert np.allclose(got, np.exp(z) / np.exp(z).sum(), atol=1e-3)


def test_scores_tell_held_out_rows_apart(spark):
    rows, labels = made()
    docs, truth = docs_of(spark, rows + [(None, None), (900, ""), (900, ""), (901, "word " * 40000)]), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, truth).collect()
    by = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in by]
    assert len(held) > 20 and sum(r.predicted == by[r.doc_id] for r in held) >= 0.9 * len(held)
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 900)}) == 1
    kept = keep_good(docs, truth)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 900").collect()) == sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id < 900 and r.predicted)


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = made(60)
    docs = docs_of(spark, rows)
    from tallyloom.llm.toxicity import held_out

    out = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()}
    turned = [(i, 1 - y if i in out else y) for i, y in labels]
    scores = lambda x: [r.score for r in score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).orderBy("doc_id").collect()]
    assert scores(labels) == scores(turned)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    rows, labels = made(6)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs_of(spark, rows), none).collect()} == {0.5}
    assert score_quality(docs_of(spark, []), none).collect() == []
    assert fit(docs_of(spark, []), none.select("doc_id", F.col("quality").alias("y")), 3).value.shape == (quality.ROWS, 3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_accuracy_on_the_given_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = score_quality(read("documents"), read("labels")).where("held_out").join(read("labels").where("quality is not null"), "doc_id").select("predicted", "quality").collect()
    good, bad = [r.predicted for r in got if r.quality == 1], [r.predicted for r in got if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)

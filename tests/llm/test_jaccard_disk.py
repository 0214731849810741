"""What the near-duplicate join sends through the shuffle grows with the texts, and not with the square of their groups."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import jaccard

from test_llm import plain_components, table


@pytest.fixture(autouse=True)
def all_rare(monkeypatch):
    """As in a table so large that the list of frequent shingles does not reach a template's."""
    monkeypatch.setattr(jaccard, "FREQUENT", 0)


def kinds(count):
    """Documents of one template in several components, of several sizes."""
    r, common, rows = random.Random(9), [f"c{i}" for i in range(40)], []
    for k in range(count):
        own = [f"k{k}w{i}" for i in range(r.choice([9, 14, 30]))]
        for _ in range(r.randint(1, 3)):
            w = common[r.randint(0, 2) :] + own
            rows.append((len(rows), " ".join(w[: -r.randint(1, 3)] if r.random() < 0.5 else w)))
    return rows


def labels(spark, rows):
    return sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(table(spark, rows)).collect()), key=str)


def test_sets_of_a_small_hub_travel_once(spark, monkeypatch):
    rows, sent, plain = kinds(60), [], jaccard._block_pairs

    def spied(placed, num, den):
        out = plain(placed, num, den)
        sent.append((placed.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_block_pairs", spied)
    assert labels(spark, rows) == plain_components(rows)
    assert sent and all(entities == travelled for entities, travelled in sent)


def test_blocks_travel_in_rounds(spark, monkeypatch):
    """The pairs of blocks of a large hub, with no more bytes of sets at once than a round may shuffle, up to one pair's."""
    rows, asked, plain = kinds(60), [], jaccard._block_links
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "ROUND_BYTES", 40_000, raising=False)
    monkeypatch.setattr(jaccard, "ROUND_SHARE", 0, raising=False)
    monkeypatch.setattr(jaccard, "_block_links", lambda *a: asked.append(1) or plain(*a))
    assert labels(spark, rows) == plain_components(rows)
    assert len(asked) > 1


def test_only_texts_that_are_wanted_are_shuffled(spark, monkeypatch):
    """Beyond BROADCAST_IDS too."""
    rows, seen, plain = kinds(40) + [(10_000 + i, f"alone {i} of its own kind {i * i} x") for i in range(400)], [], jaccard._maybe_in

    def spied(docs, ids, n):
        out = plain(docs, ids, n)
        seen.append((ids.select("doc_id").distinct().count(), out.count(), out.join(ids, "doc_id", "left_semi").count()))
        return out

    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "_maybe_in", spied)
    assert labels(spark, rows) == plain_components(rows)
    assert seen and all(wanted == found and passed <= wanted + 5 for wanted, passed, found in seen)


def test_the_sieve_lets_every_id_pass(spark):
    ids = spark.range(0, 200_000, 7).withColumnRenamed("id", "doc_id")
    docs = spark.range(-1000, 200_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    left = jaccard._maybe_in(docs, ids, ids.count())
    assert left.join(ids, "doc_id", "left_semi").count() == ids.count() and left.count() < ids.count() * 1.2

"""The gate of texts by hash: equal to a dictionary, lookups that read what they must, replays and crashes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.gate import HashGate
from tallyloom.sources.store import TableStore


def texts(spark, rows):
    return spark.createDataFrame(rows, "seq long, chat_text string")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_batches_equal_a_dictionary(spark, tmp_path):
    r, g, plain = random.Random(2), HashGate(spark, str(tmp_path / "g"), expected=64, buckets=4), {}
    for n in range(4):
        rows = [(100 * n + i, r.choice([f"chat {r.randrange(60)}", f" chat {r.randrange(60)}\n", "", None])) for i in range(30)]
        r.shuffle(rows)
        want: dict = {}
        for seq, t in sorted(rows):
            want.setdefault((t or "").strip(), str(seq))
        want = {t: i for t, i in want.items() if t not in plain}
        df = texts(spark, rows)
        assert sorted(x.id for x in g.new(df).collect()) == sorted(want.values())
        assert sorted(x.id for x in g.admit(df, f"b{n}").collect()) == sorted(want.values())
        assert sorted(x.id for x in g.admit(df, f"b{n}").collect()) == sorted(want.values())  # the batch again
        plain |= want
    assert {x.id for x in g.store.read().collect()} == set(plain.values()) and g.store.read().count() == len(plain)
    some = next(iter(plain))
    assert g.find(f"  {some} ") == plain[some] and g.find("never told") is None
    g.rebuild(10_000)
    assert g.find(some) == plain[some] and HashGate(spark, str(tmp_path / "g")).blocks == g.blocks
    assert g.new(texts(spark, [(1, t) for t in plain])).count() == 0


def test_lookups_read_and_write_what_they_must(spark, tmp_path, monkeypatch):
    g = HashGate(spark, str(tmp_path / "g"), expected=20_000, buckets=16)
    df = spark.range(4000).select(F.col("id").alias("seq"), F.concat(F.lit("chat "), "id").alias("chat_text"))
    assert g.admit(df, "a").count() == 4000
    other = g.firsts(df.withColumn("chat_text", F.concat(F.lit("x"), "chat_text")))
    assert g._maybe(g.firsts(df)).count() == 4000 and g._maybe(other).count() < 20  # none is missed, and few are looked up for nothing
    before, read = files(tmp_path / "g"), []
    beside = TableStore.beside
    monkeypatch.setattr(TableStore, "beside", lambda s, rows: read.append((s is g.store, out := beside(s, rows))) or out)
    assert g.admit(df.limit(500), "b").count() == 0 and files(tmp_path / "g") == before  # known texts write nothing
    read.clear()
    assert g.find("never told") is None and not [d for mine, d in read if mine]
    assert g.find("chat 7") == "7"
    assert [len({os.path.dirname(f) for f in d.inputFiles()}) for mine, d in read if mine] == [1]
    assert g.admit(texts(spark, [(9000, "brand new")]), "c").first().id == "9000"
    assert g.filters.read().where("home is null").count() == 0
    assert len({os.path.dirname(f) for f in files(tmp_path / "g") - before}) == 2  # a bucket of rows, and one of filters


@pytest.mark.parametrize("where", ["insert", "_change"])
def test_a_crash_loses_no_text(spark, tmp_path, where, monkeypatch):
    """A batch that breaks off before the rows, or before the bits, is admitted whole when it comes again."""
    g = HashGate(spark, str(tmp_path / "g"), expected=64, buckets=4)
    g.admit(texts(spark, [(1, "a")]), "first")
    df = texts(spark, [(2, "a"), (3, "b"), (4, "c")])

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(TableStore, where, broken)
        with pytest.raises(RuntimeError, match="lost"):
            g.admit(df, "second")
    assert g.store.read().count() == 1 and not files(tmp_path / "g" / "staged")
    assert sorted(x.id for x in g.admit(df, "second").collect()) == ["3", "4"] and g.find("b") == "3"

"""The store that changes by buckets, its log of versions, and sessions: crashes, writers at once, touched parts only."""

import os
import random
import subprocess
import sys
import textwrap
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import sync, workspace
from tallyloom.sources.store import FILES, TableStore
from tallyloom.sources.versions import VersionLog

SCHEMA = "g string, id long, v string"


def store(spark, path, buckets=8):
    return TableStore(spark, str(path), SCHEMA, by="g", key="id", buckets=buckets)


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def content(s):
    return sorted(tuple(r) for r in s.read().collect())


def test_changes_equal_a_dictionary(spark, tmp_path):
    r, s, plain = random.Random(1), store(spark, tmp_path / "t"), {}
    assert content(s) == [] and s.upsert(rows(spark)) == 0
    for step in range(8):
        new = {i: (f"g{i % 13}", i, f"{step}") for i in r.sample(range(60), 12)}
        what = r.choice(["upsert", "insert", "delete", "upsert"])
        assert getattr(s, what)(rows(spark, *new.values())) == step + 1
        plain = {k: v for k, v in plain.items() if k not in new} if what == "delete" else plain | new if what == "upsert" else new | plain
        assert content(s) == sorted(plain.values())
    assert sorted(tuple(x) for x in s.read(1).collect()) != content(s)
    s.vacuum()
    assert content(s) == sorted(plain.values())
    there = next(iter(plain.values()))
    assert sorted(x.id for x in s.lacking(rows(spark, ("new", 900, "x"), ("new", 900, "y"), there)).collect()) == [900]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_written_and_read(spark, tmp_path):
    s = store(spark, tmp_path / "t", 32)
    s.upsert(rows(spark, *((f"g{i}", i, "a") for i in range(400))))
    for i in range(5):
        before, (_, old) = files(tmp_path / "t" / "data"), s.log.latest()
        one = rows(spark, (f"g{i}", i, "b"))
        assert len({os.path.dirname(f) for f in s.beside(one).inputFiles()}) == 1
        s.upsert(one)
        new = files(tmp_path / "t" / "data") - before
        assert len({os.path.dirname(f) for f in new}) == 1 and before <= files(tmp_path / "t" / "data")
        _, now = s.log.latest()
        assert sum(now["parts"][b] != old["parts"][b] for b in now["parts"]) == 1


def test_a_bucket_has_few_files_and_a_frequent_value_several(spark, tmp_path):
    s = store(spark, tmp_path / "t", 4)
    many = spark.range(400, numPartitions=40).select(F.lit("hot").alias("g"), "id", F.lit("x").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        s.upsert(many.union(spark.range(400, 800, numPartitions=40).select(F.concat(F.lit("g"), "id"), "id", F.lit("y"))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held: dict = {}
    for f in files(tmp_path / "t" / "data"):
        held.setdefault(os.path.dirname(f), []).append(f)
    assert len(held) == 4 and all(len(fs) <= FILES for fs in held.values()) and max(map(len, held.values())) > 1
    assert len(content(s)) == 800


def test_a_crash_leaves_one_version(spark, tmp_path):
    """A process is killed between writing its folders and the version; the table is as before, and goes on."""
    s = store(spark, tmp_path / "t")
    s.upsert(rows(spark, ("a", 1, "x"), ("b", 2, "y")))
    code = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession
        from tallyloom.sources.store import TableStore
        from tallyloom.sources.versions import VersionLog
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        VersionLog.put = lambda *a: os._exit(9)
        s = TableStore(spark, {str(tmp_path / 't')!r}, {SCHEMA!r}, by="g", key="id")
        s.upsert(spark.createDataFrame([("a", 1, "lost"), ("c", 3, "lost")], {SCHEMA!r}))
    """)
    before = files(tmp_path / "t" / "data")
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), timeout=240, capture_output=True)
    assert done.returncode == 9 and files(tmp_path / "t" / "data") > before
    assert content(s) == [("a", 1, "x"), ("b", 2, "y")] and s.log.numbers() == [1]
    assert s.vacuum() > 0 and files(tmp_path / "t" / "data") == before
    s.upsert(rows(spark, ("a", 1, "z")))
    assert content(s) == [("a", 1, "z"), ("b", 2, "y")]


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_at_once_lose_nothing(spark, tmp_path, same, monkeypatch):
    """Another writer comes in between the reading and the version: on the same bucket the change is done anew, on another it is joined."""
    s, other = store(spark, tmp_path / "t"), store(spark, tmp_path / "t")
    s.upsert(rows(spark, ("a", 1, "x"), ("zz", 2, "y")))
    put, met = VersionLog.put, []

    def late(log, number, new):
        if log is s.log and not met:
            met.append(1)
            other.upsert(rows(spark, ("a" if same else "zz", 10, "theirs")))
        return put(log, number, new)

    monkeypatch.setattr(VersionLog, "put", late)
    s.upsert(rows(spark, ("a", 11, "ours")))
    assert {x[1] for x in content(s)} == {1, 2, 10, 11}


def test_log_versions_are_put_once(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, {}) and log.put(1, {"n": 1}) and not log.put(1, {"n": 2}) and log.latest() == (1, {"n": 1})
    each = [threading.Thread(target=lambda: [VersionLog(spark, str(tmp_path / "log")).change(lambda c: {"n": c["n"] + 1}) for _ in range(10)]) for _ in range(4)]
    [t.start() for t in each], [t.join() for t in each]
    assert log.latest() == (41, {"n": 41})


def test_sessions_of_two_writers(spark):
    name = f"default.reg_{uuid.uuid4().hex}"
    w = workspace.Workspace(spark, name)
    a, b = w.create("a"), workspace.Workspace(spark, name).create("b")
    each = [threading.Thread(target=f) for f in (lambda: w.rename(a, "a2"), lambda: workspace.Workspace(spark, name).rename(b, "b2"), lambda: w.touch(a))]
    [t.start() for t in each], [t.join() for t in each]
    assert {r.name for r in w.sessions().collect()} == {"a2", "b2"}
    w.auto_name(a, "never")
    assert {r.name for r in w.sessions().collect()} == {"a2", "b2"} and w.sessions().first().session_id in (a, b)
    w.delete(a), w.delete(b)


def test_old_tables_gain_their_columns(spark):
    w = workspace.Workspace(spark, f"default.reg_{uuid.uuid4().hex}")
    s = w.create()
    name = f"`{workspace.schema_name(s)}`.order_dataset"
    assert w.migrate(s) == {}
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([("1", "GUDANG")], "id string, pickup string").write.format("parquet").saveAsTable(name)
    want = set(spark.createDataFrame([], workspace.TABLES["order_dataset"]).columns)
    assert set(w.migrate(s)["order_dataset"]) == want - {"id", "pickup"} and w.migrate(s) == {}
    row = spark.table(name).first()
    assert row.pickup == "GUDANG" and set(spark.table(name).columns) >= want and row.tujuan is None
    w.delete(s)


def test_blocks_into_a_store(spark, tmp_path):
    """The store holds what sync_blocks() gives, and each block has written its own order's bucket only."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    fields = ("tgl_ro", "tgl_muat", "pickup", "tujuan", "no_plat", "type_truck", "driver", "kontak_driver")
    unit = lambda n: {"no_plat": f"B {n} X", "driver": f"sopir {n}", "kontak_driver": f"08{n}"} if n else {}

    def row(block, place, seq, n):
        said = {"tgl_ro": "5 MARET 2026", "tgl_muat": "6 MARET 2026", "pickup": place, "tujuan": "KOTA", "type_truck": "CDD", "no_plat": "", "driver": "", "kontak_driver": ""} | unit(n)
        return (block, seq, seq, f"REQUEST ON CALL 5 MARET 2026 {place} KOTA CDD order_state", *(said[c] for c in fields))

    units = [row(1, "GUDANG A", 1, 1), row(1, "GUDANG A", 2, 0), row(2, "GUDANG B", 11, 0), row(3, "GUDANG A", 21, 3)]
    df = spark.createDataFrame(units, "chunk_no int, seq long, unit_no long, text string, " + ", ".join(f"{c} string" for c in fields))
    sure = lambda a, b: a.str.len() * 0 + 0.9
    s = sync.order_store(spark, str(tmp_path / "orders"), 64)
    plans = sync.sync_store(s, df, scorer=sure)
    want, _ = sync.sync_blocks(spark.createDataFrame([], ", ".join(x for x in sync.STORED.split(", ") if not x.startswith("order_key"))), df, scorer=sure)
    names = want.columns
    assert sorted(map(tuple, s.read().select(*names).collect())) == sorted(map(tuple, want.collect()))
    assert len(plans) == 3 and s.log.numbers() == [1, 2, 3]
    parts = [set(s.log.read(n)["parts"].items()) for n in s.log.numbers()]
    assert [len(b - a) for a, b in zip(parts, parts[1:])] == [1, 1]

"""Cards, plans, generators, model adapters and stores against plain Python."""

from __future__ import annotations

import io as stdio
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fields, identity, text
from tallyloom.plans import cards, evidence, generate, models, parse, sync, workspace
from tallyloom.sources import io

ROW = "seq long, candidate_key string, tgl_ro string, tgl_muat string, pickup string, tujuan string, no_plat string, type_truck string, driver string, kontak_driver string, status_unit string"


def order(seq, key="k", **values):
    names = [x.split()[0] for x in ROW.split(", ")]
    return tuple({"seq": seq, "candidate_key": key, "status_unit": "PARTIAL", "tgl_ro": "5 MARET 2026", "tgl_muat": "6 MARET 2026", "pickup": "GUDANG A", "tujuan": "KOTA", "type_truck": "CDD"} .get(n, "") if n not in values else values[n] for n in names)


def unit(n, plate=None):
    return {"no_plat": plate or f"B {n} X", "driver": f"sopir {n}", "kontak_driver": f"08{n}{n}"}


def test_event_filters(spark):
    events = spark.createDataFrame(
        [("1", "c", "k", "MATCH", "MATCH", 0.9, True, 0, 0, "SIAP_ISI_SLOT", "a"), ("2", "c", "k", "MATCH", "NO_MATCH", 0.9, False, 1, 0, "X", "a"), ("3", "c", "k", "NO_MATCH", "NO_MATCH", 0.1, False, 0, 0, "TIDAK_COCOK", "a"), (None, "c", "k", "NO_MATCH", "MATCH", 0.3, False, 0, 0, "X", "a")],
        "id string, raw_chat_id string, candidate_key string, predicted string, truth string, p_match double, ready boolean, applied int, duplicates int, decision_status string, action string",
    )
    ids = lambda df: sorted(str(r.id) for r in df.collect())
    assert ids(events.where(cards.is_confident_merge())) == ["1", "2"] and ids(events.where(cards.is_clear_new_order())) == ["3"]
    assert ids(cards.detail_rows(events, "Salah")) == ["2", "None"] and ids(cards.detail_rows(events, "False Positive (Salah Deteksi)")) == ["2"]
    assert ids(cards.detail_rows(events, "MATCH benar + Semua Kesalahan")) == ["1", "2", "None"] and len(ids(cards.detail_rows(events, "all"))) == 4
    assert ids(cards.with_errors(events.where("id = '2'"), events)) == ["2", "None"]
    assert ids(cards.without_candidate(events, "k")) == [] and len(ids(cards.without_candidate(events, " "))) == 4
    table = cards.evaluation_table(events.withColumns({c: F.lit(v) for c, v in {"seq": "7", "candidate_summary": "", "ca_tgl_ro": "1/2/2026", "in_tgl_ro": "01 FEB 2026", "ca_pickup": "A", "in_pickup": "", "ca_type_truck": "CDD", "in_type_truck": "FUSO"}.items()}))
    rows = {r.pair_id: r for r in table.collect()}
    assert set(rows) == {"1", "2", "3", "k"} and tuple(rows["2"])[1:] == ("-", "NO_MATCH", "MATCH", "Salah", "False Positive", "OK", "BEDA/KOSONG", "BEDA/KOSONG")


def test_rows_that_an_order_has_taken(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), ROW)
    rows = df(order(1, **unit(1)), order(2, **unit(2)), order(3), order(4, "other", **unit(1)))
    left = cards.without_applied(rows, df(order(9)), df(order(9, **unit(1))), "k")
    assert sorted(r.seq for r in left.collect()) == [2, 3, 4]


def test_cards(spark):
    df = spark.createDataFrame([(1, "Driver", "ani", "", "", ""), (2, "", "", "B 1", "", ""), (3, "", "", "", "", "4 MARET")], "row int, x string, driver string, no_plat string, kontak_driver string, tgl_muat string")
    assert sorted(r.cell for r in cards.red_cells(df, "Driver", "row").collect()) == ["2::Driver"]
    assert sorted(r.cell for r in cards.red_cells(df, "Tgl Muat", "row").collect()) == ["1::Tgl Muat", "2::Tgl Muat"]
    ask = lambda expr, *v: [r.v for r in spark.createDataFrame(list(enumerate(v)), "i int, c string").select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]
    assert ask(lambda c: cards.needs_border("Tgl RO", c), "2026", " -2026", "5 MARET 2026", "") == [True, True, False, False]
    assert ask(lambda c: cards.needs_border("Tgl Muat", c), "08:00 5/3", "08.00 5/3/2026", "5/3/2026", None) == [True, False, False, False]
    out = cards.output_values(spark.createDataFrame([("b", 1, " x "), ("b", 2, "-"), ("b", 3, "x"), ("b", 4, "y")], "block string, n int, v string"), "block", "v", "n").first()
    assert (out.quantity, out.slots, out["values"]) == ("4", ["x", "x", "y"], ["x", "y"])
    rows = spark.createDataFrame([("A", "CORRECT", 1, 0, 0, 0, False), ("A", "MISSING", 0, 0, 1, 0, False), ("B", "DUPLICATE", 1, 1, 0, 1, True)], "attribute string, status string, tp int, fp int, fn int, duplicate_fp int, label_swap boolean")
    n = lambda *a: cards.attribute_rows(rows, *a).count()
    assert [n(), n("A"), n("A", "Benar"), n("Semua atribut", "Ada masalah"), n("Semua atribut", "Tidak terekstrak"), n("B", "Duplikasi"), n("B", "Atribut tertukar"), n("B", "Parsial")] == [3, 2, 1, 2, 1, 1, 1, 0]
    c = spark.createDataFrame([("LENGKAP", True), ("BELUM LENGKAP", False)], "order_status string, problematic boolean")
    assert cards.card_rows(c, "Lengkap", "OK").count() == 0 and cards.card_rows(c, "Belum", "OK").count() == 1 and cards.shown(c, "order_status", 1).first().order_status == "BELUM LENGKAP"
    assert [spark.range(1).select(cards.is_common(F.array(*map(F.lit, v)))).first()[0] for v in (("a", "A "), ("a", "b"), ("-", "a"))] == [True, False, True]


def test_stages(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), ROW + ", stage int")
    own = df((*order(1, **unit(1)), 0), (*order(2), 0))
    stages = df((*order(3, **unit(1)), 1), (*order(4, **unit(2)), 1), (*order(5, **unit(3)), 2), (*order(6, **unit(2)), 2))
    lines = {r.stage: r.line for r in cards.cumulative_units(own, stages, "no_plat").collect()}
    assert lines == {1: "Susulan #1: B 1 X | B 2 X", 2: "Susulan #2: B 1 X | B 2 X | B 3 X"}
    assert [r.line for r in cards.cumulative_units(own, stages.where("stage = 1"), "no_plat").collect()] == ["B 1 X | B 2 X"]
    assert [r.line for r in cards.cumulative_units(own.where("false"), stages.where("false").union(df((*order(9), 1))), "no_plat").collect()] == ["-"]
    assert cards.progress_labels(stages, own).first().labels == ["sopir 1 | B 1 X", "sopir 2 | B 2 X", "sopir 3 | B 3 X", "sopir 2 | B 2 X"]
    assert cards.progress_labels(stages.where("false"), own).first().labels == ["sopir 1 | B 1 X"]
    assert [(r.stage, r.seq) for r in cards.final_units(own, stages, stages.where("false")).orderBy("stage", "seq").collect()] == [(0, 1), (1, 4), (2, 5)]
    assert [(r.stage, r.seq) for r in cards.final_units(own, stages.where("false"), stages.drop("stage")).orderBy("stage", "seq").collect()] == [(None, 4), (None, 5), (0, 1)]
    assert cards.unit_list(own).first().units.startswith("1. sopir 1 | B 1 X | ")
    chats = spark.createDataFrame([("e", "c2", 3, "x"), ("e", "c1", 1, "y"), ("e", "c1", 2, "z"), ("f", "c", 1, "w")], "event string, chat string, seq int, v string")
    assert [[[(r.seq, r.v) for r in chat] for chat in x.chats] for x in cards.context_chats(chats, "event", "chat", "seq", "v").collect()] == [[[(1, "y"), (2, "z")], [(3, "x")]]]


def test_model_reports(spark, tmp_path):
    logs = spark.createDataFrame([({"step": 100.0, "eval_f1": 0.8, "eval_loss": 0.2},), ({"step": 200.0, "eval_f1": 0.9, "eval_loss": 0.3},), ({"step": 300.0, "eval_f1": 0.9, "eval_loss": 0.4},)], "log map<string,double>").withColumn("step", F.col("log")["step"])
    best = cards.best_row(logs, ["eval_other", "eval_f1"])
    row = best.first()
    assert (row.metric, row.best["step"], row.latest["step"]) == ("eval_f1", 200.0, 300.0)
    assert tuple(cards.report_row(best, "NER", "tagging", "checkpoint-200").first()) == ("NER", "tagging", "checkpoint-200", "200", "F1-score", "90.00%", "90.00%")
    none = cards.best_row(logs, ["missing"]).first()
    assert none.metric is None and none.best["step"] == 300.0
    m = spark.createDataFrame([({"10": "C", "2": "MATCH", "0": "O"},), ({},)], "m map<string,string>")
    assert [tuple(r) for r in m.select(cards.label_summary(F.col("m")), cards.label_of(F.col("m"), F.lit(2)), cards.match_number(F.col("m"))).collect()] == [("O, MATCH, C", "MATCH", 2), ("-", "2", 1)]
    assert spark.range(1).select(cards.short_path(F.lit("/a/b/c"), "/a"), cards.short_path(F.lit(""), "/a"), cards.short_path(F.lit("/x"), "/a")).first() == ("b/c", "-", "/x")
    for step in (5, 20):
        (tmp_path / f"checkpoint-{step}").mkdir()
        (tmp_path / f"checkpoint-{step}" / "config.json").write_text('{"id2label": {"0": "NO_MATCH", "1": "MATCH"}}')
    assert io.checkpoint_of_step(spark, str(tmp_path), 20).endswith("checkpoint-20") and io.checkpoint_of_step(spark, str(tmp_path), 7) is None and io.checkpoint_of_step(spark, str(tmp_path), None) is None
    found = models.find_model(spark, str(tmp_path))
    assert found.endswith("checkpoint-20") and models.labels_of(spark, found) == {0: "NO_MATCH", 1: "MATCH"} and models.find_model(spark, str(tmp_path / "none")) is None


def test_model_scoring(spark, tmp_path):
    pairs = spark.createDataFrame([(i, "a b" if i % 2 else "x", "a", "keep") for i in range(100)] + [(100, None, "a", "keep")], "i int, text_a string, text_b string, other string")

    def load(folder):  # fails at first, as a shared folder may
        from pathlib import Path

        mark = Path(folder) / "tried"
        if not mark.exists():
            mark.touch()
            raise OSError("not yet")
        return lambda a, b: [1.0 if y in x else 0.25 for x, y in zip(a, b)]

    got = models.score_pairs(pairs, load, str(tmp_path)).collect()
    assert len(got) == 101 and all((r.p_match, r.predicted) == ((1.0, "MATCH") if r.i % 2 else (0.0 if r.i == 100 else 0.25, "NO_MATCH")) and r.other == "keep" for r in got)
    events = spark.createDataFrame([("revisi nopol",), ("fyi info",), (None,)], "t string")
    assert [(r.event_label, r.passes) for r in models.classify_events(events, "t").collect()] == [("UPDATE", True), ("NON_ORDER", False), ("NON_ORDER", False)]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert io.cumulative_metrics(spark, path) == (0.0, 0.0)
    io.record_metrics(spark, path, 5, 2)
    io.record_metrics(spark, path, 7.5)
    assert io.cumulative_metrics(spark, path) == (7.5, 0.0)
    io.reset_metrics(spark, path)
    assert io.cumulative_metrics(spark, path) == (0.0, 0.0)
    data = io.spreadsheet(spark.createDataFrame([("a & b", 1), (None, 2)], "`No.` string, n int"), "Order <1>")
    with zipfile.ZipFile(stdio.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert re.findall(r"<t [^>]*>([^<]*)</t>", sheet) == ["No.", "n", "A &amp; B", "1", "", "2"] and z.testzip() is None
        assert "Order &lt;1&gt;" in z.read("xl/workbook.xml").decode()
    assert [tuple(r) for r in io.to_rows(spark, [{"a": 1}, {"b": "x", "a": None}]).collect()] == [("1", None), (None, "x")]
    with pytest.raises(RuntimeError):
        workspace.require_test_database(spark)
    spark.conf.set("spark.tallyloom.session.test", "on")
    spark.conf.set("spark.tallyloom.session.database", "orders_session_test")
    with pytest.raises(RuntimeError):
        workspace.require_test_database(spark)
    spark.conf.set("spark.tallyloom.session.expected", "orders_session_test")
    assert workspace.require_test_database(spark) == "orders_session_test"
    assert workspace.first_setting(spark, "spark.tallyloom.none", "spark.tallyloom.session.test") == "on"
    df = spark.createDataFrame([("5/3/2026", "08:00", "a")], "tgl_ro string, tgl_muat string, pickup string")
    assert io.operational(df).first().pickup == "a" and tuple(io.operational(df, True).first())[0::2] == ("5-MAR-2026", "A")


def test_header_starts(spark):
    chat = "[08.00, 1/2/2026] Budi:\n\nREQUEST ON CALL\nx\nsiap\nONCALL 2\n[09.00, 1/2/2026] Ani: halo\nREQUEST 3"
    df = spark.createDataFrame([(chat,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.header_starts(F.col("t"))).collect()] == [[0, 5, 7], [], []]


def test_sync_of_blocks(spark, tmp_path):
    """The second block fills the order that the first has made; a third with too many units is an order of its own."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    empty = spark.createDataFrame([], ROW).drop("candidate_key")
    row = lambda chunk, seq, u=None: (chunk, seq, seq, "REQUEST ON CALL 5 MARET 2026 GUDANG A KOTA CDD order_state", *order(seq, **(u or {}))[2:])
    units = [row(1, 1, unit(1)), row(1, 2), row(1, 3), row(2, 11, unit(1)), row(2, 12, unit(2)), *(row(3, 20 + i, unit(5 + i)) for i in range(3))]
    schema = "chunk_no int, seq long, unit_no long, text string, " + ROW.split(", ", 2)[2]
    after, plans = sync.sync_blocks(empty, spark.createDataFrame(units, schema).drop("status_unit"), scorer=lambda a, b: a.str.len() * 0 + 0.9)
    rows = {r.seq: r.no_plat for r in after.collect()}
    assert rows == {1: "B 1 X", 2: "B 2 X", 3: "", 20: "B 5 X", 21: "B 6 X", 22: "B 7 X"}
    said = {(r.chunk_no, r.decision_status, r.fill, r.overflow, r.ready) for r in plans.collect()}
    assert said == {(2, "SIAP_ISI_SLOT", 1, 0, True), (3, "PERLU_REVIEW", 1, 2, False)}
    assert {r.policy_reason for r in plans.collect()} == {sync.REASONS["REKOMENDASI_ISI_SLOT_ORDER_LAMA"], sync.REASONS["overflow"]}


def test_generated_pairs(spark):
    rows = generate.order_pairs(generate.month_numbers(spark, {1: 60, 2: 80}), seed=3).collect()
    assert len(rows) == 140 and {r.month for r in rows} == {1, 2} and {r.total for r in rows} == set(range(1, 9))
    value = lambda t, label: re.findall(rf"(?im)^{label}[ ]*:[ ]*(.*)$", t)
    for r in rows:
        drivers = value(r.follow_text, "driver")
        assert len(drivers) == len({*drivers}) == r.total and 1 <= r.day <= 31 and (r.month != 2 or r.day <= 28)
        known = [d for d in value(r.parent_text, "driver") if d]
        assert known == drivers[: r.filled] and (0 < r.filled < r.total or r.total == 1 and r.filled == 0)
        assert all(re.fullmatch(r"(08\d{10}|08\d\d-\d{4}-\d{4}|\+62 8\d\d-\d{4}-\d{4}|628\d{10})", p) for p in value(r.follow_text, "no hp"))
    again = generate.order_pairs(generate.month_numbers(spark, {1: 60, 2: 80}).repartition(5), seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows)) != sorted(map(str, generate.order_pairs(generate.month_numbers(spark, {1: 60, 2: 80}), seed=4).collect()))


def test_varied_pairs(spark):
    a = "REQUEST 5 MARET 2026 dan 06/03/2026 jam 08:30 B 1234 XY D 5 Q 081234567890 +62 811-1234-567"
    t = spark.createDataFrame([(1, a, a.replace("dan", "atau") + " 5 maret 2026", "MATCH")], "template_id long, text_a string, text_b string, label string")
    rows = generate.varied_pairs(t, 50).collect()
    patterns = [p for _, p in generate.KINDS]
    assert len({r.pair_id for r in rows}) == 50 and len({r.text_a for r in rows}) == 50
    for r in rows:
        assert r.text_b.startswith(r.text_a.replace("dan", "atau"))  # the same successors on both sides
        assert r.text_b.upper().endswith(re.search(patterns[0], r.text_a)[0].upper())
        kept = lambda s: re.sub("|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns), "#", s, flags=re.I)
        assert kept(r.text_a) == kept(a) and "1234 XY" not in r.text_a and "081234567890" not in r.text_a


def test_operational_cases(spark):
    rows = evidence.pair_checks(generate.operational_cases(spark).withColumnRenamed("expected", "truth")).collect()
    assert len(rows) == 29 and len({r.case_id for r in rows}) == 29
    wrong = [(r.case_id, r.focus, r.truth, r.expected, r.rule_advisory) for r in rows if r.truth != r.expected]
    assert not wrong, wrong
    assert all((r.gate == "BLOCK") == ("BLOCK" in r.rule_advisory) and (r.gate == "OK") == (r.rule_advisory == "OK") for r in rows), [(r.focus, r.gate, r.rule_advisory) for r in rows]


def test_labels_are_spelt_in_one_way(spark):
    said = ["lokasi loading: x", "LOKASIII : x", "waktulodng:1", "Waktu  loadingg :1", "rute / tujuann : a", "rute: a", "RuteTuj: a", "driverr 2: b", "ddriver: b", "nama 1 :b", "nopolll: c", "no pol : c", "NOHP:1", "no  telepon: 1", "kontak : 1", "unit/type: z", "lokasix : y"]
    want = ["Lokasi : x"] * 2 + ["Waktu loading : 1"] * 2 + ["Rute/tujuan : a"] * 3 + ["Driver : b"] * 3 + ["Nopol : c"] * 2 + ["No hp : 1"] * 3 + ["Unit/Type : z", "lokasix : y"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(fields.normal_labels(F.col("c"))).collect()] == want
    assert text.BLANKS and identity.IDENTITY

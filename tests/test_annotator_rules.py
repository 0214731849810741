"""The annotator's rules by lines' first letters against re over whole texts."""

import random
import re

import pytest

from tallyloom.plans import annotate

PLAIN = {
    "RO_DATE": r"(?i)\bon\s*call\s+(?P<v>\d{1,2}[\s/-]+(?:[a-z]{3,10}|\d{1,2})[\s/-]+\d{2,4})",
    "LOAD_DATE": r"(?i)waktu\s*loading\s*:[^\n]*?(?P<v>\d{1,2}/\d{1,2}/\d{2,4})",
    "TIME": r"(?i)waktu\s*loading\s*:\s*(?P<v>segera|\d{1,2}[:.]\d{2})",
}
PIECES = [
    "on call 1 Mei 2024", "ONCALL 1/5/24", "non call 1 Mei 2024", "_on call 2 mei 2024", "éon call 2 mei 2024", "ſon call 3 mei 2024", "3 unit", "٣ unit cdd", "12 UNIT FUSO", "lokasi :", "LOKASI: GUDANG 1", "rute/tujuan : A - B", "Rute:", "driver :",
    "Driver: ani ", "DRIVER  :\tbudi", "nopol : B 1 X", "Nopol:", "no hp : +62 811-111 111", "NoHp: 0811", "no hp :", "Waktu Loading : 08:00 1/2/2024", "waKtu loading: segera", "waktuloading : 2/3/24", "08:00", "1/2/2024", "", " ", "\t", " ", " ",
    "\x1c", "\r", "x", "driver", ":", "-",
]


def test_rules_find_what_re_finds(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(PIECES) + r.choice(["\n", "\n", "\n", " ", "", "\n\n", "\r\n", " \n "]) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", None]
    rules = {k: re.compile(p) for k, p in (annotate.RULES | PLAIN).items()}
    want = [sorted((m.start("v"), m.end("v"), k, m["v"]) for k, p in rules.items() for m in p.finditer(t or "")) for t in texts]
    rows = annotate.annotate(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    got = {r.i: [(s.start, s.stop, s.label, s.value) for s in r.spans] for r in rows}
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 5000


def test_rules_of_lines_are_not_looked_for_at_each_place():
    """Nor are those that begin with any letter tried without it."""
    anywhere, digits, letters = annotate.by_first(annotate.RULES)
    assert [x for x, _ in anywhere] == ["RO_DATE", "LOAD_DATE", "TIME"] and [x for x, _ in digits] == ["UNIT_QTY", "UNIT_TYPE"]
    assert sorted({x for pairs in letters.values() for x, _ in pairs}) == ["DESTINATION", "DRIVER", "ORIGIN", "PHONE", "PLATE"]


@pytest.mark.parametrize("rule", [r"(?im)^\s*(?P<v>a|b)", r"(?im)^\s*a|(?P<v>b)", r"(?im)^\s*a?(?P<v>b)", r"(?im)^\s*s(?P<v>b)", r"(?i)a(?P<v>b)", r"(?im)^\s*[a](?P<v>b)"])
def test_other_rules_are_looked_for_everywhere(rule):
    assert [x for x, _ in annotate.by_first({"X": rule})[0]] == ["X"]

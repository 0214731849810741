"""Entities in tags against a plain reading, with broken tags and shifted boundaries."""

import random
from collections import Counter

from tallyloom.plans.spans import entity_metric, entity_spans


def plain(tags):
    out, open_ = [], None
    for i, t in enumerate([*(tags or []), "O"]):
        kind = t[2:] if t and t[:2] in ("B-", "I-") else None
        if open_ and (kind != open_[0] or t.startswith("B-")):
            out.append((*open_, i - 1))
            open_ = None
        if kind is not None and open_ is None:
            open_ = (kind, i)
    return out


def test_spans_and_counts(spark):
    r = random.Random(3)
    tags = lambda: [r.choice(["O", "B-X", "I-X", "B-Y", "I-Y", "I-", "?"]) for _ in range(r.randint(0, 9))]
    rows = [(i, t, t if r.random() < 0.4 else [r.choice([x, x, "O", "I-X"]) for x in t]) for i in range(150) for t in [tags()]] + [(900, None, None), (901, [], []), (902, ["B-X", "I-X"], ["B-X", "O"])]
    df = spark.createDataFrame(rows, "k long, truth array<string>, found array<string>")
    got = sorted((x.k, x.type, x.first, x.last) for x in entity_spans(df, "k", "truth").collect())
    assert got == sorted((k, *e) for k, t, _ in rows for e in plain(t))
    want: dict = {}
    for _, t, f in rows:
        a, b = Counter(plain(t)), Counter(plain(f))
        for (kind, *_), n in list((a & b).items()):
            want.setdefault(kind, [0, 0, 0])[0] += n
        for (kind, *_), n in list((b - a).items()):
            want.setdefault(kind, [0, 0, 0])[1] += n
        for (kind, *_), n in list((a - b).items()):
            want.setdefault(kind, [0, 0, 0])[2] += n
    want["micro"] = [sum(v[i] for v in want.values()) for i in range(3)]
    rows_ = {x.type: x for x in entity_metric(df, "k", "truth", "found").collect()}
    assert {k: [x.tp, x.fp, x.fn] for k, x in rows_.items()} == want
    m = rows_["micro"]
    assert abs(m.f1 - 2 * m.precision * m.recall / (m.precision + m.recall)) < 1e-12
    none = entity_metric(df.where("k = 901"), "k", "truth", "found").collect()
    assert [(x.type, x.tp, x.f1) for x in none] == [("micro", 0, 0.0)]

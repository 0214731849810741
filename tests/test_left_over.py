"""Pairing of registered units, whole scopes at a time, against a plain model, and the units that it leaves over."""

import random

import pyarrow as pa

from tallyloom.plans import matching, sync

FIELDS = ("no_plat", "kontak_driver", "driver")


def plain(rows):
    """rows of one scope: (old, seq, *FIELDS), incoming ones first. Pairs of seqs and scores, as each existing row takes the best."""
    taken, out = set(), []
    for old, seq, *own in rows:
        scores = [(-sum(w for w, a, b in zip((4, 3, 2), own, theirs) if a == b), i) for i, (was, _, *theirs) in enumerate(rows) if old and not was and i not in taken]
        if scores and min(scores)[0] < 0:
            taken.add(min(scores)[1])
            out.append((seq, rows[min(scores)[1]][1], -min(scores)[0]))
    return out


def test_pairs_equal_a_plain_model_whatever_the_batches():
    rng, rows, want = random.Random(7), [], []
    for scope in [None, *(f"s{i:03}" for i in range(120))]:
        few, n = rng.choice((2, 3, 40)), rng.choice((0, 1, 3, 6))
        mine = [(old, len(rows) + 100 * old + i, *(f"{rng.randrange(few)}" for _ in FIELDS)) for old in (False, True) for i in range(rng.choice((n, 2)))]
        want += [(scope, *x) for x in plain(mine)]
        rows += [{"_scope": scope, "_old": m[0], "_seq": m[1], **{f"_{c}": v for c, v in zip(FIELDS, m[2:])}} for m in mine]
    table = pa.Table.from_pylist(rows)
    for size in (1, 3, 7, 1000):
        got, scopes = [], []
        for part in matching.whole_scopes(table.to_batches(max_chunksize=size)):
            column = {c: part.column(c).to_pylist() for c in ("_scope", "_seq")}
            scopes += sorted(set(column["_scope"]), key=str)
            got += [(column["_scope"][i], column["_seq"][i], column["_seq"][j], s) for i, j, s in zip(*(x.tolist() for x in matching.found_again(part)))]
        assert sorted(got, key=str) == sorted(want, key=str) and len(scopes) == len(set(scopes))


def test_left_over_units_keep_their_columns_and_are_not_joined_back(spark):
    schema = "k string, seq long, driver string, no_plat string, kontak_driver string, note array<int>"
    stored = spark.createDataFrame([("o", 1, "ani", "B 1 X", "0811", []), (None, 2, "ani", "B 1 X", "0811", [])], schema)
    told = spark.createDataFrame([("o", 11, "Ani ", "b-1-x", "0811", [1]), ("o", 12, "ani", "B 1 X", "0811", [2]), ("o", 13, "ci", "B 9 Z", "-", [3]), (None, 14, "ani", "B 1 X", "0811", [4]), ("p", 15, "ani", "B 1 X", "0811", None)], schema)
    left = sync.unmatched_units(told, stored, "k")
    assert left.columns == told.columns
    assert sorted((r.seq, r.k, r.note) for r in left.collect()) == [(12, "o", [2]), (14, None, [4]), (15, "p", None)]
    assert sync.unmatched_units(told.where("false"), stored.where("false"), "k").count() == 0
    assert "Join" not in left._jdf.queryExecution().executedPlan().toString()

"""Collocations against counting all runs of words, and automata against sets of end places."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm.phrases import Automaton, collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, size string, f string, n string, pair string"


def plain(rows, depth, least, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        longer = [c for (g, q), c in found.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * c >= share * a for c in longer):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    got, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return got


def texts(seed):
    r = random.Random(seed)
    words = ["a", "B", "é", "new", "york", "city", "x*", "\u0085", "zz"]
    some = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b"]) for _ in range(k))
    rows = [(r.choice(["en", "en", "de", None, "und"]), some(r.randint(0, 60))) for _ in range(60)]
    return rows + [("en", None), (None, None), ("fr", ""), ("en", "New York City hall " * 400), rows[0], rows[0], ("xx", "lonely")]


def of(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "s", "f", "n", "q") for i, (g, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,least,top", [(1, 5, 2000), (2, 3, 7), (3, 30, 2000)])
def test_collocations_match_counting(spark, seed, least, top):
    rows = texts(seed)
    got = [tuple(r) for r in collocations(of(spark, rows), least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == plain(rows, 4, least, top, 80)


def test_no_rows(spark):
    assert collocations(of(spark, [])).collect() == []
    assert collocations(of(spark, [("en", None), (None, "")])).collect() == []


def test_states_are_classes_of_end_places():
    r = random.Random(4)
    for _ in range(60):
        n, depth = r.randint(0, 30), r.randint(1, 5)
        words = np.array([r.randrange(3) for _ in range(n)], np.int64)
        joined = np.array([i > 0 and r.random() < 0.85 for i in range(n)], bool)
        places: dict = {}
        for i in range(n):
            for k in range(1, depth + 1):
                if k > 1 and not (i - k + 2 > 0 and joined[i - k + 2]):
                    break
                places.setdefault(tuple(words[i - k + 1 : i + 1]), set()).add(i)
        classes: dict = {}
        for s, ends in places.items():
            classes.setdefault(frozenset(ends), []).append(s)
        want = {max(c, key=len): (len(min(c, key=len)), len(ends)) for ends, c in classes.items()}
        reach = np.array([min(i - max(j for j in range(i + 1) if not joined[j]) + 1, depth) for i in range(n)], np.int64)
        a = Automaton(words, reach)
        name = lambda j: tuple(words[a.end[j] - a.longest[j] + 1 : a.end[j] + 1])
        assert {name(j): (a.shortest[j], a.count[j]) for j in range(len(a.end))} == want
        for j, up in enumerate(a.link):
            tail = name(j)[len(name(j)) - a.shortest[j] + 1 :]
            assert (up == -1 and not tail) or name(up) == tail
        e, k, c = a.strings()
        assert {tuple(words[x - y + 1 : x + 1]): z for x, y, z in zip(e, k, c)} == {s: len(p) for s, p in places.items()}


def test_a_crowded_bitmap_lets_more_through_but_counts_right(spark):
    rows = texts(7)
    got = [tuple(r) for r in collocations(of(spark, rows), least=6, depth=5, bits=64).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == plain(rows, 5, 6, 2000, 80)

"""The ten operators against plain versions on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, ftrl, licenses
from tallyloom.llm.bpe import encode_corpus, encoding
from tallyloom.llm.graph import components
from tallyloom.llm.jaccard import jaccard_components, keep_one_of_each
from tallyloom.llm.kernels import shingle_sets
from tallyloom.llm.mixing import fit_rates, mix, rates, take_mix
from tallyloom.llm.search import exact_top_k
from tallyloom.llm.sketch import compare_versions, digests, likeness
from tallyloom.llm.suffix import RepeatIndex, SuffixLevels, common, cut_repeats, remove_repeats
from tallyloom.llm.tokenfile import read_tokens, write_tokens
from tallyloom.llm.toxicity import drop_toxic, held_out, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, key string, bucket string, id string, h string"


def table(spark, rows):
    """Documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "b", "i", "h") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() + r.choice(["", "", ",", ".\n"]) for _ in range(k))
    passage, base = text(120), [word() for _ in range(90)]
    rows = [(i, text(r.randint(1, 150))) for i in range(n)]
    rows += [(n + i, text(20) + passage + text(20)) for i in range(6)]
    for i in range(40):  # near copies: all near the base, many not near each other
        copy = list(base)
        for k in r.sample(range(90), 2):
            copy[k] = word()
        rows.append((n + 10 + i, " ".join(copy)))
    rows += [(n + 60, " ".join(base)), (n + 61, " ".join(base)), (n + 62, ""), (n + 63, None), (n + 64, " \n\t"), (None, "a b c d e f"), (None, None)]
    rows += [(n + 65, "x y"), (n + 66, "X  y"), (n + 67, "aaaa" * 500), (n + 68, "ab" * 900), (n + 69, rows[3][1]), rows[3], (5, "another text of one id")]
    rows += [(n + 70, "long " * 30000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def plain_components(rows, words=5):
    """By comparing all pairs."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard(docs, rows, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == plain_components(rows)
    assert jaccard_components(empty).count() == 0


def test_jaccard_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [str(r.random()) for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        copy = list(base)
        for k in r.sample(range(60), r.choice([1, 1, 2])):
            copy[k] = str(r.random())
        rows.append((i, " ".join(copy)))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == plain_components(rows)


def test_links_between_unlike_members_of_a_group(spark, monkeypatch):
    """Documents of one template in several components, of several sizes: all links come out of the blocks of step 4."""
    from tallyloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(9)
    common, rows = [f"c{i}" for i in range(40)], []
    for k in range(40):  # kinds with endings of their own and of several lengths; two or three of each kind are near
        own = [f"k{k}w{i}" for i in range(r.choice([9, 14, 30]))]
        for _ in range(r.randint(1, 3)):
            w = common[r.randint(0, 2) :] + own
            if r.random() < 0.5:
                w = w[: -r.randint(1, 3)]
            rows.append((len(rows), " ".join(w)))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == plain_components(rows)


def test_keep_one(docs, rows):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in plain_components(rows) if d is not None and n}
    got = [r.doc_id for r in kept.collect()]
    alone = [d for d, t in rows if d is None or not (t or "").strip()]
    assert sorted(map(str, got)) == sorted(map(str, [*want, *alone]))


def test_keep_one_text_of_each_component(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    near = lambda t: t + " end"
    rows = [(1, one), (1, two), (2, near(one)), (3, near(two)), (4, two), (1, one), (5, "c d e f g h"), (5, "c d e f g h"), (6, ""), (None, one)]
    got = corpus_pipeline.without_near_copies(spark, table(spark, rows), "")
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(1, one), (1, two), (5, "c d e f g h"), (6, ""), (None, one)], key=str)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300, 300)] + [(400 + i, 401 + i) for i in range(50)] + [(999, i) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def plain_repeats(texts, size):
    places = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - size + 1):
            places.setdefault(t[j : j + size], []).append((i, j))
    gone = [np.zeros(len(t), bool) for t in texts]
    for p in places.values():
        if len(p) > 1:
            for i, j in p:
                gone[i][j : j + size] = True
    return gone


def test_suffix(docs, rows, empty):
    texts = [(t or "").encode() for _, t in rows]
    gone = plain_repeats(texts, 400)
    want = []
    for (d, _), t, g in zip(rows, texts, gone):
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        want.append((d, len(t), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0 and remove_repeats(empty).count() == 0
    gone = plain_repeats(texts, 250)
    shorter = cut_repeats(docs, 250)
    assert shorter.columns == docs.columns
    kept = {(d, t and bytes(np.frombuffer(t.encode(), np.uint8)[~g]).decode("utf-8", "ignore")) for (d, t), g in zip(rows, gone)}
    got = shorter.collect()
    assert len(got) == len(rows) and {(r.doc_id, r.text) for r in got} == kept


def test_suffix_levels():
    """Against plain comparison: batches of byte strings with long common parts, ordered and merged."""
    r = random.Random(2)
    for size in (5, 16, 100):
        family, texts, out, owners = SuffixLevels(), [], [], {}
        base = bytes(r.choice(b"ab\0") for _ in range(400))
        for _ in range(12):
            starts, at, own, parts = [], 0, [], []
            for _ in range(r.randint(1, 4)):
                i, n = r.randrange(200), r.randint(size, 2 * size + 60)
                t = bytearray(base[i : i + n].ljust(n, b"z"))
                for _ in range(r.randint(0, 2)):
                    t[r.randrange(n)] = r.choice(b"abc")
                texts.append(bytes(t)), parts.append(bytes(t))
                for k in range(n - size + 1):
                    owners[len(owners)] = (len(texts) - 1, k)
                    starts.append(at + k), own.append(len(owners) - 1)
                at += n
            data = np.frombuffer(b"".join(parts), np.uint8)
            out.append(family.add(data, size, np.array(starts), np.array(own), np.zeros(len(own), bool)))
        got = {owners[i] for i in np.concatenate([*out, family.repeated()]).tolist()}
        said = [texts[i][k : k + size] for i, k in owners.values()]
        assert got == {o for o, x in zip(owners.values(), said) if said.count(x) > 1}
        sizes = [len(x.at) for x in family.levels]
        assert all(b * 2 <= a for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(set(said))
        for level in family.levels:
            strings = [level.data[a : a + size].tobytes() for a in level.at.tolist()]
            assert strings == sorted(strings)
            depth = common(level, level.at[:-1], level, level.at[1:]).tolist()
            assert depth == [next(k for k in range(size) if x[k] != y[k]) for x, y in zip(strings, strings[1:])]


def test_repeat_index(spark):
    """Batches come one after the other: what a batch has in common with an earlier one is found, and levels of like size merge."""
    row = "fp long, sh long, n long, eid long, lo int, hi int"
    batch = lambda rows: spark.createDataFrame(rows, row)
    index, sizes = RepeatIndex(spark), []
    for rows in (
        [(1, 10, 1, 0, 0, 5), (2, 20, 1, 0, 6, 9), (3, 30, 1, 1, 0, 4), (3, 31, 1, 1, 5, 6)],  # 3 is unlike within the batch
        [(4, 40, 1, 2, 0, 5), (4, 40, 1, 3, 0, 5), (2, 21, 1, 3, 6, 9), (6, 60, 1, 3, 10, 12)],  # 4 agrees within, 2 is unlike the first batch's
        [(1, 10, 1, 4, 7, 12)],  # agrees with the first batch's: nothing new
        [(5, 50, 2, 5, 0, 1)],  # an exact copy of a text
        [(7, 70, 1, 6, 0, 1), (8, 80, 1, 6, 2, 3)],
    ):
        index.add(batch(rows))
        sizes.append([n for _, n in index.levels])
    assert sizes == [[4], [4, 3], [7], [7, 1], [7, 1, 2]]
    index.add(batch([(9, 90, 1, 7, 0, 1)]))
    assert [n for _, n in index.levels] == [7, 3, 1]
    again, unlike = index.matches()
    assert sorted(map(tuple, again.collect())) == [(1, 10), (4, 40), (5, 50)] and sorted(r.fp for r in unlike.collect()) == [2, 3]
    assert {(r.fp, r.sh, r.own.eid) for r in index.spans().collect()} == {(1, 10, 0), (2, 20, 0), (3, 30, 1), (3, 31, 1), (4, 40, 2), (2, 21, 3), (6, 60, 3), (5, 50, 5), (7, 70, 6), (8, 80, 6), (9, 90, 7)}
    index.close()


def test_hot_anchors(spark, monkeypatch):
    """A passage among unlike neighbours, by the path of anchors with very many spans."""
    from tallyloom.llm import suffix

    r = random.Random(6)
    noise = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passage, short = noise(700), noise(390)
    rows = [(i, noise(r.randint(0, 300)) + passage[r.randint(0, 50) :] + noise(50) + short + noise(r.randint(0, 300))) for i in range(30)]
    rows += [(100, rows[0][1]), (101, "q" + rows[1][1] + "q")]
    gone = plain_repeats([t.encode() for _, t in rows], 400)
    want = {d: (int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum())) for (d, _), g in zip(rows, gone)}
    for hot in (2, 1000):
        monkeypatch.setattr(suffix, "HOT", hot)
        assert {x.doc_id: (x.n_removed, x.n_spans) for x in remove_repeats(table(spark, rows)).collect()} == want


CLASHES = "_h long, _id string, _th string, _n int, _k int, _i int, lo long, hi long, whole boolean, th string, row string, copies int, root long, shard int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), 7, "a", "b", 3, 4, 5, 6, 8, True, "c", "r", 9, 10, 11) for i, t in rows], "doc_id long, text string, n_chars long, " + CLASHES)


def test_clashing_columns(spark, rows):
    """Columns of the operators' own names come through as they were."""
    some = [r for r in rows if r[0] is not None][:70] + [(0, rows[0][1])]
    df, own = clashing(spark, some), ["_h", "_id", "_th", "_n", "_k", "_i", "lo", "hi", "whole", "th", "row", "copies", "root", "shard"]
    domain = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i, _ in some], "doc_id long, domain string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i, _ in some], "doc_id long, quality int, toxic int")
    for out in (cut_repeats(df, 250), keep_one_of_each(df), keep_one_of_each(df, by_text=True), take_mix(df, mix(df, domain, {"good": 0.5, "poor": 0.5})), drop_toxic(df, marks)):
        assert out.columns == df.columns and out.schema == df.schema
        got = out.collect()
        assert got and all(tuple(r[c] for c in own) == (7, "a", "b", 3, 4, 5, 6, 8, True, "c", "r", 9, 10, 11) for r in got)
    for out in (remove_repeats(df), jaccard_components(df), score_toxicity(df, marks), licenses.scan_licenses(df), compare_versions(df)):
        assert out.count() == len(some)


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = encoding(path, public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = [tuple(r) for r in encode_corpus(docs, path, public_tokenizers.PATTERN, digests=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_corpus(empty, path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    more = rows + [(1000, "a <|endoftext|> b")]
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for d, t in sorted(more, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = write_tokens(table(spark, more), path, 2)
    assert sorted((tuple(r) for r in read_tokens(manifest).collect()), key=str) == sorted(want, key=str)
    some = read_tokens(manifest, [1000, 7], with_ids=True).collect()
    assert sorted(r.doc_id for r in some) == [7, 1000]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in some)
    assert read_tokens(write_tokens(empty, path, 2)).count() == 0
    # a damaged frame is noticed
    name = manifest.orderBy("part").first().file.removeprefix("file://").removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    data[len(data) // 3] ^= 0xFF
    open(name, "wb").write(data)
    with pytest.raises(Exception):
        read_tokens(manifest).collect()


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, pieces = {}, lambda t: set(digests([t.encode()])[1].tolist())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = compare_versions(docs).collect()
    assert len(got) == len(rows) and compare_versions(empty).count() == 0
    for i, (d, t) in enumerate(order):
        t, x = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + x[:k]
        want.setdefault((d, hashlib.sha256(e.encode()).hexdigest()), []).append((len(t), like(pieces(t), pieces(e)), like(pieces(t), pieces(x))))
    for r in got:
        n, a, b = want[(r.doc_id, r.edited_sha256)].pop()
        assert r.n_chars == n and math.isclose(r.near_edited, a) and math.isclose(r.near_next, b)
    prints = {}
    texts = dict((d, t) for d, t in rows if d is not None and d != 5)
    for r in got:
        if r.doc_id in texts:
            prints.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({*map(tuple, prints.values())}) > 50


def test_likeness_retries():
    r = np.random.default_rng(1)
    sets = [(np.unique(r.integers(1, 900, n)), np.unique(r.integers(1, 900, m))) for n, m in ((0, 0), (0, 5), (400, 400), (3, 3), (700, 2))]
    sides = [tuple(np.concatenate(x) for x in zip(*((np.full(len(s[k]), i), s[k].astype(np.uint64)) for i, s in enumerate(sets)))) for k in (0, 1)]
    want = [len({*a} & {*b}) / len({*a} | {*b}) if len({*a} | {*b}) else 1.0 for a, b in ((x.tolist(), y.tolist()) for x, y in sets)]
    assert np.allclose(likeness(*sides, len(sets)), want)


def test_top_k(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(0, 0.2, 12).astype(float).tolist(), 0) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1], 0) for i in range(60)] + [vectors[7]]
    vectors += [(2000, None, 0), (2020, [float("nan")] * 12, 0), (2021, [None] + [0.1] * 11, 0), (None, [0.1] * 12, 0), (2040, [], 0), (2041, [0.5], 0), (2042, [float("inf")] + [0.0] * 11, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, shard int")
    usable = {i: [math.floor(64 * x) for x in v] + [0] * (12 - len(v)) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in usable:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in exact_top_k(df, F.col("vec_id") % 20 == 0).collect()) == sorted(want)
    assert exact_top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert exact_top_k(df.where("vec_id in (20, 21)"), F.col("vec_id") % 20 == 0).count() == 1


def test_threshold_stops_early():
    """Reading stops at the first of the growing depths at which the bound allows it; on vectors that stand out that is early."""
    from tallyloom.llm.search import Shard

    r = np.random.default_rng(0)
    v = r.integers(-5, 5, (3000, 4))
    v[17] = v[18] = [900, 900, 900, 900]
    shard = Shard(np.arange(3000), v, 1)
    assert [(q, i.tolist(), d) for q, i, _, d in shard.search(np.array([18]), v[[18]], 1)] == [(0, [17], 8)]
    # a few directions with most of the weight, as trained vectors have them, and none, as the test tables' vectors have
    kinds = {"decaying": r.normal(0, 1, (4000, 64)) * 0.5 ** np.arange(64), "even": r.normal(0, 1, (4000, 64))}
    depths = {}
    for name, x in kinds.items():
        x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
        shard, ids = Shard(np.arange(4000), x, 20), np.arange(0, 4000, 100)
        depths[name] = []
        for q, found, scores, depth in shard.search(ids, x[ids], 20):
            every = x @ x[ids[q]]
            order = [i for i in np.lexsort((np.arange(4000), -every)) if i != ids[q]][:20]
            assert found.tolist() == order and scores.tolist() == every[order].tolist()
            depths[name].append(depth)
            if depth < 4000:  # the depth before did not allow it
                half, query = depth // 2, x[ids[q]]
                lists = np.sort(x, 0)
                seen = ((x >= lists[-half]) & (query > 0) | (x <= lists[half - 1]) & (query < 0)).any(1)
                bound = np.maximum(query, 0) @ lists[-half] + np.minimum(query, 0) @ lists[half - 1]
                assert half < 8 or np.sort(np.where(seen & (np.arange(4000) != ids[q]), every, -(10**9)))[-20] <= bound
    assert np.mean(np.array(depths["decaying"]) <= 1024) > 0.5 and np.mean(np.array(depths["even"]) < 4000) > 0.9


def test_chat(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "hi <|im_end|> \\e \\p"), (1, 2, "assistant", "<|im_start|>x\\"), (2, 0, "assistant", "first"), (3, 1, "user", None), (3, 0, None, "no role")]
    rows += [(4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (None, None, "us\ner\\l", "\\l\n<|"), (5, 0, "user", "é" * 50000), (5, 1, "assistant", "😀" * 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert len(got) == 6
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0), ro or "", te or "") for i, t, ro, te in rows if i == c)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r.valid} == {1, 5}
    assert chat.chat_digests(df.where("false")).count() == 0
    whole = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert whole[1].formatted.startswith("<|im_start|>system\nbe good<|im_end|>\n<|im_start|>user\n")
    assert all("".join(s.text for s in r.segments) == r.formatted for r in whole.values())


def test_licenses(spark, tmp_path):
    import duckdb

    texts = ["Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0! y", "CC-BY-NC and cc by nc cc by nc", None, "", "under the mit licensed", "Under\nthe, MIT*license", "é under the mit license é"]
    texts += ["this work is licensed under the GNU general public license version", "redistribution and use in source and binary forms, with or without modification, are permitted", "this work is licensed", "word " * 20000 + "cc by nc"]
    texts += ["# Redistribution and use in source and binary forms,\n# with or without modification,\n# are permitted", "under the\nMIT. License", "Permission is hereby granted, free of charge, to any person\nobtaining a copy"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    df = table(spark, rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.execute(licenses.oracle()).df()[names].astype(object)
    want = [tuple(None if x != x else x for x in map(lambda v: v if v is not None and str(v) != "<NA>" else None, r)) for r in want.itertuples(index=False)]
    got = [tuple(r) for r in licenses.scan_licenses(df).select(names).collect()]
    assert sorted(got, key=str) == sorted(((int(a) if a is not None else None, *map(lambda v: int(v) if isinstance(v, (np.integer, int)) else v, b)) for a, *b in want), key=str)
    by = {r[0]: r for r in got}
    assert by[0][5] == "mit" and by[1][5] == "apache-2" and by[2][2] == 3 and by[8][6] == "gpl-3" and by[9][6] == "bsd" and by[10][6] == "" and by[7][3] == 1
    assert licenses.scan_licenses(df.where("false")).count() == 0


def plain_licenses(text):
    """The templates' labels and the largest share, by every line, sentence and run of words against every template."""
    words = lambda t: [w for w in re.split(licenses.GAPS, t.translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if w]
    whole, labels, share = words(text), set(), 0.0
    blocks = [set(words(b)) for b in re.split(licenses.BLOCKS, text)]
    for t, label in licenses.TEMPLATES.items():
        n, want = len(t.split()), set(t.split())
        for block in blocks + [set(whole[i : i + n]) for i in range(len(whole))]:
            if len(block & want) >= math.ceil(licenses.THRESHOLD * len(want) - 1e-9):
                labels.add(label)
                share = max(share, len(block & want) / len(want))
    return ",".join(sorted(labels)), share


def test_wrapped_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"
    gpl = "This work is licensed under the GNU General Public\nLicense, version 3"
    texts = [bsd, gpl, f"x {bsd}\nprovided that\n{gpl}. The end", gpl.replace("\n", " one two three four five six seven eight nine ten eleven\n"), "Mozilla\nPublic\nLicense\nVersion\n2.0", None, ""]
    r = random.Random(4)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.split()})
    for _ in range(120):
        w = []
        for _ in range(r.randint(1, 4)):
            t = [x for x in r.choice(list(licenses.TEMPLATES)).split() if r.random() > 0.12]
            w += [r.choice(vocabulary + ["é", "other"]) for _ in range(r.randint(0, 6))] + [x.upper() if r.random() < 0.1 else x for x in t]
        texts.append("".join(x + r.choice([" ", " ", " ", "\n", ". ", ", "]) for x in w))
    got = {x.doc_id: x for x in licenses.scan_licenses(table(spark, enumerate(texts))).collect()}
    assert [got[i].labels for i in range(7)] == ["bsd", "gpl-3", "bsd,gpl-3", "", "mpl-2", "", ""]
    for i, text in enumerate(texts):
        labels, share = plain_licenses(text or "")
        base = got[i].base_labels.split(",") if got[i].base_labels else []
        assert got[i].labels == ",".join(sorted({*base, *labels.split(",")} - {""}))
        assert got[i].score == (1.0 if base else share)


def labelled_corpus(n=1200, seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [word() for _ in range(r.randint(5, 60))]
        if bad:
            for x in r.sample(["vile", "rotten", "nasty"], 2):
                w[r.randrange(len(w))] = x
        rows.append((i, " ".join(w) + (" %%%" if i % 4 == 1 else "")))
        labels.append((i, int(i % 4 != 1), int(bad)))
    return rows, labels


def test_toxicity(spark, empty):
    rows, labels = labelled_corpus()
    extra = rows + [(5000, None), (5001, ""), (None, "vile rotten"), rows[0]]
    df, marks = table(spark, extra), spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(df, marks).collect()
    assert len(got) == len(extra)
    truth = {i: t for i, _, t in labels}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert len(same) == 1
    kept = drop_toxic(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert {r.score for r in score_toxicity(df, marks.where("false")).collect()} == {0.5}
    assert score_toxicity(empty, marks).count() == 0
    # labels of held-out rows change nothing
    other = marks.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, score_toxicity(df, other).collect())) == sorted(map(str, got))


def plain_features(text, gaps=False):
    """The features of ftrl.features() as they are, not hashed."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", low)]
    w = [low[a:b] for a, b in spans]
    out = [("word", x) for x in w] + [("part", x[: ftrl.STEM]) for x in w if len(x) > ftrl.STEM]
    for gap in (1, 2):
        out += [(gap, x, y) for x, y in zip(w, w[gap:])]
    if gaps:
        ends = [a for a, _ in spans[1:]] + [len(low)]
        out += [("part", low[b:e]) for (_, b), e in zip(spans, ends)]
    return {*out}, len(w)


def plain_ftrl(examples, classes, epochs=ftrl.EPOCHS, alpha=0.3, beta=1.0, l1=4.0, l2=1.0):
    """FTRL-proximal by the book on dictionaries, a coordinate at a time. Returns a function from features to probabilities."""
    z, n = [{} for _ in range(classes)], [{} for _ in range(classes)]

    def weight(k, f):
        x = z[k].get(f, 0.0)
        shrink = 0.0 if f == "bias" else l1
        return 0.0 if abs(x) <= shrink else -(x - math.copysign(shrink, x)) / ((beta + math.sqrt(n[k].get(f, 0.0))) / alpha + l2)

    squash = lambda s: 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))
    for _ in range(epochs):
        for fs, y in examples:
            for k in range(classes):
                w = {f: weight(k, f) for f in [*fs, "bias"]}
                g = squash(sum(w.values())) - y[k]
                for f, v in w.items():
                    old = n[k].get(f, 0.0)
                    z[k][f] = z[k].get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * v
                    n[k][f] = old + g * g
    return lambda fs: [squash(sum(weight(k, f) for f in [*fs, "bias"])) for k in range(classes)]


def learning_order(spark, ids):
    return [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i"), "i").collect()]


def test_scores_match_plain_ftrl(spark):
    """op1's scores and op4's posteriors against FTRL on features that are not hashed (2^20 coordinates: few meet by chance)."""
    rows, labels = labelled_corpus(240, 4)
    rows = [(i, t + (" Vile, Naïve-ROTTEN!" if i % 7 == 0 else "")) for i, t in rows] + [(900, None), (901, "")]
    texts, df = dict(rows), table(spark, rows)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    toxic = {i: float(t) for i, _, t in labels if i not in held}
    plain = plain_ftrl([(plain_features(texts[i])[0], [toxic[i]]) for i in learning_order(spark, toxic)], 1)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(df, marks).collect()}
    off = [abs(got[i] - plain(plain_features(t)[0])[0]) for i, t in rows]
    assert np.median(off) < 1e-5 and np.mean(np.array(off) < 1e-4) > 0.97  # two features of one coordinate move a text or two
    domain = {i: "good" if q else "poor" for i, q, _ in labels}
    plain = plain_ftrl([(plain_features(texts[i], True)[0], [float(domain[i] == d) for d in ("good", "poor")]) for i in learning_order(spark, domain)], 2)
    known = spark.createDataFrame(sorted(domain.items()), "doc_id long, domain string")
    members = {r.doc_id: r for r in mix(df, known, {"good": 0.5, "poor": 0.5}).collect()}
    off = []
    for i, t in rows:
        fs, words = plain_features(t, True)
        p = np.array(plain(fs))
        assert members[i].n_tokens == words
        off.append(np.abs(np.array(members[i].p) - p / p.sum()).max())
    assert np.median(off) < 1e-5 and np.mean(np.array(off) < 1e-4) > 0.97


def test_one_text_of_an_id_is_learnt(spark):
    """Where two rows share an id, the least text counts, whatever the order of the rows."""
    rows, labels = labelled_corpus(200, 2)
    twice = rows + [(i, "zzz vile " + t) for i, t in rows[:40]]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in score_toxicity(table(spark, x).repartition(k), marks).collect()) for x, k in ((twice, 3), (twice[::-1], 5)))
    assert a == b


def test_ftrl_is_sparse():
    model = ftrl.Ftrl(1)
    r = np.random.default_rng(0)
    for k in range(400):
        f = np.append(r.integers(100, 50000, 30), 7 if k % 2 else 8)
        model.learn(np.unique(f), np.array([float(k % 2)]))
    w = model.weights(np.arange(ftrl.DIMS))[:, 0]
    assert w[7] > 0.5 and w[8] < -0.5 and np.count_nonzero(w) < 200


def test_mixing(spark, empty):
    rows, labels = labelled_corpus()
    df = table(spark, rows + [(9000, None), rows[1]])
    domain = spark.createDataFrame([(i, "good" if q else "poor") for i, q, _ in labels], "doc_id long, domain string")
    weights = {"good": 0.9, "poor": 0.1}
    got = mix(df, domain, weights, "good").collect()
    p, t, rate = np.array([r.p for r in got]), np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    reached, own = (rate * t) @ p, t @ p
    assert np.allclose(reached, [own[0], own[0] / 9], rtol=1e-3) and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    truth = {i: q for i, q, _ in labels}
    assert np.mean([(r.p[0] > 0.5) == truth.get(r.doc_id, 1) for r in got]) > 0.9
    taken = take_mix(df, mix(df, domain, weights, "good"))
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in got)
    assert mix(empty, domain, weights, "good").count() == 0


def test_rates_match_plain_projected_gradient(spark):
    """Where targets ask for negative rates, the squares are as small as slow projected gradient makes them."""
    r = np.random.default_rng(3)
    p = r.dirichlet([0.4, 0.4, 0.4], 80)
    t = r.integers(1, 50, 80)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    for targets in ([900.0, 300.0, 10.0], [0.0, 0.0, 700.0], [2000.0, 1500.0, 1800.0]):
        steps = fit_rates(df, np.array(targets))
        found = np.sum(((rates(p, steps) * t) @ p - targets) ** 2)
        x, a = np.ones(80), p * t[:, None]
        lip = np.linalg.norm(a.T @ a, 2)
        for _ in range(20000):
            x = np.maximum(0, x - a @ (x @ a - targets) / lip)
        least = np.sum((x @ a - targets) ** 2)
        assert found <= 1.05 * least + 1e-4 * np.sum(np.square(targets)), (targets, found, least)


def test_shingles_of_short_texts():
    a, b, c, d = shingle_sets([b"x y", b"X\t y", b"", b"xy"])
    assert a.tolist() == b.tolist() != d.tolist() and len(c) == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled_corpus(400)
    passage = " ".join(f"w{i}" for i in range(120))
    rows += [(1000 + i, f"{r[1]} {passage} {r[1][::-1]}") for i, r in enumerate(rows[1:4])] + [(2000, rows[2][1]), (2001, None), (2002, "vile rotten nasty")]
    df = table(spark, rows)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "encoding"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.collect()})
    assert 2002 not in seen[0] and {2, 2000} <= seen[0] and 2 in seen[1] and 2000 not in seen[1]
    cut = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert all("w60" not in cut[i] for i in (1000, 1001, 1002) if i in cut)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == seen[-1] <= seen[2]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in final.collect())


def test_repeats_are_found_among_neighbours_in_the_array():
    """Equal strings stand side by side in the sorted suffixes; one of each stays, with the first one's owner."""
    from tallyloom.llm.suffix import Suffixes

    r = random.Random(1)
    for _ in range(150):
        size, letters = r.choice([1, 3, 8, 9, 16, 20]), r.choice([b"a", b"ab"])
        data = np.frombuffer(bytes(r.choice(letters) for _ in range(r.randint(size, 200))), np.uint8)
        starts = np.array(sorted(r.sample(range(len(data) - size + 1), r.randint(1, len(data) - size + 1))))
        known = np.array([r.random() < 0.1 for _ in starts])
        array, again = Suffixes.of(data, size, starts, np.arange(len(starts)), known)
        strings, met = [data[a : a + size].tobytes() for a in starts], {}
        for i, s in enumerate(strings):
            met.setdefault(s, []).append(i)
        assert [data[a : a + size].tobytes() for a in array.at] == sorted(met)
        assert array.owners.tolist() == [met[s][0] for s in sorted(met)] and sorted(again) == sorted(i for x in met.values() for i in x[1:])
        assert array.seen.tolist() == [len(met[s]) > 1 or bool(known[met[s]].any()) for s in sorted(met)]


def test_levels_merge_within_the_query(docs, monkeypatch):
    merges, merge = [], RepeatIndex._merge

    def counted(index):
        before = len(index.levels)
        merge(index)
        merges.append(before - len(index.levels))

    monkeypatch.setattr(RepeatIndex, "_merge", counted)
    remove_repeats(docs, 40, 16).count()
    assert len(merges) == 4 and sum(merges) > 0

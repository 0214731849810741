"""Tags from spans, label ids of one length, variations that keep tags and tokens together."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import alignment, vary

TYPES = "id long, tokens array<struct<token string, start int, stop int>>, spans array<struct<label string, start int, stop int>>"


def plain_tags(tokens, spans):
    tags = ["O"] * len(tokens or [])
    for label, a, b in spans or []:
        inside = [i for i, (_, x, y) in enumerate(tokens or []) if None not in (x, y, a, b) and y > x and x >= a and y <= b]
        for n, i in enumerate(inside):
            tags[i] = f"{'I' if n else 'B'}-{label}"
    return tags


def test_alignment_equals_a_plain_loop(spark):
    r, rows = random.Random(5), []
    for i in range(300):
        tokens, at = [("[CLS]", 0, 0)], 0
        for _ in range(r.randrange(12)):
            at += r.choice([0, 0, 1, 3])
            width = r.randrange(1, 5)
            tokens.append((f"t{at}", at, at + width))
            if r.random() < 0.1:
                tokens.append((f"u{at}", at, at + width))  # two tokens of one character
            at += width
        tokens.append(("[SEP]", 0, 0))
        ends = [sorted((r.randrange(at + 3), r.randrange(at + 3))) for _ in range(r.randrange(4))]
        rows.append((i, tokens, [(r.choice("XYZ"), a, b) for a, b in ends]))
    rows += [(900, None, [("X", 0, 5)]), (901, [], None), (902, [("a", 0, 1)], None), (903, [("a", 0, 1), ("b", None, None)], [("X", 0, 9), ("Y", None, 4)])]
    got = {x.id: x.ner_tags for x in alignment.aligned(spark.createDataFrame(rows, TYPES).repartition(3)).collect()}
    assert got == {i: plain_tags(t, s) for i, t, s in rows}
    empty = alignment.aligned(spark.createDataFrame([], TYPES))
    assert empty.count() == 0 and alignment.vocabulary(empty) == ["O"]


def test_tokens_out_of_order_are_an_error(spark):
    df = spark.createDataFrame([(1, [("b", 5, 6), ("a", 0, 1)], [("X", 0, 9)])], TYPES)
    with pytest.raises(Exception, match="order of their places"):
        alignment.aligned(df).collect()


def test_words_and_tokenizers(spark):
    df = spark.createDataFrame([(1, "  satu  dua\ntiga é"), (2, ""), (3, None)], "id long, text string")
    got = {x.id: [tuple(t) for t in x.tokens] for x in alignment.tokenized(df).collect()}
    assert got == {1: [("satu", 2, 6), ("dua", 8, 11), ("tiga", 12, 16), ("é", 17, 18)], 2: [], 3: []}
    letters = alignment.tokenized(df, tokenizer=lambda texts: [[(c, i, i + 1) for i, c in enumerate(t)] for t in texts])
    assert {x.id: len(x.tokens) for x in letters.collect()} == {1: 18, 2: 0, 3: 0}


def test_label_ids_have_one_length(spark):
    df = spark.createDataFrame([(1, ["B-A", "O", "I-A"]), (2, []), (3, None), (4, ["O"] * 200), (5, ["I-A"] * 128)], "id long, ner_tags array<string>")
    names = alignment.vocabulary(df)
    assert names == ["O", "B-A", "I-A"]
    got = {x.id: x.v for x in df.select("id", alignment.label_ids(F.col("ner_tags"), names).alias("v")).collect()}
    assert got == {1: [1, 0, 2] + [-100] * 125, 2: [-100] * 128, 3: [-100] * 128, 4: [0] * 128, 5: [2] * 128}
    with pytest.raises(Exception, match="unknown tag [BI]-A"):
        df.select(alignment.label_ids(F.col("ner_tags"), ["O"])).collect()


def tagged(spark, n=60):
    rows = []
    for i in range(n):
        tokens = ["Lokasi", ":", f"G{i}", "x", "jam", ":", "8", ":", "TUJUAN", ":", "A", "-", "B", "lain", ":", "?", ":"]
        tags = ["O", "O", "B-ORIGIN", "I-ORIGIN", "O", "O", "B-TIME", "O", "O", "O", "B-DESTINATION", "I-DESTINATION", "I-DESTINATION", "O", "O", "B-OTHER", "O"]
        rows.append((i, tokens, tags, " ".join(tokens), "extra"))
    return spark.createDataFrame(rows, "id long, tokens array<string>, ner_tags array<string>, original_text string, variant string")


def test_variants_keep_tags_and_places(spark):
    df = tagged(spark).drop("variant")
    first = {x.id: x for x in df.collect()}
    rows = vary.varied(df).collect()
    assert len(rows) == 3 * len(first) and sorted((x.id, x.tokens) for x in rows) == sorted((x.id, x.tokens) for x in vary.varied(df.repartition(7)).collect())
    said, kept = 0, 0
    for x in rows:
        o = first[x.id - (vary.ID_STEP if x.variant else 0)]
        assert len(x.tokens) == len(x.ner_tags) == len(x.from_places) and x.from_places == sorted(x.from_places) and set(x.from_places) == set(range(len(o.tokens)))
        assert x.original_text == " ".join(x.tokens)
        for p, (t, g) in enumerate(zip(o.tokens, o.ner_tags)):
            here = [(w, k) for w, k, q in zip(x.tokens, x.ner_tags, x.from_places) if q == p]
            kind = o.ner_tags[p + 1][2:] if t == ":" and p + 1 < len(o.tokens) and o.ner_tags[p + 1].startswith("B-") else None
            if here != [(t, g)]:
                assert x.variant and " ".join(w for w, _ in here) in vary.PHRASES[kind] and {k for _, k in here} == {"O"}
            if x.variant and kind in vary.PHRASES:
                said, kept = said + (here != [(t, g)]), kept + (here == [(t, g)])
    assert 0.4 < said / (said + kept) < 0.6
    assert vary.varied(df, seed=1).exceptAll(vary.varied(df)).count() > 0


def test_variants_of_odd_rows(spark):
    rows = [(1, None, ["O"], "t"), (2, ["a", ":"], ["O"], None), (3, [], [], ""), (4, [":", None, ":", "b"], ["O", "B-DRIVER", None, None], "x")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, ner_tags array<string>, original_text string")
    got = {(x.id, x.variant): x for x in vary.varied(df).collect()}
    assert len(got) == 12 and got[1, 0].tokens == [] and got[2, 0].tokens == ["a"] and got[3 + vary.ID_STEP, 1].tokens == []
    assert got[4, 0].tokens == [":", None, ":", "b"] and got[4, 0].ner_tags == ["O", "B-DRIVER", None, None]
    assert vary.varied(df.where("false")).count() == 0


def test_shuffle_is_one_order(spark):
    df = tagged(spark).select("id")
    rows = df.union(df).union(spark.createDataFrame([(None,)], "id long"))
    a = [(x.place, x.id) for x in vary.shuffled(rows, ["id"]).orderBy("place").collect()]
    assert [p for p, _ in a] == list(range(1, 122)) and a == [(x.place, x.id) for x in vary.shuffled(rows.repartition(9), ["id"]).orderBy("place").collect()]
    assert [i for _, i in a] != sorted((i for _, i in a), key=lambda i: (i is not None, i))
    assert [(x.place, x.id) for x in vary.shuffled(rows, ["id"], seed=7).orderBy("place").collect()] != a
    assert vary.shuffled(rows.where("false"), ["id"]).count() == 0


def test_annotator_and_tokenizer_see_some_hundred_texts_at_a_time(spark):
    """A batch's tuples are not held at once; null texts are empty."""
    from tallyloom.plans import annotate

    def some(texts):
        assert len(texts) <= 256
        return [[("A", 0, len(t), t, 0.5)] if t else [] for t in texts]

    def words(texts):
        assert len(texts) <= 256
        return [[(t, 0, len(t))] for t in texts]

    rows = spark.range(1000).coalesce(1).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("text"))
    got = alignment.tokenized(annotate.annotate(rows, extractor=some), tokenizer=words).orderBy("id").collect()
    assert [[tuple(s) for s in r["spans"]] for r in got] == [[("A", 0, len(str(i)), str(i), 0.5)] if i % 10 else [] for i in range(1000)]
    assert [[tuple(s) for s in r["tokens"]] for r in got] == [[(t := str(i) if i % 10 else "", 0, len(t))] for i in range(1000)]

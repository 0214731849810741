"""License scans: an exact set-similarity join of text blocks with templates; DataFrame functions only.

A block is a line or sentence, or as many words in a row as the template has, whatever stands between them: notices are often
hard-wrapped.  A template is found in a block when the block's words hold at least the share THRESHOLD of the
template's distinct words.  The words are ordered by their number of places in the whole table, rare ones first.  A template must
then meet a block on one of its first n - ceil(THRESHOLD * n) + 1 words (prefix filter); the block needs as many words as the
threshold asks (length filter); what both have left from the place of the first meeting on must suffice (positional filter); the
rest is verified.  Words in a row are compared, without a join, where a text holds enough words of the template.  The templates are a constant of some hundred words, so they are broadcast.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_columns

THRESHOLD = 0.8
#: Phrases whose places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
    "the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
    "appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
#: What stands between words, either case; what stands between blocks.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCKS = r"\n|[.!?] "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text with one space between."""
    return F.trim(F.regexp_replace(text, GAPS, " "))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def places(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively. (The array meets itself shifted: a lambda must not refer to it, or it is made anew at each word.)"""
    parts = phrase.split()
    rows = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(len(parts))))

    def here(w, i):
        test = F.lit(True)
        for k, x in enumerate(parts):
            test = test & (F.coalesce(w[f"w{k}"], F.lit("")) == x)
        return F.when(test, i)

    return F.filter(F.transform(rows, here), lambda i: i.isNotNull())


def _any_of(words: list[str]) -> str:
    """A pattern for any of these words, whole and in either case."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return rf"(?i)(?<!{word})(?:{'|'.join(sorted(words))})(?!{word})"


def _templates(spark: SparkSession, counts: dict[str, int], templates: dict[str, str], threshold: float) -> DataFrame:
    """token, label, t (the template's words in the order), size, need, at: a row for each word of a prefix."""
    rows = []
    for text, label in templates.items():
        t = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = ceil(threshold * len(t) - 1e-9)
        rows += [(t[i], label, t, len(t), need, i) for i in range(len(t) - need + 1)]
    return spark.createDataFrame(rows, "token string, label string, t array<string>, size int, need int, at int")


def _in_a_row(text: Column, templates: dict[str, str], vocabulary: list[str], threshold: float) -> Column:
    """array<struct<label, share>>: the templates found in windows of their own length over all words of a text. Windows start at a word
    of the template, as any other finds no more than the next of these. (Arrays are bound by lambdas, so that each is made once.)"""
    once = lambda c, body: F.get(F.transform(F.array(c), body), 0)
    heard = F.transform(F.split(lowered(spaced(text)), " "), lambda w, i: F.struct(i.alias("i"), w.alias("w")))

    def one(hits: Column, own: Column, t: str, label: str) -> Column:
        width, words = len(t.split()), sorted(set(t.split()))
        need, wanted = ceil(threshold * len(words) - 1e-9), F.array(*map(F.lit, words))

        def window(x, j):
            near = F.filter(F.slice(hits, j + 1, F.lit(width)), lambda y: y["i"] < x["i"] + width)
            shared = F.size(F.array_intersect(F.transform(near, lambda y: y["w"]), wanted))
            return F.when(x["w"].isin(words), once(shared, lambda n: F.when(n >= need, F.struct(F.lit(label).alias("label"), (n / len(words)).alias("share")))))

        none = F.array().cast("array<struct<label:string,share:double>>")
        return F.when(F.size(F.array_intersect(own, wanted)) >= need, F.array_distinct(F.array_compact(F.transform(hits, window)))).otherwise(none)

    def every(hits: Column) -> Column:
        return once(F.array_distinct(F.transform(hits, lambda x: x["w"])), lambda own: F.flatten(F.array(*(one(hits, own, t, label) for t, label in templates.items()))))

    return once(F.filter(heard, lambda x: x["w"].isin(vocabulary)), every)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns a row for each row: doc_id, n_words, n_base (long: places of the phrases),
    first_word, last_word (long: their least and greatest start, else null), base_labels, labels (string: distinct, sorted, joined by
    commas; labels has the join's too), score (double: the largest share of a template found, 1 with a phrase, else 0).

    Null and empty texts have no words, labels '' and score 0. Rows that repeat get equal results; null doc_ids are kept.
    """
    spark = docs.sparkSession
    docs = keep_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    vocabulary = sorted({w for t in templates for w in t.split()})

    # the places of the templates' words in all texts
    every = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_any_of(vocabulary)), F.lit(0))).alias("token"))
    counts = {r.token: r["count"] for r in every.groupBy(F.lower("token").alias("token")).count().collect()}
    prefixes = _templates(spark, counts, templates, threshold)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    least = min(ceil(threshold * len(set(t.split())) - 1e-9) for t in templates)

    # a text without any word of a prefix has no block to look at
    rare = sorted({r.token for r in prefixes.select("token").distinct().collect()})  # a constant's words
    likely = keyed.where(F.col("text").rlike(_any_of(rare)))
    blocks = likely.select("id", "h", F.explode(F.split("text", BLOCKS)).alias("block")).where(F.length("block") >= 2 * least - 1)
    words = blocks.select("id", "h", "block", F.array_distinct(F.split(lowered(spaced(F.col("block"))), " ")).alias("words")).where(F.size("words") >= least)
    met = words.select("id", "h", "block", "words", F.explode("words").alias("token")).join(F.broadcast(prefixes), "token").where(F.size("words") >= F.col("need"))
    exact = F.split(lowered(spaced(F.col("block"))), " ")
    mine = F.array_intersect(F.array(*map(F.lit, order)), exact)  # the block's words of the vocabulary, in the order
    met = met.select("id", "h", "label", "t", "size", "need", "at", "token", mine.alias("mine"))
    place = F.array_position("mine", F.col("token"))
    near = met.where((place > 0) & (F.size("mine") - place + 1 >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))
    shared = F.size(F.array_intersect("mine", "t"))
    found = near.select("id", "h", "label", (shared / F.col("size")).alias("share"), shared.alias("shared"), "need").where("shared >= need")
    wrapped = likely.select("id", "h", F.explode(_in_a_row(F.col("text"), templates, vocabulary, threshold)).alias("x"))
    found = found.select("id", "h", "label", "share").union(wrapped.select("id", "h", "x.label", "x.share"))
    found = found.groupBy("id", "h").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    plain = keyed.select("id", "h", "doc_id", spaced("text").alias("line"))
    test = "(?i)(?:^| )(?:" + "|".join(phrases) + ")(?: |$)"
    plain = plain.select(
        "id", "h", "doc_id",
        F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(F.col("line").rlike(test), F.split(lowered(F.col("line")), " ")).alias("words"),
    )
    plain = plain.select("id", "h", "doc_id", "n_words", *(F.when(F.col("words").isNotNull(), places(F.col("words"), p)).alias(f"p{i}") for i, p in enumerate(phrases)))
    at = [F.coalesce(f"p{i}", F.array().cast("array<int>")) for i in range(len(phrases))]
    starts = F.concat(*at)
    base = F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, phrases.values()))))
    plain = plain.select("id", "h", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), base.alias("base"))
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return plain.join(found, ["id", "h"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(labels).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by plain comparison of every line, sentence and run of words with every template, in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))}, {len(t.split())})" for i, (t, label) in enumerate(templates.items()))
    said = ", ".join(f"('{label}', {p.split()})" for p, label in phrases.items())
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
), phrases(label, p) AS (VALUES {said}), templates(k, label, t, width) AS (VALUES {rows}), places AS (
  SELECT r, label, i - 1 AS place FROM (SELECT r, words, label, p, unnest(range(1, len(words) - len(p) + 2)) AS i FROM w, phrases)
  WHERE words[i] = p[1] AND words[i : i + len(p) - 1] = p
), base AS (
  SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS labels FROM places GROUP BY r
), blocks AS (
  SELECT r, list_distinct(regexp_extract_all(translate(block, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words
  FROM (SELECT r, unnest(regexp_split_to_array(text, '\n|[.!?] ')) AS block FROM d)
), said AS (SELECT k, width, len(t) AS size, label, unnest(t) AS word FROM templates), heard AS (
  SELECT r, i, words[i] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), hits AS (SELECT r, k, i, word, width, size, label FROM heard JOIN said USING (word)
), met AS (
  SELECT r, label, len(list_intersect(words, t)) AS n, len(t) AS size FROM blocks, templates
  UNION ALL SELECT a.r, a.label, count(DISTINCT b.word), a.size FROM hits a JOIN hits b ON a.r = b.r AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.width - 1 GROUP BY a.r, a.k, a.i, a.label, a.size
), found AS (SELECT r, list(DISTINCT label) AS labels, max(n / size) AS share FROM met WHERE n >= ceil({threshold} * size - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       CASE WHEN coalesce(base.n, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(found.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""

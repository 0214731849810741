"""Collocations: phrases of a few words, counted through generalised suffix automata, a shard of texts each.

A state of a suffix automaton is a class of strings that end at the same places; its suffix link leads to the longest ending of these
strings that stands at more places. The links form a tree: that of the reversed contexts, in which the context of a place grows to the
left. Of automata of bounded depth that tree is built directly, a depth at a time, over all places of a shard at once: `Automaton`.
Counts of places go up the links; a state stands for all endings of its longest string that are longer than the link's.

Counts of shards meet by sums. As a frequent phrase has frequent parts, passes before count words and pairs, then each longer size short of
the last, by hashes, each only where the sizes before are frequent; the automata then hold no context that cannot be frequent. What tells
frequent hashes is a bitmap of fixed size a pass, which only ever lets more through, so counts are exact at every size of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, arrow_map, column, cut, drop_shuffles, keep_columns, sliced, width
from .kernels import LOWER, U64, combine, encode, mix, prefix_sums, range_hash, runs

#: Bits of a pass's bitmap, and of one of the blocks in which it is put together.
BITS, BLOCK = 1 << 26, 32768
#: What ends a piece, and what ends a word beside that.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
STOPS = ENDS.copy()
STOPS[[0x20, 0x09]] = True


class Shard:
    """The words of texts of one language: hashes, pieces and bytes, in order of place. A text ends a piece."""

    def __init__(self, texts: list[bytes], lang: str):
        self.bytes = b"\n".join(t.translate(LOWER) for t in texts) + b"\n"
        data = np.frombuffer(self.bytes, np.uint8)
        self.starts, self.ends = runs(~STOPS[data])
        self.hashes = range_hash(prefix_sums(data), self.starts, self.ends) if len(self.starts) else np.empty(0, U64)
        self.salt = mix(np.array([hash_of(lang)], U64))[0]
        piece = np.cumsum(ENDS[data])[self.starts] if len(self.starts) else np.empty(0, np.int64)
        first = np.ones(len(piece), bool)
        first[1:] = piece[1:] != piece[:-1]
        at = np.arange(len(piece))
        self.nth = at - np.maximum.accumulate(np.where(first, at, 0)) + 1 if len(piece) else at  # of its piece

    def grams(self, size: int) -> np.ndarray:
        """Hashes of every `size` words in a row, whether or not a piece ends within; the i-th ends at word i + size - 1."""
        return combine(self.hashes ^ self.salt, size) & U64((1 << 63) - 1)

    def reach(self, depth: int, known: dict) -> np.ndarray:
        """Of each word the most words, at most depth, that end with it in its piece and whose runs of a known size are all set in its bitmap."""
        reach, fits = np.zeros(len(self.nth), np.int64), np.ones(len(self.nth), bool)
        for d in range(1, depth + 1):
            before = np.append(False, fits[:-1]) if d > 1 else fits
            fits = fits & before & (self.nth >= d)
            if d in known and len(fits) >= d:
                slot = (self.grams(d) % U64(8 * len(known[d].value))).astype(np.int64)
                fits[d - 1 :] &= (known[d].value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            reach[fits] = d
        return reach

    def numbers(self) -> tuple[np.ndarray, list[str]]:
        """Numbers of the words in some order, by their bytes, and the words by number."""
        words = pa.array([self.bytes[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())], pa.binary()).dictionary_encode()
        return words.indices.to_numpy().astype(np.int64), [w.decode("utf-8", "replace") for w in words.dictionary.to_pylist()]


def hash_of(lang: str) -> int:
    data = np.frombuffer(encode(lang) + b" ", np.uint8)
    return int(range_hash(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


class Automaton:
    """The generalised suffix automaton of sequences of numbers, bounded in depth.

    words: numbers of at least 0; reach: of each place the length of its longest context. Of each state but the root: longest and
    shortest, the lengths of its strings; end, a place where they end; count, of such places; link, a state's number or -1 for the root.
    """

    def __init__(self, words: np.ndarray, reach: np.ndarray):
        depth = int(reach.max(initial=0))
        node = np.full(len(words), -1, np.int64)  # of the context of the depth so far
        context, ends, lengths, parents, counts, total = words.copy(), [], [], [], [], 0
        for d in range(1, depth + 1):
            here = np.flatnonzero(reach >= d)
            if not len(here):
                break
            # a context of d words: the one of d - 1 that ends at the same place, and the word before it
            key = words[here] if d == 1 else context[here] * (int(words.max()) + 1) + words[here - d + 1]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            parents.append(node[here[first]])
            ends.append(here[first])
            lengths.append(np.full(len(first), d))
            counts.append(np.bincount(inverse[reach[here] == d], minlength=len(first)))
            node[here] = inverse + total
            context[here] = inverse
            total += len(first)
        empty = np.empty(0, np.int64)
        parent, end, length, count = (np.concatenate([empty, *x]) for x in (parents, ends, lengths, counts))
        for d in range(depth, 1, -1):  # the counts go up, from the deepest contexts
            deep = np.flatnonzero(length == d)
            np.add.at(count, parent[deep], count[deep])
        # a context at all places of its parent is of the parent's class: the class goes by its longest string
        same = (parent >= 0) & (count == np.where(parent >= 0, count[parent], -1))
        absorbed = np.zeros(total, bool)
        absorbed[parent[same]] = True
        shortest = length.copy()
        link = parent.copy()
        for d in range(2, depth + 1):
            here = np.flatnonzero(same & (length == d))
            shortest[here], link[here] = shortest[parent[here]], link[parent[here]]
        heir = np.arange(total)
        for d in range(depth, 1, -1):
            here = np.flatnonzero(same & (length == d))
            heir[parent[here]] = heir[here]
        state = np.flatnonzero(~absorbed)
        number = np.full(total, -1, np.int64)
        number[state] = np.arange(len(state))
        up = link[state]
        self.link = np.where(up >= 0, number[heir[up]], -1)
        self.longest, self.shortest, self.end, self.count = length[state], shortest[state], end[state], count[state]

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct string: a place where it ends, its length, its count."""
        of = np.repeat(np.arange(len(self.end)), self.longest - self.shortest + 1)
        first = np.cumsum(self.longest - self.shortest + 1) - (self.longest - self.shortest + 1)
        return self.end[of], self.shortest[of] + np.arange(len(of)) - first[of], self.count[of]


def _shards(batches):
    """The texts of a batch by language."""
    for batch in sliced(batches, limit=4 * CHUNK):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
            if text:
                by.setdefault(lang, []).append(encode(text))
        for lang, texts in by.items():
            yield lang, Shard(texts, lang)


def probable(docs: DataFrame, least: int, sizes: tuple[int, ...], known: dict, bits: int = BITS):
    """A broadcast of so many bits: those of the hashes of (lang, words in a row), of the given sizes, that occur `least` times or more are set.
    known: such broadcasts of smaller sizes, which tell where to count."""
    spark = docs.sparkSession

    def run(batches):
        for _, shard in _shards(batches):
            reach = shard.reach(max(sizes), known)
            hashes = [shard.grams(d)[reach[d - 1 :] >= d] for d in sizes if len(reach) >= d]
            if hashes:
                gram, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield {"gram": gram.astype(np.int64), "n": n}

    often = arrow_map(docs, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.col("gram") % bits
    blocks = often.groupBy(F.floor(bit / BLOCK).alias("block")).agg(F.bitmap_construct_agg(bit % BLOCK).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for block, part in blocks:
        here = out[block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        here[:] = np.frombuffer(part, np.uint8)[: len(here)]
    del often
    drop_shuffles(spark)
    return spark.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, depth: int, least: int, bits: int = BITS) -> DataFrame:
    """docs: lang (not null), text. Returns lang, phrase, size, f: phrases of at most `depth` words that occur `least` times or more,
    joined by spaces; and a row of size 0 a language, whose f is the number of all its words."""
    known = dict.fromkeys((1, 2), probable(docs, least, (1, 2), {}, bits))
    for d in range(3, depth):
        known[d] = probable(docs, least, (d,), known, bits)

    def run(batches):
        for lang, shard in _shards(batches):
            if not len(shard.starts):
                continue
            numbers, words = shard.numbers()
            ends, sizes, counts = Automaton(numbers, shard.reach(depth, known)).strings()
            ids = numbers.tolist()
            phrases = [words[ids[e]] if k == 1 else " ".join([words[i] for i in ids[e - k + 1 : e + 1]]) for e, k in zip(ends.tolist(), sizes.tolist())]
            yield {"lang": [lang] * (len(phrases) + 1), "phrase": ["", *phrases], "size": np.append(0, sizes), "f": np.append(len(numbers), counts)}

    counted = arrow_map(docs, run, "lang string, phrase string, size int, f long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, depth: int = 4, least: int = 30, top: int = 2000, share: int = 80, bits: int = BITS) -> DataFrame:
    """docs: text, lang, any other columns; a null text is empty, a null lang is `und`; rows that repeat count again.

    Phrases of 2 to `depth` words that occur at least `least` times, of each cut into two the one with the least score, but those that lie
    within a longer phrase of `share` per cent of their count. Returns of each lang the first `top` by score, a (both falling), phrase:
    lang, rank (from 1), phrase, size (words), k (words before the cut), a (count), l, r (counts of the cut's parts), n (all words of the
    lang), score = floor(2000000 * a / (l + r)).
    A phrase's f is at most that of its parts, so all of them are among the counted ones.
    """
    docs = keep_columns(docs, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und")))
    counted = cut(phrase_counts(docs, depth, least, bits))
    phrases = counted.where("size > 0")
    words = F.split("phrase", " ")
    found = phrases.where("size > 1")
    sides = found.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = sides.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("right"))
    of = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    sides = sides.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000BD) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = sides.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("cut"))
    # links: from a phrase to it without its first word, and, mirrored, without its last; counts fall along longer phrases, so one step tells
    link = F.explode(F.array(F.array_join(F.slice(words, F.lit(2), F.col("size")), " "), F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " ")))
    within = found.where("size > 2").select("lang", link.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(cut.a AS DECIMAL(20, 0)) * {share}")).select("lang", "phrase", "cut.*")
    # the first of each of many parts of a language come first, so that no task gets a language whole
    by, parts = "ORDER BY score DESC, a DESC, phrase", width(docs.sparkSession)
    kept = kept.withColumn("at", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {parts}) {by})")).where(F.col("at") <= top).drop("at")
    ranked = kept.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {by}) AS BIGINT)")).where(F.col("rank") <= top)
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("size").cast("long").alias("size"), F.col("k").cast("long").alias("k"), "a", "l", "r", "n", "score")

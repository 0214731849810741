"""Texts that are alike by difflib's ratio, without comparing all of them: pieces of one side are looked for in the other.

Of two texts s and t a ratio of r says that r / 2 of their joint length stands in both, in one order. Then at most (1 - r) of the joint length
is to be deleted or inserted, which is at most c = 2 * (1 - r) / r of either text's own length n. Each such edit destroys at most one of the
n / q pieces of q letters that a text is cut into, and shifts what follows by one place. So of any d + 1 pieces (d = c * n edits) at least one
has not been destroyed, and stands in the other text, at most d places away. Pieces are as long as leaves d + 1 of them; the rarest are taken.
Only those places of the other side travel whose letters a bitmap of the pieces knows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import kept, released

#: Bits of the bitmap a piece, and at most (a broadcast of 32 MB); classes that places are counted by, to tell rare pieces.
BITS, MOST_BITS, CLASSES = 8, 1 << 28, 1 << 16
#: Texts that a Python worker takes at a time.
TEXTS = 2_000
ROWS = "gram long, id long, n int, at int"


def edits(least: float) -> tuple[float, int]:
    """Edits a character of either text that a ratio of `least` allows, and the length of pieces that does for all texts."""
    share = 2 * (1 - least) / least
    return share, max(1, math.ceil(1 / share - 1e-9) // 2)


def sizes(least: float) -> tuple[int, int, int]:
    """Lengths of pieces: q for texts below a length, a longer one from it on; and that length."""
    share, q = edits(least)
    longer = max(q, math.floor(1 / share + 1e-9) - 1)
    enough = lambda n: n // longer > math.floor(n * share + 1e-9)
    most = math.ceil(2 / (1 / longer - share)) + 1 if longer > q else 0  # from here on it holds
    return q, longer, next((n + 1 for n in range(most, 0, -1) if not enough(n)), 0) if longer > q else 0


def _grams(letters: np.ndarray, q: int) -> np.ndarray:
    """Hashes of every q letters in a row."""
    n = len(letters) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, q, np.uint64)
    for k in range(q):
        out += letters[k : k + n] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x7FB5D329728EA185)
    return out ^ (out >> np.uint64(29))


def _parts(least: float, whole: bool):
    """A function from a text's letters to (hashes, places): of the pieces that it is cut into, or of all its places where a piece of a text
    of fitting length can stand."""
    share, _ = edits(least)
    q, longer, border = sizes(least)

    def run(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(letters)
        if not whole:
            size = longer if n >= border else q
            at = np.arange(0, n - size + 1, size) if n * share + 1e-9 >= 1 else np.empty(0, np.int64)
            return _grams(letters, size)[at], at
        kinds = {longer} if longer == q else {x for x, met in ((longer, n * (2 - least) / least + 1e-9 >= border), (q, n * least / (2 - least) - 1e-9 < border)) if met}
        found = [_grams(letters, x) for x in sorted(kinds)]
        return np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])

    return run


def _letters(batches):
    """(id, letters) of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield key, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _rows(texts: DataFrame, choose) -> DataFrame:
    """texts: id, text. Rows of what choose(letters) gives: hashes and places."""
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def run(batches):
        waiting, held = [], 0

        def out():
            columns = [np.concatenate(c) for c in zip(*waiting)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *(pa.array(c.astype(t), t) for c, t in zip(columns[1:], ("int64", "int32", "int32")))], schema=schema)

        for key, letters in _letters(batches):
            grams, at = choose(letters)
            if len(grams):
                waiting.append((grams, np.full(len(grams), key), np.full(len(grams), len(letters)), at))
                held += len(grams)
            if held > 50_000:
                yield out()
                waiting, held = [], 0
        if waiting:
            yield out()

    return texts.mapInArrow(run, ROWS)


def _counts(texts: DataFrame, least: float) -> np.ndarray:
    """How many places there are of each class of hashes."""
    every = _parts(least, True)

    def run(batches):
        counts = np.zeros(CLASSES, np.int64)
        for _, letters in _letters(batches):
            np.add.at(counts, (every(letters)[0] % np.uint64(CLASSES)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["c", "k"])

    found = texts.mapInArrow(run, "c long, k long").groupBy("c").agg(F.sum("k").alias("k")).toArrow()
    counts = np.zeros(CLASSES, np.int64)
    counts[found["c"].to_numpy()] = found["k"].to_numpy()
    return counts


def _bitmap(pieces: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of some n pieces."""
    size = min(MOST_BITS, 1 << max(16, (BITS * n - 1).bit_length()))
    place = F.col("gram").bitwiseAND(F.lit(size - 1)) + 1  # from 1, as buckets of bitmaps begin there
    found = pieces.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in zip(found["bucket"].to_pylist(), found["bits"].to_pylist()):
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return bits


def candidate_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs of a text of left (column a) and one of right (column b), each once, among which are all whose ratio reaches `least` (over 2 / 3).

    Both sides are made distinct and written once, as several passes read them. Equal texts are pairs whatever their length. Pieces are those
    of left. Joins are by shuffle: what is small as a compressed shuffle file need not be so in a driver that would broadcast it.
    """
    share, _ = edits(least)
    sc = left.sparkSession.sparkContext
    one, two = (kept(t.select(c).where(F.length(c) > 0).distinct()) for t, c in ((left, a), (right, b)))
    released(left.sparkSession)
    mine, theirs = (t.select(F.xxhash64(c).alias("id"), F.col(c).alias("text")) for t, c in ((one, a), (two, b)))
    counts, cut, every = sc.broadcast(_counts(theirs, least)), _parts(least, False), _parts(least, True)

    def rarest(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, at = cut(letters)
        often = counts.value[(grams % np.uint64(CLASSES)).astype(np.int64)]
        some = np.argsort(often, kind="stable")[: math.floor(len(letters) * share + 1e-9) + 1]
        return grams[some], at[some]

    pieces = _rows(mine, rarest)
    bits = sc.broadcast(_bitmap(pieces, one.agg(F.sum(F.floor(F.length(a) * share + 1e-9) + 1)).first()[0] or 0))

    def known(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams, at = every(letters)
        p = grams & np.uint64(8 * len(bits.value) - 1)
        some = np.flatnonzero(bits.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
        return grams[some], at[some]

    there = _rows(theirs, known).select("gram", F.col("id").alias("j"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    here = pieces.select("gram", F.col("id").alias("i"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    near = (F.abs(F.col("at1") - F.col("at2")) <= F.floor(F.least("n1", "n2") * share + 1e-9)) & fits(F.col("n1"), F.col("n2"), least)
    met = here.join(there.hint("merge"), "gram").where(near).select("i", "j").distinct()
    named = met.join(one.select(F.xxhash64(a).alias("i"), a).hint("merge"), "i").join(two.select(F.xxhash64(b).alias("j"), b).hint("merge"), "j").select(a, b)
    return named.unionByName(one.join(two.hint("merge"), one[a] == two[b]).select(a, b)).distinct()


def fits(n: Column, m: Column, least: float) -> Column:
    """Lengths between which a ratio of `least` is possible."""
    return 2 * F.least(n, m) >= least * (n + m) - 1e-9

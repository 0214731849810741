"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph here is a line, cut further after words that their hash picks (one in four), so that an edit within a long line changes
the pieces near it only.  A sketch has three parts of `cells` cells; each digest is put in one cell of each part: the cell counts it
and takes the exclusive or of digest and check.  Subtracting two sketches leaves what differs; peeling takes out cells that hold
one digest until all are empty.  If it gets stuck, sketches four times as large are made and tried, up to sizes where success is
all but sure; the last resort compares the digests.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, arrow_map, column, in_id_order, keep_columns, width
from .kernels import SPACES, U64, encode, mix, prefix_sums, range_hash, runs

CELLS = 8
PIECE_WORDS = 4
_CHECK = U64(0xA0761D6478BD642F)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and digests, both ascending, of the distinct paragraphs of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = runs(~SPACES[data])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, U64)
    sums = prefix_sums(data)
    lines = np.cumsum(data == 10)
    last = (range_hash(sums, starts, ends) % U64(PIECE_WORDS) == 0) | np.append(lines[starts[1:]] != lines[starts[:-1]], True)
    stops = np.flatnonzero(last)
    firsts = np.concatenate(([0], stops[:-1] + 1))
    h = range_hash(sums, starts[firsts], ends[stops])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts[firsts], "right")
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
    return owner[keep], h[keep]


class Sketches:
    """The sketches of `n` sets side by side."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * 3 * cells, np.int32)
        self.key = np.zeros(n * 3 * cells, U64)
        self.check = np.zeros(n * 3 * cells, U64)

    def put(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        spread, checks = mix(keys), mix(keys ^ _CHECK)
        for part in range(3):
            at = (owner * 3 + part) * self.cells + ((spread >> U64(21 * part)) & U64(self.cells - 1)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.n, out.count, out.key, out.check = self.n, self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many digests only the first and only the second set has, and which sketches came out empty."""
        first, second = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            at = at[mix(self.key[at] ^ _CHECK) == self.check[at]]
            if not len(at):
                break
            owner, keys, signs = at // (3 * self.cells), self.key[at], self.count[at]
            order = np.lexsort((keys, owner))
            owner, keys, signs = owner[order], keys[order], signs[order]
            one = np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])))
            owner, keys, signs = owner[one], keys[one], signs[one]
            first += np.bincount(owner[signs > 0], minlength=self.n)
            second += np.bincount(owner[signs < 0], minlength=self.n)
            self.put(owner, keys, -signs)
            spread = mix(keys)
            at = np.unique(np.concatenate([(owner * 3 + p) * self.cells + ((spread >> U64(21 * p)) & U64(self.cells - 1)).astype(np.int64) for p in range(3)]))
        shape = (self.n, 3 * self.cells)
        empty = ~(self.count.reshape(shape).any(1) | self.key.reshape(shape).any(1) | self.check.reshape(shape).any(1))
        return first, second, empty

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: its number of digests, then the cells."""
        rows = np.concatenate([x.view(np.uint8).reshape(self.n, -1) for x in (self.count, self.key, self.check)], 1)
        return [f"{self.cells}:{k}:{base64.b64encode(r.tobytes()).decode()}" for k, r in zip(sizes.tolist(), rows)]


def build(owner: np.ndarray, keys: np.ndarray, n: int, cells: int) -> Sketches:
    out = Sketches(n, cells)
    out.put(owner, keys, np.int32(1))
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> np.ndarray:
    """Jaccard similarity of the n pairs of digest sets, from what peeling the subtracted sketches recovers; 1 for two empty sets."""
    sizes = [np.bincount(x[0], minlength=n) for x in (a, b)]
    first, second, todo = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    floor = np.abs(sizes[0] - sizes[1])
    while todo.any():
        now = np.flatnonzero(todo & (floor * 2 <= 5 * cells))
        if len(now):
            number = np.full(n, -1)
            number[now] = np.arange(len(now))
            built = []
            for owner, keys in (a, b):
                sel = number[owner] >= 0
                built.append(build(number[owner[sel]], keys[sel], len(now), cells))
            f, s, ok = built[0].minus(built[1]).peel()
            first[now[ok]], second[now[ok]] = f[ok], s[ok]
            todo[now[ok]] = False
        cells *= 4
        if cells > 64 * (sizes[0] + sizes[1]).max() + 64:
            for i in np.flatnonzero(todo):
                x, y = a[1][a[0] == i], b[1][b[0] == i]
                shared = len(np.intersect1d(x, y))
                first[i], second[i] = len(x) - shared, len(y) - shared
            break
    union = sizes[0] + second
    return np.where(union > 0, (sizes[0] - first) / np.maximum(union, 1), 1.0)


def _compare(batches):
    """Rows in the order of bucket, id and text, each bucket followed by the next one's first row (last)."""

    def rows():
        before = None
        for batch in batches:
            for bucket, halo, doc_id, text in zip(*(column(batch, c).to_pylist() for c in ("bucket", "last", "doc_id", "text"))):
                text = (text or "").encode("utf-8", "replace").decode()
                if before is not None and before[0] == bucket and not before[1]:
                    yield before[2], before[3], text
                before = (bucket, halo, doc_id, text)

    def done(part):
        texts, following = [encode(t) for _, t, _ in part], [encode(x) for *_, x in part]
        edited = []
        for _, t, x in part:
            k = len(t) // 4
            edited.append(encode(t[: len(t) - k] + x[:k]))
        n = len(part)
        own, other, after = digests(texts), digests(edited), digests(following)
        prints = [build(*d, n, CELLS).texts(np.bincount(d[0], minlength=n)) for d in (own, other)]
        return {
            "doc_id": [i for i, *_ in part], "n_chars": [len(t) for _, t, _ in part], "edited_sha256": [sha256(e).hexdigest() for e in edited],
            "fingerprint": prints[0], "edited_fingerprint": prints[1], "near_edited": likeness(own, other, n), "near_next": likeness(own, after, n),
        }

    part, amount = [], 0
    for row in rows():
        part.append(row)
        amount += len(row[1]) + len(row[2])
        if amount > CHUNK:
            yield done(part)
            part, amount = [], 0
    if part:
        yield done(part)


def compare_versions(docs: DataFrame) -> DataFrame:
    """docs: doc_id long, text string, any other columns. Returns a row for each row: doc_id, n_chars (long), edited_sha256, fingerprint,
    edited_fingerprint (string), near_edited, near_next (double).

    The edited text has the last quarter of a text's characters replaced by the first as many (or all) of the next document's, in
    the order of doc_id (nulls first), then text; the first document follows the last, and a document alone follows itself.
    Null texts count as empty; the fingerprints of two empty texts are alike (1).
    """
    spark, n = docs.sparkSession, width(docs.sparkSession)
    docs = keep_columns(docs, "doc_id", "text").withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    dealt, _ = in_id_order(docs, "id")
    firsts = sorted((r.bucket, r.least) for r in dealt.groupBy("bucket").agg(F.min("id").alias("least")).collect())  # one row a bucket
    # each bucket's first id goes to the bucket before too
    goes = spark.createDataFrame([(least, firsts[k - 1][0]) for k, (_, least) in enumerate(firsts)], "id long, before int")
    both = dealt.join(F.broadcast(goes), "id", "left").withColumn("to", F.explode(F.array(F.struct("bucket", F.lit(False).alias("last")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("last")))))
    both = both.where("to.bucket is not null").select("to.bucket", "to.last", "id", "doc_id", "text")
    ordered = both.repartition(n, "bucket").sortWithinPartitions("bucket", "last", "id", F.col("text").asc_nulls_first())
    return arrow_map(ordered, _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Removal of every byte under a string of `size` bytes that also starts anywhere else, by a logarithmic family of suffix arrays.

1. Winnowing picks in each string of `size` bytes one anchor of GRAM bytes by the bytes alone, so equal strings have equal anchors at
   equal places.  The places of the anchors are the sampled suffixes: each run of string starts that share an anchor is one span.
2. The corpus comes in batches.  A batch's sampled suffixes, in the order of their anchors and then of their whole spans, are its
   array; it is merge-scanned against the levels that RepeatIndex keeps in the shared folder.  What a batch has in common with itself
   or a level comes out: spans that agree as a whole, and anchors that stand in unlike spans.  Levels of like size then merge.
3. Spans that agree as a whole repeat at all their places; their texts need not be looked at again.  Of unlike spans with one anchor
   each distinct one goes once to the anchor's task, where a family of full suffix arrays (every start, in the order of the bytes)
   tells by the longest common prefixes which strings stand in several.
4. An anchor with more than HOT distinct spans would fill one task: its strings are dealt by their own hashes and counted instead.

A suffix is told from another by its first `size` bytes: what counts is whether these agree.  Equality of ranges of bytes is that of
64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, clear, column, cut, drop_shuffles, keep_columns, shared_dir, sliced, tidied, width
from .kernels import U64, encode, prefix_sums, range_hash, range_value

SIZE = 400
#: Bytes of an anchor: long enough to be rare by chance, short enough to leave few anchors (one in (SIZE - GRAM) / 2 bytes).
GRAM = 64
#: Bytes of a text that are looked at together.
PIECE = 1 << 15
#: Distinct spans of an anchor that are compared in one task.
HOT = 1_000
#: Bytes of spans that make a batch of the family inside a task.
BATCH = 1 << 19
#: Batches in which a whole table is fed to the index: enough for levels to merge.
BATCHES = 4
_PLACE_BITS = 24


class Suffixes:
    """The suffixes of `data` that start at `starts` and have `size` bytes or more, in the order of those bytes.

    Of suffixes that agree, which stand side by side then, one stays in the array, with the owner of the first; `seen` tells whether it has
    been met again.
    """

    def __init__(self, data: np.ndarray, size: int, at: np.ndarray, owners: np.ndarray, seen: np.ndarray, sums: np.ndarray | None = None):
        self.data, self.size, self.at, self.owners, self.seen = data, size, at, owners, seen
        self.sums = prefix_sums(data) if sums is None else sums
        self.keys = self._first(at)

    def _first(self, at: np.ndarray) -> np.ndarray:
        return self.words(at) >> U64(8 * max(0, 8 - self.size))

    def words(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes at each place as a number that sorts as they do; zeros stand beyond the end."""
        if not hasattr(self, "_words"):
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._words = sum((padded[k : k + len(self.data) + 1].astype(U64) << U64(56 - 8 * k) for k in range(8)), np.zeros(len(self.data) + 1, U64))
        return self._words[at]

    @classmethod
    def of(cls, data: np.ndarray, size: int, starts: np.ndarray, owners: np.ndarray, known: np.ndarray) -> tuple[Suffixes, np.ndarray]:
        """The array, and the owners of suffixes that agree with an earlier one. known: met elsewhere already."""
        out = cls(data, size, starts, owners, known.astype(bool))
        order = out._sorted()
        out = out.only(order)
        # the scan: neighbours whose longest common prefix is the whole string are one
        new = np.ones(len(order), bool)
        new[1:] = common(out, out.at[1:], out, out.at[:-1]) < size
        heads = np.flatnonzero(new)
        seen = np.logical_or.reduceat(out.seen, heads) | (np.diff(heads, append=len(order)) > 1) if len(heads) else out.seen
        again = out.owners[~new]
        out = out.only(heads)
        out.seen = seen
        return out, again

    def _sorted(self) -> np.ndarray:
        """Order by eight bytes; then, while some are tied, by the eight bytes behind what all of a tied group have in common."""
        order = np.argsort(self.keys, kind="stable")
        key = self.keys[order]
        place = np.arange(len(order))
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        head = np.maximum.accumulate(np.where(new, place, 0)) if len(key) else place
        tied = place[np.bincount(head, minlength=len(head))[head] > 1] if len(head) else place
        while len(tied):
            group, at = head[tied], self.at[order[tied]]
            depth = common(self, at, self, self.at[order[group]])
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            depth = np.repeat(np.minimum.reduceat(depth, heads), np.diff(heads, append=len(tied)))
            apart = depth < self.size  # of the other groups all agree: the first one stays first
            tied, group, depth = tied[apart], group[apart], depth[apart]
            if not len(tied):
                break
            key = self.words(self.at[order[tied]] + depth) >> (8 * np.maximum(0, depth + 8 - self.size)).astype(U64)  # no byte beyond the string
            sub = np.lexsort((key, group))
            order[tied], key = order[tied][sub], key[sub]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
            heads = np.flatnonzero(new)
            times = np.diff(heads, append=len(tied))
            head[tied] = np.repeat(tied[heads], times)
            tied = tied[np.repeat(times > 1, times)]
        return order

    def locate(self, other: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of another array the place in this one before which it belongs, and whether the one there agrees with it."""
        low, high = np.searchsorted(self.keys, other.keys, "left"), np.searchsorted(self.keys, other.keys, "right")
        found = np.zeros(len(low), bool)
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            mine, theirs = self.at[mid], other.at[todo]
            depth = common(self, mine, other, theirs)
            same = depth == self.size
            here = np.minimum(depth, self.size - 1)
            less = ~same & (self.data[mine + here] < other.data[theirs + here])
            found[todo[same]] = True
            low[todo] = np.where(less, mid + 1, np.where(same, mid, low[todo]))
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[~same & (low[todo] < high[todo])]
        return low, found

    def only(self, sel: np.ndarray) -> Suffixes:
        out = Suffixes.__new__(Suffixes)
        out.__dict__.update(self.__dict__)
        out.at, out.owners, out.seen, out.keys = self.at[sel], self.owners[sel], self.seen[sel], self.keys[sel]
        return out

    def merged(self, other: Suffixes) -> Suffixes:
        """Both arrays' suffixes, none of which agree, in one array."""
        at, _ = self.locate(other)
        return Suffixes(
            np.concatenate([self.data, other.data]), self.size, np.insert(self.at, at, other.at + len(self.data)), np.insert(self.owners, at, other.owners), np.insert(self.seen, at, other.seen)
        )


def common(a: Suffixes, i: np.ndarray, b: Suffixes, j: np.ndarray) -> np.ndarray:
    """Longest common prefixes, up to `size`, of the suffixes that start at i and j."""
    out = np.zeros(len(i), np.int64)
    step = 1 << (a.size.bit_length() - 1)
    while step:
        todo = np.flatnonzero(out + step <= a.size)
        x, y = i[todo] + out[todo], j[todo] + out[todo]
        out[todo[range_value(a.sums, x, x + step) == range_value(b.sums, y, y + step)]] += step
        step >>= 1
    return out


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes; each distinct string stands in one of them."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def add(self, data: np.ndarray, size: int, starts: np.ndarray, owners: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Takes in a batch; returns those of its owners that repeat and are not kept (a string's first one is kept, see repeated())."""
        if not len(starts):
            return owners
        batch, again = Suffixes.of(data, size, starts, owners, known)
        out = [again]
        for level in self.levels:  # the merge scan
            at, hit = level.locate(batch)
            level.seen[at[hit]] = True
            out.append(batch.owners[hit])
            batch = batch.only(~hit)
        if len(batch.at):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1].at) * 2 > len(self.levels[-2].at):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1])]
        return np.concatenate(out)

    def repeated(self) -> np.ndarray:
        """The owners that are kept and whose strings have been met again."""
        return np.concatenate([np.empty(0, np.int64), *(x.owners[x.seen] for x in self.levels)])


class RepeatIndex:
    """The logarithmic family over batches: levels of sampled suffixes, written to a folder that driver and executors share.

    A level is a table of (fp, sh, n, own), one row for each distinct span: its anchor's hash, its own, how often it stood there, and
    the first place of it (entity, first and last start); it is sorted by fp and sh within partitions dealt by both.  add() takes in a
    batch, merge-scans it against all levels and writes what it met; what is new there (fresh) is a level.  Before a batch comes, levels merge as long as the
    last one has more than half the rows of the one before, so that there are logarithmically many.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
        self.levels: list[tuple[str, int]] = []
        self.scans: list[str] = []
        self.unlike: list[str] = []
        self._serial = 0

    def _write(self, rows: DataFrame) -> str:
        self._serial += 1
        path = f"{self.folder}/{self._serial}"
        rows.write.parquet(path)
        return path

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("fp long, sh long, n long, own struct<eid:long,lo:int,hi:int>, fresh boolean").parquet(*paths).where("fresh")

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][1] * 2 > self.levels[-2][1]:
            (a, m), (b, n) = self.levels[-2:]
            both = self._read(a, b).repartition(width(self.spark), "fp", "sh").sortWithinPartitions("fp", "sh")
            self.levels[-2:] = [(self._write(both), m + n)]

    def add(self, spans: DataFrame) -> None:
        """spans: fp, sh, n (copies of it), eid, lo, hi."""
        self._merge()
        rows = spans.select("fp", "sh", "n", F.struct("eid", "lo", "hi").alias("own"), F.lit(True).alias("fresh"))
        if self.levels:
            rows = rows.union(self._read(*(p for p, _ in self.levels)).withColumn("fresh", F.lit(False)))
        scan = rows.groupBy("fp", "sh").agg(F.sum("n").alias("n"), F.min("own").alias("own"), F.min("fresh").alias("fresh"), F.max("fresh").alias("met"))
        level = self._write(scan.where("met").drop("met").sortWithinPartitions("fp", "sh"))
        unlike = rows.groupBy("fp").agg(F.min("sh").alias("a"), F.max("sh").alias("b"), F.max("fresh").alias("met"))
        self.unlike.append(self._write(unlike.where("met and a < b").select("fp")))
        self.scans.append(level)
        if count := self._read(level).count():
            self.levels.append((level, count))

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """Spans (fp, sh) that stand at several places, and anchors (fp) that stand in several unlike spans; each once. Both are written, so
        that what joins them can split keys of very many places."""
        again = self.spark.read.schema("fp long, sh long, n long").parquet(*self.scans).where("n > 1").select("fp", "sh").distinct()
        unlike = self.spark.read.schema("fp long").parquet(*self.unlike).distinct()
        return self.spark.read.schema("fp long, sh long").parquet(self._write(again)), self.spark.read.schema("fp long").parquet(self._write(unlike))

    def spans(self) -> DataFrame:
        """All distinct spans: fp, sh, own."""
        if not self.levels:
            return self.spark.createDataFrame([], "fp long, sh long, own struct<eid:long,lo:int,hi:int>")
        return self._read(*(p for p, _ in self.levels)).select("fp", "sh", "own")

    def close(self) -> None:
        clear(self.spark, self.folder)


def pieces(texts: list[bytes], size: int, limit: int = PIECE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about `limit` bytes: their numbers, where in their text each part starts, and the parts.

    A long text comes in parts that overlap by size - 1 bytes, so that each string of `size` bytes stands in one part.
    """
    who, where, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - size + 1), limit):
            part = t[a : a + limit + size - 1]
            if len(part) < size:
                continue
            if total and total + len(part) > 2 * limit:
                yield who, where, parts
                who, where, parts, total = [], [], [], 0
            who.append(i), where.append(a), parts.append(part)
            total += len(part)
    if parts:
        yield who, where, parts


class Anchored:
    """The anchors of some parts: for each run of string starts lo..hi that share the anchor, its hash fp; places are in `data`."""

    def __init__(self, parts: list[bytes], size: int, gram: int):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.cumsum([0, *map(len, parts)])
        n = len(self.data)
        self.sums = prefix_sums(self.data)
        places = np.arange(n - gram + 1)
        h = range_hash(self.sums, places, places + gram)
        # the least hash of each window, of equal ones the last: the place counts down in the low bits
        low = (h & ~U64((1 << _PLACE_BITS) - 1)) | (U64((1 << _PLACE_BITS) - 1) - places.astype(U64))
        span, step = size - gram + 1, 1
        while step < span:
            by = min(step, span - step)
            low = np.minimum(low[:-by], low[by:])
            step += by
        anchor = ((1 << _PLACE_BITS) - 1 - (low & U64((1 << _PLACE_BITS) - 1)).astype(np.int64))
        ok = np.zeros(n, bool)
        for a, b in zip(self.at[:-1], self.at[1:]):
            ok[a : b - size + 1] = True
        starts = np.flatnonzero(ok[: len(anchor)])
        anchor = anchor[starts]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
        heads = np.flatnonzero(new)
        self.lo, self.hi = starts[heads], starts[np.append(heads[1:], len(starts)) - 1] if len(heads) else starts
        self.fp = h[anchor[heads]]
        self.part = np.searchsorted(self.at, self.lo, "right") - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as ascending maximal runs; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(order) else ends
    new = np.concatenate(([True], starts[1:] > ends[:-1])) if len(starts) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1] if len(heads) else ends


def _texts(batch) -> list[bytes]:
    return [encode(t) for t in column(batch, "text").to_pylist()]


def _anchors(size: int, gram: int):
    """Of each text the spans: their anchors' hashes, their own, and their first and last starts."""

    def run(batches):
        for batch in sliced(batches):
            texts = _texts(batch)
            out: list[list[list]] = [[[] for _ in texts] for _ in range(4)]
            for who, where, parts in pieces(texts, size):
                a = Anchored(parts, size, gram)
                own = range_hash(a.sums, a.lo, a.hi + size)
                shift = np.array(where)[a.part] - a.at[a.part]
                cuts = np.searchsorted(a.part, np.arange(len(parts) + 1))
                for k, i in enumerate(who):
                    s = slice(cuts[k], cuts[k + 1])
                    for to, x in zip(out, (a.fp.view(np.int64), own.view(np.int64), a.lo + shift, a.hi + shift)):
                        to[i].append(x[s])
            rows = [[np.concatenate(x[i]).astype(kind) if x[i] else np.empty(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.int32, np.int32))] for i in range(len(texts))]
            # spans that repeat within a text, as in periodic ones, go out once, and their places as intervals
            once = [np.unique(sh, return_index=True, return_inverse=True, return_counts=True) for _, sh, _, _ in rows]
            gone = [merged(lo[m].astype(np.int64), hi[m].astype(np.int64) + size) for (_, _, lo, hi), (_, _, group, times) in zip(rows, once) for m in [(times > 1)[group]]]
            yield {
                "id": column(batch, "id"), "th": column(batch, "th"), "n_bytes": [len(t) for t in texts],
                **{c: [r[k][first] for r, (_, first, _, _) in zip(rows, once)] for k, c in enumerate(("fps", "shs", "los", "his"))},
                "reps": [times.astype(np.int32) for *_, times in once], "gone_lo": [lo for lo, _ in gone], "gone_hi": [hi for _, hi in gone],
            }

    return run


def _spans(size: int):
    """Rows of texts with the spans that are to be compared. Yields them (kind 0) or, where the anchor is hot, their strings (kind 1: fp is
    the string's hash, lo where it starts)."""

    def run(batches):
        for batch in sliced(batches):
            for raw, eid, wanted in zip(_texts(batch), column(batch, "eid").to_pylist(), column(batch, "wanted").to_pylist()):
                cold = [w for w in wanted if not w["hot"]]
                n = len(cold)
                yield {
                    "kind": [0] * n, "eid": [eid] * n, "lo": [w["lo"] for w in cold], "hi": [w["hi"] for w in cold], "fp": [w["fp"] for w in cold],
                    "known": [w["known"] for w in cold], "span": [raw[w["lo"] : w["hi"] + size] for w in cold],
                }
                for w in wanted:
                    if w["hot"]:
                        sums = prefix_sums(np.frombuffer(raw, np.uint8, w["hi"] + size - w["lo"], w["lo"]))
                        at = np.arange(w["hi"] - w["lo"] + 1)
                        n = len(at)
                        yield {
                            "kind": np.ones(n, np.int32), "eid": np.full(n, eid), "lo": at + w["lo"], "hi": at + w["lo"], "fp": range_hash(sums, at, at + size).view(np.int64),
                            "known": np.full(n, w["known"]), "span": pa.nulls(n, pa.binary()),
                        }

    return run


def _scan(size: int):
    """Rows of spans, in the order of fp: yields the intervals under strings that repeat."""

    def run(batches):
        def intervals(owners):
            """owners: span number << 32 | start in the span."""
            owners = np.unique(owners)
            who, start = owners >> 32, owners & 0xFFFFFFFF
            keep = ~np.array([s[2] for s in spans], bool)[who]  # known ones go as a whole
            who, start = who[keep], start[keep]
            if not len(who):
                return None
            eid, base = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64)
            new = np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] > start[:-1] + size)))
            heads = np.flatnonzero(new)
            lasts = np.append(heads[1:], len(who)) - 1
            return {"eid": eid[who[heads]], "lo": (base[who] + start)[heads], "hi": (base[who] + start)[lasts] + size}

        family, spans, key, waiting, amount, pending = SuffixLevels(), [], None, [], 0, []

        def flush():
            nonlocal waiting, amount
            if waiting:
                sizes = np.array([len(raw) for raw, _ in waiting])
                at = np.cumsum(sizes) - sizes
                many = sizes - size + 1
                number = np.repeat([k for _, k in waiting], many)
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                known = np.array([spans[k][2] for _, k in waiting], bool)
                owners = (number.astype(np.int64) << 32) | offset
                pending.append(family.add(np.frombuffer(b"".join(raw for raw, _ in waiting), np.uint8), size, np.repeat(at, many) + offset, owners, np.repeat(known, many)))
                waiting, amount = [], 0

        for batch in batches:
            for fp, eid, lo, known, raw in zip(*(column(batch, c).to_pylist() for c in ("fp", "eid", "lo", "known", "span"))):
                if amount > BATCH:
                    flush()
                if fp != key and pending:  # strings of other anchors cannot agree with these: a new family
                    flush()
                    if out := intervals(np.concatenate([*pending, family.repeated()])):
                        yield out
                    family, spans, pending = SuffixLevels(), [], []
                key = fp
                spans.append((eid, lo, known))
                waiting.append((raw, len(spans) - 1))
                amount += len(raw)
        flush()
        if pending and (out := intervals(np.concatenate([*pending, family.repeated()]))):
            yield out

    return run


def _cut(text: bytes, whole: bool | None, lo: list | None, hi: list | None) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs went."""
    if whole:
        return b"", 1
    s, e = merged(np.array(lo or [], np.int64), np.array(hi or [], np.int64))
    view = memoryview(text)
    return b"".join([view[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)])]), len(s)


def _digests(batches):
    for batch in sliced(batches):
        texts = _texts(batch)
        kept = [_cut(t, *x) for t, *x in zip(texts, *(column(batch, c).to_pylist() for c in ("whole", "lo", "hi")))]
        yield {
            "doc_id": column(batch, "doc_id"), "n_bytes": [len(t) for t in texts], "n_removed": [len(t) - len(k) for t, (k, _) in zip(texts, kept)],
            "n_spans": [n for _, n in kept], "kept_sha256": [sha256(k).hexdigest() for k, _ in kept],
        }


def _decide(docs: DataFrame, size: int, gram: int, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text) with whole, lo, hi: whether all of a text goes, else the intervals that go; a row for each row."""
    spark, n = docs.sparkSession, width(docs.sparkSession)
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.md5(F.coalesce("text", F.lit(""))))
    texts = keyed.select("id", "th", "text")
    seen = arrow_map(texts, _anchors(size, gram), "id long, th string, n_bytes long, fps array<long>, shs array<long>, los array<int>, his array<int>, reps array<int>, gone_lo array<long>, gone_hi array<long>")
    # one entity for all rows of one text
    of_first = [F.any_value(c).alias(c) for c in ("n_bytes", "fps", "shs", "los", "his", "reps", "gone_lo", "gone_hi")]
    entities = cut(seen.groupBy("th").agg(F.count("*").alias("times"), F.min("id").alias("id"), *of_first)).withColumn("eid", F.monotonically_increasing_id())
    arrays = [F.col(f"{c}s").alias(c) for c in ("fp", "sh", "lo", "hi", "rep")]
    places = entities.select("th", "eid", "times", F.inline(F.arrays_zip(*arrays))).withColumn("n", F.col("times") * F.col("rep"))
    index = RepeatIndex(spark)
    for k in range(batches):
        index.add(places.where(F.pmod(F.xxhash64("th"), F.lit(batches)) == k).select("fp", "sh", "n", "eid", "lo", "hi"))
        drop_shuffles(spark)  # what the batch has to tell is written
    again, unlike = index.matches()
    agree = places.join(again, ["fp", "sh"], "left_semi").select("eid", "lo", (F.col("hi") + size).alias("hi"))

    compared = index.spans().join(unlike, "fp").join(again.withColumn("known", F.lit(True)), ["fp", "sh"], "left")
    many = cut(compared.groupBy("fp").count().where(F.col("count") > HOT).select("fp", F.lit(True).alias("hot")))  # written, so that a join splits it
    wanted = compared.join(many, "fp", "left").select("fp", "own.*", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = wanted.groupBy("eid").agg(F.collect_list(F.struct("lo", "hi", "fp", "known", "hot")).alias("wanted"))
    sources = wanted.join(entities.select("eid", "id", "th"), "eid")
    dealt = texts.join(sources, ["id", "th"]).dropDuplicates(["id", "th"])
    spans = cut(arrow_map(dealt, _spans(size), "kind int, eid long, lo long, hi long, fp long, known boolean, span binary"))
    cold = spans.where("kind = 0").select("fp", "eid", "lo", "known", "span").repartition(n, "fp").sortWithinPartitions("fp")
    found = arrow_map(cold, _scan(size), "eid long, lo long, hi long")
    hot = spans.where("kind = 1").select("fp", "eid", "lo", "known")
    twice = cut(hot.groupBy("fp").count().where("count > 1"))  # so that a join splits a string of very many places
    found = found.union(hot.where("not known").join(twice, "fp", "left_semi").select("eid", "lo", (F.col("lo") + size).alias("hi")))
    found = found.union(agree.select("eid", F.col("lo").cast("long"), F.col("hi").cast("long")))
    found = found.union(entities.select("eid", F.inline(F.arrays_zip(F.col("gone_lo").alias("lo"), F.col("gone_hi").alias("hi")))))
    intervals = cut(found.groupBy("eid").agg(F.collect_list(F.struct("lo", "hi")).alias("x")).select("eid", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")))
    index.close()
    decided = entities.join(intervals, "eid", "left").select("th", ((F.col("times") > 1) & (F.col("n_bytes") >= size)).alias("whole"), "lo", "hi")
    decided = decided.where("whole or lo is not null")
    decided = decided.withColumns({c: F.when(~F.col("whole"), F.col(c)) for c in ("lo", "hi")})
    # by document and not by text, so that a text of very many documents is no hot key of the large join
    decided = texts.select("id", "th").distinct().join(decided, "th").select("id", "th", "whole", "lo", "hi")
    return keyed.join(decided, ["id", "th"], "left").drop("id", "th")


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """docs: doc_id long, text string, any other columns.  Returns a row for each row: doc_id, n_bytes, n_removed, n_spans (long),
    kept_sha256 (string: of what is left).

    Each byte goes that is covered by a string of `size` bytes that also starts at another place of any row's text, the same one
    included; strings are judged on the input.  Null texts count as empty; texts under `size` bytes stay whole; rows that repeat
    (also of one doc_id) are texts of their own and so repeat each other; null doc_ids are kept.  An empty table gives an empty result.
    """
    decided = _decide(keep_columns(docs, "doc_id", "text"), size, gram)
    return arrow_map(decided, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, n_chars and any others, of whatever name) with what remove_repeats() leaves of the texts, characters that a cut
    has halved left out, and n_chars of that; all columns and rows stay, and null texts stay null."""
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    decided = _decide(docs.select("doc_id", "text", rows.alias("row")), size, gram)

    def run(batches):
        for batch in sliced(batches):
            raw = column(batch, "text").to_pylist()
            kept = [None if r is None else _cut(encode(r), *x)[0].decode("utf-8", "ignore") for r, *x in zip(raw, *(column(batch, c).to_pylist() for c in ("whole", "lo", "hi")))]
            new, row = {"text": pa.array(kept, pa.string()), "n_chars": pa.array([len(k or "") for k in kept], pa.int64())}, column(batch, "row")
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else x for f, x in zip(row.type, row.flatten())], [f.name for f in row.type])

    return decided.mapInArrow(tidied(run), docs.schema)

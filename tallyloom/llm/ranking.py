"""Ranks with ties within groups of any size, by a secondary sort.

Rows go to tasks by ranges of (group, pair, the rest of the order), cut at quantiles of a sample, so that a group, or one pair of it, that
holds a third of the table spreads over a third of the tasks. Each task sorts its rows and passes over them once with the state of a small
machine. What a task cannot know, the rows of its first group that lie in the tasks before and the ends of its first and last run of
equal pairs, is repaired from a summary of two rows a task.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, shared_dir, width

#: Rows of the sample for each task's share.
SAMPLE = 40
FIRST_GROUP, FIRST_RUN, LAST_RUN = 1, 2, 4
#: Kinds of rows that a task returns: kept ones, and what stands at its two ends.
KEPT, HEAD, TAIL = 0, 1, 2


class Key(NamedTuple):
    """A column of long values in an order; nulls are equal to each other."""

    name: str
    descending: bool = False
    nulls_last: bool = False

    def order(self):
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def coded(columns: list[pa.Array], keys: list[Key]) -> np.ndarray:
    """Two rows of numbers a key, whose lexicographic order is that of the keys."""
    out = []
    for c, k in zip(columns, keys):
        gone = c.is_null().to_numpy(zero_copy_only=False)
        v = c.fill_null(0).to_numpy(zero_copy_only=False)
        out += [(gone if k.nulls_last else ~gone).astype(np.int64), np.where(gone, 0, ~v if k.descending else v)]
    return np.array(out, np.int64).reshape(2 * len(keys), -1)


def sorted_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of the columns of codes; rows that are the same throughout are left out."""
    used = [c for c in codes if len(c) and (c != c[0]).any()]
    return np.lexsort(used[::-1]) if used else np.arange(codes.shape[1])


class Cuts:
    """Boundaries between tasks: task i holds what lies between cut i - 1 and cut i. What equals several cuts may lie in any task between them."""

    def __init__(self, sample: np.ndarray, tasks: int):
        sample = sample[:, sorted_order(sample)]
        n = sample.shape[1]
        cuts = sample[:, [n * i // tasks for i in range(1, tasks)]] if n else sample
        new = np.ones(cuts.shape[1], bool)
        new[1:] = (cuts[:, 1:] != cuts[:, :-1]).any(0)
        self.cuts = cuts[:, new]
        self.upto = np.append(np.flatnonzero(new), cuts.shape[1])  # cuts before each distinct one, and all

    def tasks(self, codes: np.ndarray) -> np.ndarray:
        k, n = self.cuts.shape[1], codes.shape[1]
        if not k or not n:
            return np.zeros(n, np.int32)
        order = sorted_order(np.concatenate([self.cuts, codes], 1))  # a cut stands before the rows that equal it
        below = np.empty(k + n, np.int64)
        below[order] = np.cumsum(order < k)
        below = below[k:]
        at = self.upto[below]
        same = (below > 0) & (codes == self.cuts[:, below - 1]).all(0)
        first = self.upto[below - 1]
        return np.where(same, first + np.arange(n) % (at - first + 1), at).astype(np.int32)


class _Pass:
    """The machine's state in one task: the group and the run it is in, and the kept rows of the run, whose length is not yet known."""

    def __init__(self, keys: list[Key], groups: int, pair: int, top: int):
        self.keys, self.groups, self.upto, self.top = keys, groups, groups + pair, top
        self.last = self.task = None
        self.open: list[dict] = []

    def _codes(self, batch) -> np.ndarray:
        return coded([column(batch, k.name) for k in self.keys[: self.upto]], self.keys[: self.upto])

    def _edge(self, kind: int, key: pa.RecordBatch, rows: int, tied: int, place: int) -> dict:
        return {k.name: column(key, k.name) for k in self.keys} | {"task": [self.task], "kind": [kind], "flags": [0], "pos": [rows], "place": [place], "tied": [tied]}

    def _flush(self, flag: int = 0):
        for part in self.open:
            yield part | {"tied": np.full(len(part["pos"]), self.run_rows), "flags": part["flags"] | flag}
        self.open = []

    def close(self):
        """The rows still held, and the task's edges."""
        if self.last is None:
            return
        yield from self._flush(LAST_RUN)
        head_rows, head_run = (self.group_rows if self.in_first else self.head_rows), (self.run_rows if self.in_first_run else self.head_run)
        yield self._edge(HEAD, self.first_row, head_rows, head_run, 1)
        yield self._edge(TAIL, self.last_row, self.group_rows, self.run_rows, self.run_place)
        self.last = None

    def feed(self, batch: pa.RecordBatch, task: int):
        codes, n = self._codes(batch), batch.num_rows
        begin = self.last is None
        if begin:
            self.task, self.first_row, self.in_first, self.in_first_run = task, batch.slice(0, 1), True, True
            self.group_rows = self.run_rows = self.head_rows = self.head_run = 0
        before = np.concatenate([codes[:, :1] if begin else self.last, codes[:, :-1]], 1)
        differs = codes != before
        group, run = differs[: 2 * self.groups].any(0), differs.any(0)
        group[0] |= begin
        run[0] |= begin
        i = np.arange(n)
        starts = np.maximum.accumulate(np.where(group, i, -1))
        pos = i - starts + 1 + np.where(starts < 0, self.group_rows - 1, 0)
        run_starts = np.maximum.accumulate(np.where(run, i, -1))
        place = np.where(run_starts < 0, 0 if begin else self.run_place, pos[run_starts])
        number = np.cumsum(run)  # 0: the run that was open before
        counts = np.bincount(number, minlength=number[-1] + 1)
        counts[0] += self.run_rows
        first_group = np.cumsum(group) == (1 if begin else 0) if self.in_first else np.zeros(n, bool)
        first_run = number == (1 if begin else 0) if self.in_first_run else np.zeros(n, bool)
        if self.in_first and not first_group.all():
            self.head_rows = self.group_rows + int(first_group.sum())
        if self.in_first_run and not first_run.all():
            self.head_run = int(counts[1 if begin else 0])
        flags = np.where(first_group, FIRST_GROUP, 0) | np.where(first_run, FIRST_RUN, 0)
        kept = place <= self.top
        if number[-1]:  # the run that was open has ended
            self.run_rows = int(counts[0])
            yield from self._flush()
        for chosen in (np.flatnonzero(kept & (number < number[-1])), np.flatnonzero(kept & (number == number[-1]))):
            if len(chosen):
                rows = batch.take(pa.array(chosen))
                part = {k.name: column(rows, k.name) for k in self.keys} | {"task": np.full(len(chosen), task), "kind": np.zeros(len(chosen), np.int32), "flags": flags[chosen], "pos": pos[chosen], "place": place[chosen]}
                if number[chosen[0]] < number[-1]:
                    yield part | {"tied": counts[number[chosen]]}
                else:
                    self.open.append(part)
        self.group_rows = int(pos[-1])
        self.run_rows, self.run_place = int(counts[-1]), int(place[-1])
        self.in_first, self.in_first_run = self.in_first and bool(first_group[-1]), self.in_first_run and bool(first_run[-1])
        self.last, self.last_row = codes[:, -1:], batch.slice(n - 1, 1)


def repairs(edges: list[dict], groups: list[str], pair: list[str]) -> list[tuple[int, int, int, int, int]]:
    """From the HEAD and TAIL rows of all tasks: for each (task, rows of its first group before it, place of its first run, rows of all of its
    first run, rows of all of its last run)."""
    of = lambda e, names: tuple(e[n] for n in names)
    by = {(e["task"], e["kind"]): e for e in edges}
    runs, out = [], []
    last_group = last_pair = None
    rows = place = 0
    for task in sorted({t for t, _ in by}):
        head, tail = by[task, HEAD], by[task, TAIL]
        g, p = of(head, groups), of(head, pair)
        one_group = of(tail, groups) == g
        one_run = one_group and of(tail, pair) == p
        before = rows if last_group is not None and g == last_group else 0
        if before and p == last_pair:
            first = place
        else:
            first = before + 1
            runs.append(0)
        runs[-1] += head["tied"]
        head_run = len(runs) - 1
        if not one_run:
            runs.append(tail["tied"])
        place = first if one_run else tail["place"] + (before if one_group else 0)
        rows = tail["pos"] + (before if one_group else 0)
        last_group, last_pair = of(tail, groups), of(tail, pair)
        out.append((task, before, first, head_run, len(runs) - 1))
    return [(t, b, f, runs[h], runs[e]) for t, b, f, h, e in out]


def rank_ties(rows: DataFrame, groups: list[str], pair: list[Key], order: list[Key], top: int) -> DataFrame:
    """The rows with at most top - 1 rows of their group before their run of equal pairs.

    rows: any columns; those named by groups, pair and order are long values, nulls of a group are one group. Returns these columns and
    pos (from 1, in order of pair and then order), place (1 and the group's rows with earlier pairs), tied (the group's rows with this
    pair), all long. Equal rows are ranked separately; which of them comes first does not show. An empty table gives an empty one.

    What the driver gets and sends out is SAMPLE rows a task for the cuts, and two rows a task for the repair.
    """
    spark, keys = rows.sparkSession, [Key(g) for g in groups] + pair + order
    names, n = [k.name for k in keys], width(spark)
    lines = rows.select(*(F.col(f"`{c}`").cast("long").alias(c) for c in names))
    total = lines.count()
    sample = lines.sample(min(1.0, SAMPLE * n / max(total, 1)), seed=11).toArrow().combine_chunks()
    cuts = spark.sparkContext.broadcast(Cuts(coded([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in sample.columns], keys), n))

    @F.arrow_udf("int")
    def task(*columns: pa.Array) -> pa.Array:
        return pa.array(cuts.value.tasks(coded(list(columns), keys)))

    dealt = lines.withColumn("task", task(*names)).repartitionById(n, "task").sortWithinPartitions("task", *(k.order() for k in keys))
    n_groups, n_pair = len(groups), len(pair)

    def run(batches):
        state = _Pass(keys, n_groups, n_pair, top)
        for batch in batches:
            tasks = column(batch, "task").to_numpy()
            for part in np.split(np.arange(len(tasks)), np.flatnonzero(np.diff(tasks)) + 1) if len(tasks) else ():
                if state.last is not None and state.task != tasks[part[0]]:
                    yield from state.close()
                yield from state.feed(batch.slice(part[0], len(part)), int(tasks[part[0]]))
        yield from state.close()

    schema = ", ".join(f"`{c}` long" for c in names) + ", task int, kind int, flags int, pos long, place long, tied long"
    place = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}"
    arrow_map(dealt, run, schema).write.parquet(place)
    passed = spark.read.schema(schema).parquet(place)
    edges = [r.asDict() for r in passed.where(F.col("kind") != KEPT).collect()]
    fixed = spark.createDataFrame(repairs(edges, groups, [k.name for k in pair]), "task int, rows_before long, head_place long, head_tied long, tail_tied long")
    within, at_head, at_tail = (F.col("flags").bitwiseAND(b) != 0 for b in (FIRST_GROUP, FIRST_RUN, LAST_RUN))
    before = F.when(within, F.col("rows_before")).otherwise(0)
    return (
        passed.where(F.col("kind") == KEPT).join(F.broadcast(fixed), "task")
        .select(
            *names, (F.col("pos") + before).alias("pos"), F.when(at_head, F.col("head_place")).otherwise(F.col("place") + before).alias("place"),
            F.when(at_head, F.col("head_tied")).when(at_tail, F.col("tail_tied")).otherwise(F.col("tied")).alias("tied"),
        )
        .where(F.col("place") <= top)
    )


def rank_sale_lines(lines: DataFrame, top: int = 3) -> DataFrame:
    """sale_lines, as the query's contract says: the columns are cast to long, of a NaN amount or discount the whole number is 0."""
    c = lambda name: F.col(f"`{name}`")
    one = F.coalesce(F.crc32(c("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    month = F.coalesce(100 * F.year(c("shipped_at")) + F.month(c("shipped_at")), F.lit(-1))
    keyed = lines.select(
        F.when(one, -1).otherwise(c("vendor_id")).alias("vendor_id"), F.when(one, -1).otherwise(F.coalesce(c("item_id") % 10, F.lit(-1))).alias("part"), F.when(one, -1).otherwise(month).alias("month"),
        F.floor(c("quantity") / 10).alias("tens"), F.floor(100 * c("discount") + 0.5).alias("percent"),
        c("sale_id").alias("sale_id"), c("line_no").alias("line_no"), c("quantity").alias("quantity"), F.floor(100 * c("amount") + 0.5).alias("amount_cents"),
    )
    pair = [Key("tens", descending=True), Key("percent")]
    order = [Key(n, nulls_last=True) for n in ("sale_id", "line_no", "quantity", "amount_cents")]
    return rank_ties(keyed, ["vendor_id", "part", "month"], pair, order, top).select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")

"""Exact top-k search by Fagin's threshold algorithm over sorted lists, one a dimension.

Candidates are dealt into shards and queries into blocks; each shard meets each block.  A shard sorts its vectors along each dimension.
For a query the lists are read in step, each from the end that its component favours, to growing depths; what they bring up is scored
in full (the random access), once, and the sum of the components at the depth reached bounds every vector not yet seen.  Reading stops
when that bound can neither beat nor tie with the k-th score.  While it is above what the lengths of the vectors allow any score to be,
it cannot stop, so what the lists bring up till then is scored together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, width

SHARD = 16_384
QUERIES = 1_024
#: The first depth to which lists are read; each next one is twice as deep.
DEPTH = 8


class Shard:
    """Sorted lists over the distinct vectors of a shard; of equal vectors the least ids are kept, as many as can be among the k best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.ravel()))
        ids, group = ids[order], group.ravel()[order]
        starts = np.searchsorted(group, np.arange(len(self.vectors) + 1))
        rank = np.arange(len(ids)) - starts[group]
        keep = rank <= k  # one more than k, as a query's own row takes no part
        self.ids = ids[keep]
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(group[keep], minlength=len(self.vectors)))))
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")

    def best(self, own: int, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of the vectors `at`, without `own`; ties go to the least id."""
        if len(at) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            at, scores = at[scores >= least], scores[scores >= least]
        sizes = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[at] - (ends - sizes), sizes)]
        scores = np.repeat(scores, sizes)
        keep = ids != own
        ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int):
        """Yields query number, ids and scores of its k best, and the depth at which reading stopped (the lists' length: at their end)."""
        m, d = self.vectors.shape
        most = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1)
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums are exact
        vectors, queries = np.ascontiguousarray(self.vectors.astype(kind)), queries.astype(kind)
        place = np.int16 if m < 2**15 else np.int32
        ranks = np.empty((d, m), place)  # each vector's place in each list
        np.put_along_axis(ranks, self.lists.T, np.arange(m, dtype=place)[None], axis=1)
        depths = [DEPTH << j for j in range(max(0, m.bit_length())) if DEPTH << j < m]
        ends = [vectors[self.lists[at], np.arange(d)] for depth in depths for at in (m - depth, depth - 1)]
        high, low = (np.stack(ends[k::2]) if ends else np.zeros((0, d), kind) for k in (0, 1))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
        reach = length(queries) * length(vectors).max(initial=0) + 1
        for q, query in enumerate(queries):
            up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
            seen, comes, at, scores = np.zeros(m, bool), None, np.empty(0, np.int64), np.empty(0, kind)
            for depth, bound in [*zip(depths, bounds[q]), (m, None)]:
                if bound is not None and bound > reach[q]:
                    continue
                if bound is None:
                    new = ~seen
                elif depth * d < m:
                    new = np.zeros(m, bool)
                    new[self.lists[m - depth :, up].ravel()] = new[self.lists[:depth, down].ravel()] = True
                    new &= ~seen
                else:
                    if comes is None:  # the depth at which each vector comes up
                        comes = np.minimum(m - 1 - ranks[up].max(0, initial=-1).astype(np.int32), ranks[down].min(0, initial=np.iinfo(place).max))
                    new = (comes < depth) & ~seen
                seen |= new
                new = np.flatnonzero(new)
                found = (vectors @ query)[new] if 2 * len(new) > m else vectors[new] @ query
                at, scores = np.concatenate([at, new]), np.concatenate([scores, found])
                if len(at) > k + 1:  # one more than k, as the query's own row takes no part; all that tie with the last
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    at, scores = at[scores >= least], scores[scores >= least]
                ids, top = self.best(own[q], at, scores, k)
                if bound is not None and len(ids) >= k and top[-1] > bound:
                    break
            yield q, ids, top, depth


def _matrix(batch, dims: int) -> np.ndarray:
    v = column(batch, "v")
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _search(k: int):
    """Rows sorted by shard, block: a group's candidates and queries."""

    def run(batches):
        import pyarrow as pa

        def answer(parts):
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()
            if not table:
                return
            batch = table[0]
            dims = int(np.diff(column(batch, "v").offsets.to_numpy()).max(initial=0))
            ids, asks, v = column(batch, "vec_id").to_numpy(), column(batch, "asks").to_numpy(zero_copy_only=False), _matrix(batch, dims)
            if asks.all() or not asks.any():
                return
            shard, own = Shard(ids[~asks], v[~asks], k), ids[asks]
            out = {c: [] for c in ("query_id", "vec_id", "score")}
            for q, found, scores, _ in shard.search(own, v[asks], k):
                out["query_id"].append(np.full(len(found), own[q])), out["vec_id"].append(found), out["score"].append(scores.astype(np.int64))
            yield {c: np.concatenate([np.empty(0, np.int64), *x]) for c, x in out.items()}

        key, parts = None, []
        for batch in batches:
            shards, blocks = column(batch, "shard").to_numpy(), column(batch, "block").to_numpy()
            if not len(shards):
                continue
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(blocks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if key != (shards[a], blocks[a]):
                    if parts:
                        yield from answer(parts)
                    key, parts = (shards[a], blocks[a]), []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from answer(parts)

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """vectors: vec_id long, embedding array of float or double, any other columns; is_query: a condition on vec_id. Returns query_id,
    rank (int, from 1), vec_id, score (long): each query's k highest inner products of floor(scale * x) with all other rows.

    Ties go to the least vec_id. Rows take no part whose id or vector is null or holds a null or non-finite component; of several rows
    of one id the least vector counts; a shorter vector has zeros at its end. Fewer candidates than k give fewer rows.
    """
    n = width(vectors.sparkSession)
    x = F.col("embedding")
    inf = F.lit(float("inf"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, asking = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-total // SHARD) or 1, -(-asking // QUERIES) or 1
    deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = rows.select(deal(shards, 1).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where(is_query).select(every(shards).alias("shard"), deal(blocks, 2).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    met = candidates.union(asked).repartition(n, "shard", "block").sortWithinPartitions("shard", "block")
    found = arrow_map(met, _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Connected components by alternating stars, after a union-find inside every partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, cut


def _contract(batches):
    """Star edges (node, root) of the components of this partition's edges, in bounded batches of edges."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def stars():
        if nodes := [x for x in parent if find(x) != x]:
            yield {"u": nodes, "v": [find(x) for x in nodes]}
        parent.clear()

    for batch in batches:
        for a, b in zip(column(batch, "u").to_pylist(), column(batch, "v").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield from stars()
    yield from stars()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v long, not null.  Returns id, root (long): every node of an edge that isn't its component's least node, and that least node.

    Each round moves every edge a constant number of times; the rounds are few (logarithmic).  A node's least neighbour is found by an
    aggregation, which gathers before it shuffles, and joined back, so that a node with very many edges fills no task.  Loops and
    repeated edges do no harm; without edges the result is empty.
    """
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"))
    edges = cut(arrow_map(edges.select("u", "v").where("u <> v"), _contract, "u long, v long").distinct())  # u > v
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
        # each node's larger neighbours go over to its least neighbour, if that is less than itself
        lower = least(edges).withColumnRenamed("u", "v")
        large = edges.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # then its smaller neighbours, and itself
        small = least(large)
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(small.select("u", F.col("m").alias("v"))).distinct())

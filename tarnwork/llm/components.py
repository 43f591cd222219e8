"""Connected components by alternating large-star and small-star steps, and of at most FEW edges in one step.

No step gathers more than FEW edges in one place: the edges of a node with many are dealt over tasks by salts. A round of steps
takes some 15 stages however few the edges are, so few edges go to one task, which holds them in numpy arrays (4 MB).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, salted, written


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger, least = salted(both.where("v > u"), least, "u", "v", total)
    return larger.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Edges point from the larger to the smaller end."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    smaller, each = salted(e, least, "u", "v", total)
    met = smaller.join(each, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


#: Edges that one task takes at once; with more, star steps deal them over all tasks.
FEW = 1 << 18


def _roots(u, v):
    """Ends of edges -> (nodes in order, the smallest node of the component of each)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        # each root that meets a smaller one goes under the smallest; then every node is tied to its root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _at_once(batches):
    """All edges of a task -> node, root."""
    import pyarrow as pa

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = _roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges u, v (long) -> node, root: every node that has an edge, with the smallest node of its component."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e, "star")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        if now[0] <= FEW:
            out = written(e.coalesce(1).mapInArrow(_at_once, "node long, root long"), "star")
            drop_written(e)
            return out
        before = now
        old, e = e, written(_small_star(_large_star(e, now[0]), now[0]).distinct(), "star")
        drop_written(old)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._written_at = e._written_at
    return out

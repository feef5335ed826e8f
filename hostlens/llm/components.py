"""Connected components of an edge table by alternating star contractions, all in Spark.

A table counted to have at most ``ONE_TASK`` edges (32 MB of ids) is finished by one task, without rounds of
shuffles; larger ones contract until nothing changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, saved

ONE_TASK = 2_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component: least neighbours, then pointers to pointers."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], low)  # a root points to the least root beside its tree
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(pairs: DataFrame) -> DataFrame:
    def run(batches):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
        node, least = labels(np.concatenate(a), np.concatenate(b))
        for k in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k:k + 100_000]), pa.array(least[k:k + 100_000])], ["node", "component"])

    return pairs.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.  ``rows``: see ``gathered``.

    Each round points neighbours at the least of their neighbourhood (large star, then small star) until
    nothing changes.  Minima are pre-aggregated; the joins back stay splittable for skewed nodes.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    pairs = saved(gathered(pairs, rows), "edges")
    if pairs.count() <= ONE_TASK:
        return _in_one_task(pairs)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(saved(least, "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = saved(down.distinct(), "star")
        least = saved(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    # stars now: every other node points at its component's least
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

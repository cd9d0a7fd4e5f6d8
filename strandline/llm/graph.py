"""Connected components: of few edges in one task, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import core

#: Edges that one task takes at most, 16 bytes each.
FEW = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges but the roots."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low < high
        if not on.any():
            node = np.flatnonzero(root < np.arange(len(names)))
            return names[node], names[root[node]]
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while (up := root[root] < root).any():
            root[up] = root[root[up]]


def _rooted(batches):
    both = [(x["u"].to_numpy(), x["v"].to_numpy()) for x in batches if x.num_rows]
    if both:
        node, root = roots(*(np.concatenate(x) for x in zip(*both)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _least(edges: DataFrame) -> DataFrame:
    """edges with m, the least neighbour of u: aggregated before the shuffle and joined, so that a node with very many edges is split."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over distinct edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).withColumn("m", F.least("u", "m"))
    large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    near = _least(large)
    small = near.select("u", "m").unionByName(near.select(F.col("v").alias("u"), "m"))
    return small.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; the root is the least node of the component.

    Up to few edges are gone through in one task. Of more, rounds grow with the logarithm of a component's size; each is cut off by a checkpoint. No edges give no rows.
    """
    core.shared_dir(edges.sparkSession)
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    if pairs.count() <= few:
        return pairs.coalesce(1).mapInArrow(core.tidy(_rooted), "node long, root long").checkpoint()
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, pairs = now, _star(pairs).checkpoint()

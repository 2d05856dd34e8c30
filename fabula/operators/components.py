"""Connected components of a graph that only exists as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.plans.storage import materialize

#: Edges that a task gathers before it contracts them, if it doesn't hold more stars than that.
EDGES_AT_ONCE = 1 << 17


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest number that the edges lead to: the larger of two
    roots is hung below the smaller one, and paths are halved until nothing is open."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(edges: pa.Table) -> pa.Table:
    """The edges as (node, the smallest one it is connected with), those nodes left out."""
    both = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks]).combine_chunks()
    nodes = both.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(both, value_set=nodes).to_numpy(zero_copy_only=False)
    root = _roots(at[: len(edges)], at[len(edges) :], len(nodes))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table([nodes.take(pa.array(child)), nodes.take(pa.array(root[child]))], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a partition's edges; at most one row for each of its nodes."""
    held: list[pa.RecordBatch] = []
    fresh, most = 0, EDGES_AT_ONCE
    for batch in batches:
        held.append(batch)
        fresh += len(batch)
        if fresh >= most:
            held, fresh = _stars(pa.Table.from_batches(held)).to_batches(), 0
            most = max(EDGES_AT_ONCE, sum(map(len, held)))
    if held:
        yield from _stars(pa.Table.from_batches(held)).to_batches(1 << 16)


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node that has a smaller one in its component; the root is the
    smallest. ``edges`` has columns a and b of one ordered type.

    Every task contracts the edges it holds to stars. These are dealt by their outer
    node, which has at most one edge from each task, so no node is hot, and contracted
    again. What then is a child of two roots, or a root and a child, is open: edges jump
    over it in the next round, until nothing is open. Each round leaves every node below
    a smaller one than before or as it was, so the rounds end.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.mapInArrow(_contract, e.schema)
    for _ in range(rounds):
        done = materialize(e.repartition("u").mapInArrow(_contract, e.schema), "stars")
        ends = done.select(F.col("u").alias("k"), F.col("v").alias("w"), F.lit(0).alias("root")).union(done.select("v", F.lit(None).cast(done.schema["v"].dataType), F.lit(1)))
        ends = ends.groupBy("k").agg(F.min("w").alias("w"), F.count("w").alias("n"), F.max("root").alias("root"))
        jumps = materialize(ends.where("n > 1 or (n = 1 and root = 1)").select("k", "w"), "jumps")
        if not jumps.head(1):
            return done.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = done.join(jumps.withColumnRenamed("k", "v"), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; an edge from a node to itself keeps
    that node. Nulls are no nodes."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node is not null").distinct()
    return nodes.join(stars(edges, rounds), "node", "left").withColumn("root", F.coalesce("root", "node"))

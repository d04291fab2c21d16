"""Connected components by alternating star operations over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Nodes that a task holds at a time.
HELD = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars (node, smallest node that its own edges reach), for HELD nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flushed() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield from flushed()
    yield from flushed()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (large), or its smaller ones and itself, to the smallest of node and neighbours."""
    to = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = to.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    side = to.where("b > a") if large else to.where("b < a").unionByName(to.select("a", F.col("a").alias("b")).distinct())
    return side.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60, files: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Tasks first contract the edges that they hold; the star operations then run until every node has one root and no root
    has another, which one grouping of the stars tells. Each round is written to the shared folder (in `files` files, see
    stored). They halve the distance to the root, so a run that isn't done after `rounds` is an error. Nodes
    without edges aren't returned.
    """
    stars = stored(edges.select("a", "b").where("a != b").mapInArrow(_forest, "a long, b long"), "stars", files)
    for done in range(rounds + 1):
        ends = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), "b"))
        nodes = stored(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"), F.max("b").alias("most")), "nodes", files)
        if nodes.where("root < most").isEmpty():
            discard(stars)
            return nodes.select("node", "root")
        discard(nodes)
        if done < rounds:
            before, stars = stars, stored(_stars(_stars(stars, True), False), "stars", files)
            discard(before)
    raise RuntimeError(f"components haven't settled after {rounds} rounds")

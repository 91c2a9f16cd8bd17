"""Connected components by alternating large-star and small-star steps; no node's links meet in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = both.where("v > u") if large else both
    out = near.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


class Joined:
    """Disjoint sets of numbers, each named by its smallest (halving paths)."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up.setdefault(up[x], up[x])
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The nodes of some edges but the roots, each with its component's smallest node; a forest for every ``most`` nodes."""
    joined = Joined()

    def out() -> pa.RecordBatch:
        nodes = np.fromiter(joined.up, np.int64, len(joined.up))
        roots = np.fromiter(map(joined.root, nodes.tolist()), np.int64, len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            joined.join(a, b)
        if len(joined.up) > most:
            yield out()
            joined = Joined()
    yield out()


def components(edges: DataFrame, few: int = 200_000) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``) but the roots; a root is its component's smallest node.

    Each task first reduces its edges to a forest. Up to ``few`` edges (a few MB) are then joined in one task; more go
    through star steps until nothing changes.
    """
    seal = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = keep(edges.select("a", "b").mapInArrow(_forest, "a long, b long"))
    if edges.count() <= few:
        edges = keep(edges.coalesce(1).mapInArrow(_forest, "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while before != (now := seal(edges)) and now[0]:
        before, edges = now, keep(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

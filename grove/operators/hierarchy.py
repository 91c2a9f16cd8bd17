"""Agglomerative clusters of any number of rows: single linkage by minimum spanning trees, others over micro-clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.operators.sums import matrix
from grove.storage import sealed, stored

#: So many micro-clusters at most; up to so many rows, each is one and the hierarchy is exact.
MICRO = 5000


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (from, to, length) of a minimum spanning tree over all distances, grown row by row."""
    n = len(x)
    best, near, out = np.full(n, np.inf), np.zeros(n, np.int64), []
    left, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        out.append((near[at], at, best[at]))
    a, b, d = zip(*out, strict=True) if out else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d, float)


def pair_trees(rows: DataFrame, block: int) -> DataFrame:
    """``a, b, d``: edges that hold a minimum spanning tree of all rows.

    Each pair of blocks is spanned in a task of its own. An edge that is the longest one of a circle inside a pair is
    that in the whole, so what the pairs leave out isn't needed: of the distances, one in ``block`` rows is left.
    """
    blocks = max(1, -(-rows.count() // block))
    marked = rows.select("row_id", F.transform("features", lambda v: v.cast("double")).alias("x"), F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("k"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    paired = marked.withColumn("o", other).where((F.col("o") != F.col("k")) | F.lit(blocks == 1))

    def span(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("row_id")
        a, b, d = spanning_tree(matrix(f, "x"))
        ids = f["row_id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b], "d": d})

    return paired.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")}).groupBy("i", "j").applyInPandas(span, "a long, b long, d double")


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """``a, b, d`` by rounds: every component takes its shortest edge to another one, and they are joined along these.

    Edges are ordered by length, then by their ends, so that no circle is closed. Rounds at least halve the components.
    """
    first = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    rest = stored(edges.select(*first, "d").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("d", "a", "b").alias("e")))
    tree = []
    while True:
        rest = rest.groupBy("ca", "cb").agg(F.min("e").alias("e"))  # of parallel edges the shortest
        both = rest.union(rest.select("cb", "ca", "e"))
        taken = stored(both.groupBy("ca").agg(F.min("e").alias("e"), F.min_by("cb", "e").alias("cb")))
        if taken.isEmpty():
            break
        tree.append(taken.select("e.*").distinct())
        roots = joined(taken.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("ca", "cb")]
        rest = rest.join(ends[0], "ca").join(ends[1], "cb").where("rca != rcb").select(F.least("rca", "rcb").alias("ca"), F.greatest("rca", "rcb").alias("cb"), "e")
        rest = stored(rest)
    out = tree[0] if tree else rest.select("e.*")
    for more in tree[1:]:
        out = out.union(more)
    return stored(out.select("a", "b", "d"))


def joined(links: DataFrame) -> DataFrame:
    """``node, root``: each end of the links (``a, b``) with the smallest end of its component; labels spread and jump."""
    edges = sealed(links.union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b")).distinct())
    labels = sealed(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = sealed(step.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), "was"))
        labels = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return labels


def numbered(labels: DataFrame, k: int) -> DataFrame:
    """Clusters (at most about ``k`` of them) numbered by their smallest row."""
    first = labels.groupBy("cluster").agg(F.min("row_id").alias("first"))
    names = {r["cluster"]: i for i, r in enumerate(first.orderBy("first").collect())} if k <= MICRO else None
    if names is None:
        ranks = first.withColumn("n", F.row_number().over(Window.orderBy("first")) - 1)
    else:
        ranks = labels.sparkSession.createDataFrame(list(names.items()), "cluster long, n int")
    return labels.join(F.broadcast(ranks), "cluster").select("row_id", F.col("n").cast("int").alias("cluster"))


def single(rows: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """Clusters of single linkage: the spanning tree without its k - 1 longest edges."""
    tree = minimum_spanning_tree(pair_trees(rows, block))
    cut = tree.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(max(0, k - 1))
    left = tree.join(cut.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
    roots = joined(left.union(rows.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"))))
    return numbered(roots.select(F.col("node").alias("row_id"), F.col("root").alias("cluster")), k)


def merged(d: np.ndarray, size: np.ndarray, k: int, method: str) -> np.ndarray:
    """Labels of k clusters after the lowest merges, found along chains of nearest neighbours (Lance-Williams updates).

    Both ways a distance is the same number, and a merged cluster is no nearer than the nearer one of its parts, rounding
    or not: so distances fall along a chain, it never comes back to a cluster, and merges rise (of equal ones parts come first).
    """
    n = len(d)
    d = np.minimum(d, d.T)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, steps = size.astype(float).copy(), np.ones(n, bool), [], []
    while len(steps) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        i, j = min(a, b), max(a, b)
        steps.append((d[i, j], i, j))
        if method == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            new = np.maximum(d[i], d[j])
        new = np.maximum(new, np.minimum(d[i], d[j]))
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
    label = np.arange(n)
    for _, i, j in sorted(steps, key=lambda s: s[0])[: max(0, n - k)]:
        a, b = label[i], label[j]
        label[label == max(a, b)] = min(a, b)
    return np.unique(label, return_inverse=True)[1]


def compact(rows: DataFrame, k: int, linkage: str, micro: int = MICRO) -> DataFrame:
    """Ward, average or complete linkage of clustering features (number and sums of rows).

    ``micro`` rows, those with the smallest hashed ids, are seeds; every row belongs to its nearest seed, and a seed's rows
    become one feature. The features' hierarchy is built in one task, bounded by ``micro``, and rows get the label of
    their seed. With at most ``micro`` rows each has its own feature; beyond that features stand for their rows' mean.
    """
    seeds = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(micro).select("row_id", F.transform("features", lambda v: v.cast("double")).alias("features"))
    seeds = sealed(seeds).orderBy("row_id").collect()
    if not seeds:
        return rows.select("row_id", F.lit(0).alias("cluster"))
    at = np.array([r["features"] for r in seeds], float)
    square = (at**2).sum(axis=1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 1000):
                g = f.iloc[a : a + 1000]
                yield g.assign(seed=np.argmin(square - 2 * matrix(g) @ at.T, axis=1))

    placed = stored(rows.select("row_id", F.transform("features", lambda v: v.cast("double")).alias("features")).mapInPandas(place, "row_id long, features array<double>, seed long"))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(at)), np.zeros_like(at)
        for f in frames:
            n += np.bincount(f["seed"], minlength=len(at))
            np.add.at(s, f["seed"].to_numpy(), matrix(f) if len(f) else np.zeros((0, at.shape[1])))
        some = np.flatnonzero(n)
        if len(some):  # a part of a file may hold no rows, and an empty list makes no column of arrays
            yield pd.DataFrame({"seed": some, "n": n[some], "s": list(s[some])})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        some, at = np.unique(f["seed"].to_numpy(), return_inverse=True)
        n, s = np.bincount(at, f["n"].to_numpy()), np.zeros((len(some), len(f["s"].iloc[0])))
        np.add.at(s, at, matrix(f, "s"))
        return pd.DataFrame({"seed": some, "n": n, "s": list(s)})

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros(len(at)), np.zeros_like(at)
        np.add.at(n, f["seed"].to_numpy(), f["n"].to_numpy())
        np.add.at(s, f["seed"].to_numpy(), matrix(f, "s"))
        some = np.flatnonzero(n)
        c, size = s[some] / n[some][:, None], n[some]
        d = np.maximum((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c @ c.T, 0)
        d = 2 * d * size[:, None] * size / (size[:, None] + size) if linkage == "ward" else np.sqrt(d)
        return pd.DataFrame({"seed": some, "cluster": merged(d, size, k, linkage).astype(np.int64)})

    kind = "seed long, n double, s array<double>"
    parts = placed.select("seed", "features").mapInPandas(features, kind).groupBy((F.col("seed") % 64).alias("g")).applyInPandas(add, kind)
    labels = parts.groupBy(F.lit("features")).applyInPandas(fit, "seed long, cluster long")  # micro rows at most
    return numbered(placed.select("row_id", "seed").join(F.broadcast(sealed(labels)), "seed").select("row_id", "cluster"), k)

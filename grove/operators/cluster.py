"""Clustering: k-means, density clusters, hierarchies, quality measures and principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.fusion import standardized
from grove.operators.hierarchy import compact, single
from grove.operators.neighbours import UNITS, counted, distances, linked  # noqa: F401  distances: by this name too
from grove.operators.sums import matrix, summed
from grove.operators.tsne import tsne
from grove.storage import running, sealed, stored

#: Rows: ``row_id long, features array<double>``. Defaults.
K, STARTS, ROUNDS, SEED, EPS, MIN_SAMPLES, K_RANGE, MOST_COMPONENTS = 7, 10, 300, 42, 0.5, 3, (3, 15), 50
#: So many rows at most are those that starts of k-means are drawn from.
SEEDS = 4096


def preprocessed(rows: DataFrame, dim: int, normalize: bool = True, reduce: bool = True) -> DataFrame:
    """Standardised, then projected on the first components where there are over 50 columns."""
    rows = standardized(rows, "features", dim) if normalize else rows
    return pca(rows, dim, MOST_COMPONENTS) if reduce and dim > MOST_COMPONENTS else rows


def pca(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """Centred projection on min(k, n - 1, dim) components, each with its largest loading positive.

    Means and the covariance are sums over blocks of rows; only dim x dim numbers reach the driver.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["features"].to_numpy()).astype(float)
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0)], "p": [(x.T @ x).ravel()]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(f["n"].sum())], "s": [np.sum(np.stack(f["s"]), axis=0)], "p": [np.sum(np.stack(f["p"]), axis=0)]})

    kind = "n long, s array<double>, p array<double>"
    parts = rows.select("features").mapInPandas(sums, kind).groupBy((F.spark_partition_id() % 16).alias("g")).applyInPandas(add, kind).collect()
    if not parts:
        return rows
    n, s, p = sum(r["n"] for r in parts), sum(np.array(r["s"]) for r in parts), sum(np.array(r["p"]) for r in parts)
    mean = s / n
    _, axes = np.linalg.eigh(p.reshape(dim, dim) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, : max(1, min(k, n - 1, dim))]
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    other = [c for c in rows.columns if c != "features"]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["features"].to_numpy()).astype(float) if len(f) else np.zeros((0, dim))
            yield f[other].assign(features=list((x - mean) @ axes))

    return rows.select(*other, "features").mapInPandas(project, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in other) + ", features array<double>")


def seeded(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of x, each drawn in proportion to its squared distance from those before."""
    r = np.random.default_rng(seed)
    at = [int(r.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < k:
        at.append(int(r.choice(len(x), p=near / near.sum())) if near.sum() > 0 else int(r.integers(len(x))))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T, 0)


def lloyd(data: DataFrame, models: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Centres and inertia of all models after Lloyd's rounds: a round is one job over the rows for all models together.

    A task sends each centre's sum and count and each model's squared error. A model rests when no centre moves by
    ``tolerance``; a centre without rows stays where it is.
    """
    moving, cost = [True] * len(models), [0.0] * len(models)
    for step in range(rounds + 1):
        run = [i for i, m in enumerate(moving) if m] if step < rounds and any(moving) else list(range(len(models)))
        last, centers = step == rounds or not any(moving), [models[i] for i in run]

        def part(f: pd.DataFrame, centers=centers, last=last) -> np.ndarray:
            x, out = matrix(f), []
            for c in centers:
                d = _squares(x, c)
                own = d.argmin(axis=1)
                out.append([((x - c[own]) ** 2).sum()])
                if not last:
                    hot = np.eye(len(c))[own]
                    out += [hot.sum(axis=0), (hot.T @ x).ravel()]
            return np.concatenate(out)

        got, at = summed(data, part), 0
        for i in run:
            k, dim = models[i].shape
            cost[i], at = float(got[at]), at + 1
            if not last:
                n, s = got[at : at + k], got[at + k : at + k + k * dim].reshape(k, dim)
                at += k + k * dim
                new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], models[i])
                moving[i] = bool((((new - models[i]) ** 2).sum(axis=1) > tolerance**2).any())
                models[i] = new
        if last:
            return list(zip(models, cost, strict=True))
    raise AssertionError


def fitted(rows: DataFrame, ks: list[int], starts: int = STARTS, rounds: int = ROUNDS, seed: int = SEED) -> list[tuple[np.ndarray, float]]:
    """For each k the centres and inertia of the best of several starts, all in the same passes over the rows.

    Starts are drawn from SEEDS rows at most, those with the smallest hashed ids; every round takes all rows.
    """
    data = stored(rows.select(F.transform("features", lambda v: v.cast("double")).alias("features")))
    some = sealed(rows.orderBy(F.xxhash64("row_id"), "row_id").limit(SEEDS)).orderBy(F.xxhash64("row_id"), "row_id").select("features").collect()
    if not some:
        raise ValueError("no rows to cluster")
    x = np.array([r["features"] for r in some], float)
    done = lloyd(data, [seeded(x, k, seed + s) for k in ks for s in range(starts)], rounds)
    return [min(done[i * starts : (i + 1) * starts], key=lambda m: m[1]) for i in range(len(ks))]


def nearest(rows: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    """``row_id`` and for each model the number of the nearest centre."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = matrix(f)
                yield pd.DataFrame({"row_id": f["row_id"]} | {name: _squares(x, c).argmin(axis=1).astype(np.int32) for name, c in models.items()})

    return rows.select("row_id", "features").mapInPandas(run, "row_id long, " + ", ".join(f"{name} int" for name in models))


def kmeans(rows: DataFrame, k: int = K, starts: int = STARTS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, float]:
    """Labels, centres and inertia of the best of several starts."""
    (best, inertia), = fitted(rows, [k], starts, rounds, seed)
    centers = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best)], "cluster int, center array<double>")
    return nearest(rows, {"cluster": best}), centers, inertia


def _blocks(rows: DataFrame, block: int | None, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows twice, cut into blocks so that every pair of blocks (i <= j) meets in one task; at most UNITS blocks if none is given."""
    n = rows.count()
    blocks = max(1, -(-n // (block or max(500, -(-n // UNITS)))))
    marked = rows.select("row_id", F.transform("features", lambda x: x.cast("double")).alias("x"), *more, F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int").alias("k"))
    left = marked.select("row_id", "x", *more, F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.lit(blocks - 1))).alias("j"))
    right = marked.select(F.col("row_id").alias("id2"), F.col("x").alias("y"), *(F.col(c).alias(f"{c}2") for c in more), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))
    return left, right.select("id2", "y", *(f"{c}2" for c in more), "i", "j")


def _measured(x: np.ndarray, y: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some rows of x at a time (the first one's place goes along) to all rows of y; small ones are measured anew."""
    mid = y.mean(axis=0)
    u, v = x - mid, y - mid
    uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
    least, right, step = 1e-6 * max(uu.max(), vv.max()), v.T.copy(), max(1, at_once // len(y))
    for a in range(0, len(x), step):
        d = u[a : a + step] @ right
        d *= -2
        d += uu[a : a + step, None]
        d += vv
        i, j = np.nonzero(d <= least)
        for c in range(0, len(i), 100_000):
            p, q = i[c : c + 100_000], j[c : c + 100_000]
            d[p, q] = ((y[q] - x[a + p]) ** 2).sum(axis=1)
        yield a, np.sqrt(d, out=d)


def cluster_distances(rows: DataFrame, labels: DataFrame, names: list[str], block: int | None = None) -> DataFrame:
    """``m, a, ca, cb, s, n``: by each labelling, a row's cluster, and the sum and number of its distances to every cluster's rows.

    Distances are taken once for all labellings (columns ``names`` of ``labels``) and for both ways round. There are few
    blocks, whatever the number of rows, so copies of rows grow with them and only comparisons with their square.
    """

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"m": [], "a": [], "ca": [], "cb": [], "s": [], "n": []})
        x, y, same = np.stack(a["x"].to_numpy()), np.stack(b["y"].to_numpy()), bool(a["i"].iloc[0] == a["j"].iloc[0])
        kinds = [tuple(np.unique(f[c].to_numpy(), return_inverse=True) for f, c in ((a, name), (b, f"{name}2"))) for name in names]
        wide, high = (np.concatenate([np.eye(len(k[side][0]))[k[side][1]] for k in kinds], axis=1) for side in (1, 0))
        to, back = np.zeros((len(x), wide.shape[1])), np.zeros((len(y), high.shape[1]))
        for at, d in _measured(x, y):
            to[at : at + len(d)] = d @ wide
            if not same:
                back += d.T @ high[at : at + len(d)]
        out = []
        for ids, own, s, side in ((a["row_id"], "", to, 1), (b["id2"], "2", back, 0))[: 1 if same else 2]:
            at = 0
            for m, name in enumerate(names):
                (kind, of), labels = kinds[m][side], (b if own else a)[f"{name}{own}"].to_numpy()
                part = s[:, at : at + len(kind)]
                at += len(kind)
                out.append(pd.DataFrame({"m": m, "a": np.repeat(ids.to_numpy(), len(kind)), "ca": np.repeat(labels, len(kind)), "cb": np.tile(kind, len(part)), "s": part.ravel(), "n": np.tile(np.bincount(of), len(part))}))
        return pd.concat(out)

    left, right = _blocks(rows.join(labels.select("row_id", *names), "row_id"), block, *names)
    made = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(pair, "m int, a long, ca int, cb int, s double, n long")
    return made.groupBy("m", "a", "ca", "cb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, root`` for both ends of ``edges`` (``a, b``, both ways, with loops): labels spread and jump until they hold."""
    labels = sealed(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = sealed(step.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), "was"))
        labels = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return labels


def dbscan(rows: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``row_id, cluster``: components of core rows numbered by their smallest row; border rows join the smallest number; noise is -1."""
    near = counted(rows, eps).select("row_id", (F.col("near") >= min_samples).cast("int").alias("mark"))
    marked = stored(rows.select("row_id", "features").join(near, "row_id"))
    links = sealed(linked(marked, eps).distinct())
    among, loop = links.where("core").select("a", "b"), marked.where("mark = 1").select(F.col("row_id").alias("a"), F.col("row_id").alias("b"))
    roots = smallest_reachable(sealed(among.union(among.select("b", "a")).union(loop)))
    number = running(roots.select("root").distinct(), [F.col("root")], F.lit(1), "number")
    inner = sealed(roots.join(number, "root").select("node", (F.col("number") - 1).cast("int").alias("cluster")))
    by = links.where("not core").join(inner, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("border"))
    labels = rows.select("row_id").join(inner, F.col("row_id") == F.col("node"), "left").join(by, F.col("row_id") == F.col("a"), "left")
    return labels.select("row_id", F.coalesce("cluster", "border", F.lit(-1)).alias("cluster"))


def hierarchical(rows: DataFrame, k: int = K, linkage: str = "ward") -> DataFrame:
    """Agglomerative clusters: single linkage exactly, others exactly up to MICRO rows and over micro-clusters beyond."""
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage {linkage!r}")
    return single(rows, k) if linkage == "single" else compact(rows, k, linkage)


def silhouettes(rows: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """``m, silhouette`` of each labelling: the mean over rows of (b - a) / max(a, b) with Euclidean distances; rows alone in a cluster count 0."""
    by = cluster_distances(rows, labels, names)
    same = F.col("ca") == F.col("cb")
    per = by.groupBy("m", "a").agg(F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("own"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("other"))
    value = F.when(F.col("own").isNull() | (F.greatest("own", "other") == 0), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return per.groupBy("m").agg(F.avg(value).alias("silhouette"))


def silhouette(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``silhouette`` of one labelling, ``cluster``; null without rows."""
    return silhouettes(rows, labels, ["cluster"]).agg(F.max("silhouette").alias("silhouette"))


def calinski_harabasz(rows: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """``calinski_harabasz``: between- over within-cluster dispersion, each by its degrees of freedom; 1 without the latter."""
    long = rows.join(labels, "row_id").select("cluster", F.posexplode(F.transform("features", lambda x: x.cast("double"))).alias("p", "v"))
    cells = long.groupBy("cluster", "p").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    mean = long.groupBy("p").agg(F.avg("v").alias("all"))
    s = cells.join(F.broadcast(mean), "p").agg(F.sum(F.col("n") * (F.col("m") - F.col("all")) ** 2).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"), F.count_distinct("cluster").alias("k"), F.sum(F.when(F.col("p") == 0, F.col("n"))).alias("rows"))
    return s.select(F.when(F.col("within") == 0, 1.0).otherwise(F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("rows") - F.col("k")))).alias("calinski_harabasz"))


def quality(rows: DataFrame, labels: DataFrame, dim: int) -> dict[str, float]:
    """Both measures over rows in clusters, where there are at least two clusters and fewer than rows; else none."""
    labels = labels.where("cluster >= 0")
    s = labels.agg(F.count_distinct("cluster").alias("k"), F.count("*").alias("n")).first()
    if not 2 <= s["k"] < s["n"]:
        return {}
    rows = rows.join(labels.select("row_id"), "row_id", "left_semi")
    return {"silhouette": silhouette(rows, labels).first()[0], "calinski_harabasz": calinski_harabasz(rows, labels, dim).first()[0]}


def optimal_k(rows: DataFrame, span: tuple[int, int] = K_RANGE) -> tuple[int, list[dict]]:
    """The k with the best silhouette (of equals the smallest) and what each k gave; all k share their passes over the rows."""
    rows = stored(rows.select("row_id", "features"))
    ks = list(range(span[0], min(span[1], rows.count() - 1) + 1))
    if not ks:
        return span[0], []
    best = fitted(rows, ks)
    names = {f"k{k}": c for k, (c, _) in zip(ks, best, strict=True)}
    shape = {r["m"]: r["silhouette"] for r in silhouettes(rows, stored(nearest(rows, names)), list(names)).collect()}
    tried = [{"k": k, "inertia": cost, "silhouette": shape[i]} for i, (k, (_, cost)) in enumerate(zip(ks, best, strict=True))]
    return max(tried, key=lambda r: (r["silhouette"], -r["k"]))["k"], tried


def cluster(rows: DataFrame, dim: int, algorithm: str = "kmeans", n_clusters: int | None = None, auto_k: bool = True, **options) -> DataFrame:
    """``row_id, cluster`` by name; unknown names mean k-means."""
    x = preprocessed(rows, dim)
    if algorithm == "dbscan":
        return dbscan(x, **options)
    if algorithm == "hierarchical":
        return hierarchical(x, n_clusters or K, **options)
    return kmeans(x, n_clusters or (optimal_k(x)[0] if auto_k else K), **options)[0]


def reduced(rows: DataFrame, dim: int, method: str = "tsne", k: int = 2, rounds: int = 500) -> DataFrame:
    """k coordinates for plots: as they are if no more, principal components, or t-SNE around landmarks."""
    if dim <= k:
        return rows
    if method == "pca":
        return pca(rows, dim, k)
    return tsne(stored(pca(rows, dim, 50) if dim > 50 else rows), k, rounds)

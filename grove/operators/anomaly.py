"""Anomalies: isolation forest, one-class support vectors, local outlier factor and their ensemble."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.fusion import min_max, percentile_rank, quantile, standardized
from grove.operators.neighbours import distances
from grove.operators.sums import matrix, summed
from grove.storage import sealed, stored

TREES, SAMPLE, SEED = 100, 256, 42
#: So many rows at most span the one-class machine's features; it is fitted to all rows.
LANDMARKS = 512


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, r: np.random.Generator, depth: int) -> tuple:
    """A random tree: (column, value, left, right), or a leaf's expected extra depth."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if depth == 0 or len(x) <= 1 or not len(spread):
        return (_expected(len(x)),)
    c = int(r.choice(spread))
    at = r.uniform(x[:, c].min(), x[:, c].max())
    left = x[:, c] < at
    return c, at, grow(x[left], r, depth - 1), grow(x[~left], r, depth - 1)


def depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + tree[0])
    left = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = depths(tree[2], x[left], depth + 1), depths(tree[3], x[~left], depth + 1)
    return out


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """n rows at most, the same ones every time: those whose hashed ids are smallest."""
    got = sealed(rows.orderBy(F.xxhash64("row_id", F.lit(SEED)), "row_id").limit(n)).orderBy(F.xxhash64("row_id", F.lit(SEED)), "row_id").select("features").toPandas()  # so many rows reach the driver, not as many of each task
    return np.stack(got["features"].to_numpy()).astype(float) if len(got) else np.zeros((0, 1))


class IsolationForest:
    """Trees over bounded samples; a row's score is 2 ** (-mean depth / expected depth): larger is odder."""

    def __init__(self, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        self.n, self.sample, self.seed = trees, sample, seed

    def fit(self, rows: DataFrame) -> IsolationForest:
        x, r = _sample(rows, self.n * self.sample), np.random.default_rng(self.seed)
        self.size = min(self.sample, len(x))
        self.trees = [grow(x[r.permutation(len(x))[: self.size]], r, int(np.ceil(np.log2(max(self.size, 2))))) for _ in range(self.n)]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-np.mean([depths(t, x) for t in self.trees], axis=0) / max(_expected(self.size), 1e-9))


class OneClassSVM:
    """A Gaussian kernel's boundary with a share of ``nu`` outside, fitted to all rows in the space that landmarks span.

    A row's features are its kernel values to LANDMARKS rows (those with the smallest hashed ids), whitened, so that
    their products give the kernel; what they miss of a row's product with itself (``own``) is kept as a part that the
    row shares with no other one. In the primal objective this part rounds off the row's hinge. Weights and offset
    ``rho`` minimise it by Newton steps, with further rounding that shrinks: a step adds up gradients and curvatures
    over all rows, and only these sums reach the driver. A scored row counts as one of the fitted ones.
    """

    def __init__(self, nu: float = 0.1, rounding: tuple[float, ...] = (0.3, 0.1, 0.03, 0.01), steps: int = 8):
        self.nu, self.rounding, self.steps = nu, rounding, steps

    def fit(self, rows: DataFrame) -> OneClassSVM:
        self.z = _sample(rows, LANDMARKS)
        self.gamma = 1 / max(1, self.z.shape[1])
        values, axes = np.linalg.eigh(self._kernel(self.z, self.z))
        keep = values > 1e-10 * max(values.max(initial=0), 1e-300)
        self.axes = axes[:, keep] / np.sqrt(values[keep])
        dim, data = self.axes.shape[1], stored(rows.select("features"))
        mean = summed(data, lambda f: np.r_[len(f), self.phi(matrix(f)).sum(axis=0)])
        self.w, self.rho, self.top = np.zeros(dim), 0.0, 1.0
        if mean is None:
            return self
        self.w, self.top = mean[1:] / mean[0], 1 / (self.nu * mean[0])
        self.rho = float(self.w @ self.w)
        for share in self.rounding:
            more = share * max(self.rho, 1e-9) / self.top
            for _ in range(self.steps):

                def slopes(f: pd.DataFrame, w=self.w, rho=self.rho, more=more) -> np.ndarray:
                    v, own = self._rows(f)
                    a = v @ np.r_[w, rho] / (own + more)
                    bent = v[(a > 0) & (a < self.top)] / np.sqrt(own + more)[(a > 0) & (a < self.top), None]
                    return np.r_[np.clip(a, 0, self.top) @ v, (bent.T @ bent).ravel()]

                got = summed(data, slopes)
                slope = np.r_[self.w, -1.0] + got[: dim + 1]
                curve = np.diag(np.r_[np.ones(dim), 1e-9]) + got[dim + 1 :].reshape(dim + 1, dim + 1)
                tried = np.r_[self.w, self.rho][:, None] - np.linalg.solve(curve, slope)[:, None] * np.r_[0.0, 0.5 ** np.arange(10)]

                def costs(f: pd.DataFrame, tried=tried, more=more) -> np.ndarray:
                    v, own = self._rows(f)
                    m, wide = np.maximum(v @ tried, 0), (own + more)[:, None]
                    return np.where(m < self.top * wide, m**2 / (2 * wide), self.top * m - self.top**2 * wide / 2).sum(axis=0)

                cost = (tried[:-1] ** 2).sum(axis=0) / 2 - tried[-1] + summed(data, costs)
                best = int(np.argmin(cost))
                self.w, self.rho = tried[:-1, best], float(tried[-1, best])
                if cost[0] - cost[best] <= 1e-9 * abs(cost[0]):
                    break
        return self

    def _rows(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Features against the offset, and each row's own part."""
        phi = self.phi(matrix(f))
        return np.c_[-phi, np.ones(len(phi))], np.maximum(1 - (phi**2).sum(axis=1), 0)

    def _kernel(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))

    def phi(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x, self.z) @ self.axes

    def __call__(self, x: np.ndarray) -> np.ndarray:
        phi = self.phi(x)
        own, inner = np.maximum(1 - (phi**2).sum(axis=1), 0), phi @ self.w
        return -(inner + np.minimum(np.maximum(self.rho - inner, 0), self.top * own))


def scored(rows: DataFrame, model) -> DataFrame:
    """``row_id, raw``: a broadcast model applied batch by batch."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["features"].to_numpy()).astype(float) if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"row_id": f["row_id"], "raw": shared.value(x) if len(f) else []})

    return rows.select("row_id", "features").mapInPandas(run, "row_id long, raw double")


def flagged(scores: DataFrame, col: str, contamination: float, out: str = "is_anomaly") -> DataFrame:
    """Rows whose negated score is below its percentile of the contamination."""
    return scores.withColumn(out, -F.col(col) < F.lit(quantile(scores.select((-F.col(col)).alias("v")), "v", contamination)))


def lof(rows: DataFrame, k: int = 20) -> DataFrame:
    """``row_id, lof``: mean density of the neighbours over a row's own (the usual factor, larger is odder)."""
    n = rows.count()
    k = min(k, n - 1)
    near = sealed(distances(rows, k=k))
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    r = near.join(reach.select(F.col("a").alias("b"), F.col("kd").alias("kb")), "b")
    density = r.groupBy("a").agg((1 / (F.avg(F.greatest("kb", "d")) + 1e-10)).alias("lrd"))
    both = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg(F.avg("lb").alias("lb"))
    return both.join(density, "a").select(F.col("a").alias("row_id"), (F.col("lb") / F.col("lrd")).alias("lof"))


def finished(scores: DataFrame, raw: str) -> DataFrame:
    """``row_id, is_anomaly, score`` (0 to 100) and ``percentile``."""
    return percentile_rank(min_max(scores, raw, "score"), "score", "percentile").select("row_id", "is_anomaly", "score", "percentile")


class AnomalyDetector:
    def __init__(self, algorithm: str = "isolation_forest", contamination: float = 0.1):
        self.algorithm, self.contamination, self.model = algorithm, contamination, None

    def fit(self, rows: DataFrame, dim: int) -> AnomalyDetector:
        if self.algorithm not in ("isolation_forest", "one_class_svm"):
            raise ValueError(f"Unknown algorithm: {self.algorithm}")
        at = [F.col("features")[i].cast("double") for i in range(dim)]
        s = rows.agg(F.array(*(F.avg(x) for x in at)).alias("m"), F.array(*(F.stddev_pop(x) for x in at)).alias("s")).first()
        self.mean, self.scale = [x or 0.0 for x in s["m"]], [x or 1.0 for x in s["s"]]
        model = IsolationForest() if self.algorithm == "isolation_forest" else OneClassSVM(self.contamination)
        self.model = model.fit(self._scaled(rows))
        return self

    def _scaled(self, rows: DataFrame) -> DataFrame:
        z = F.transform(F.arrays_zip(F.col("features"), F.lit(self.mean).alias("m"), F.lit(self.scale).alias("s")), lambda x: (x["features"] - x["m"]) / x["s"])
        return rows.select("row_id", z.alias("features"))

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the detector is not fitted")
        return finished(flagged(sealed(scored(self._scaled(rows), self.model)), "raw", self.contamination), "raw")

    def fit_predict(self, rows: DataFrame, dim: int) -> DataFrame:
        return self.fit(rows, dim).predict(rows)


def ensemble(rows: DataFrame, dim: int, contamination: float = 0.1, voting: str = "soft") -> DataFrame:
    """Isolation forest and local outlier factor. Soft: their mean, flagged from 1.5 deviations over the average on;
    hard: the larger, flagged if either flags."""
    if rows.count() < 2:
        raise ValueError("an ensemble needs two rows at least")
    x = sealed(standardized(rows.select("row_id", "features"), "features", dim))
    a = min_max(flagged(sealed(scored(x, IsolationForest().fit(x))), "raw", contamination, "if_flag"), "raw", "if_score")
    b = min_max(flagged(sealed(lof(x)), "lof", contamination, "lof_flag"), "lof", "lof_score")
    both = a.select("row_id", "if_flag", "if_score").join(b.select("row_id", "lof_flag", "lof_score"), "row_id")
    if voting == "soft":
        out = both.withColumn("score", (F.col("if_score") + F.col("lof_score")) / 2)
        cut = out.agg((F.avg("score") + 1.5 * F.stddev_pop("score")).alias("_cut"))
        out = out.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") >= F.col("_cut"))  # one row
    else:
        out = both.withColumns({"score": F.greatest("if_score", "lof_score"), "is_anomaly": F.col("if_flag") | F.col("lof_flag")})
    return percentile_rank(out, "score", "percentile").select("row_id", "is_anomaly", "score", "percentile", "if_flag", "lof_flag")


def summary(scores: DataFrame) -> DataFrame:
    """Threshold (the smallest flagged score, else 100), number and rate of anomalies, mean and deviation."""
    n, hit = F.count("*"), F.count_if("is_anomaly")
    return scores.agg(F.coalesce(F.min(F.when(F.col("is_anomaly"), F.col("score"))), F.lit(100.0)).alias("threshold"), n.alias("total"), hit.alias("anomalies"), (100 * hit / n).alias("rate"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def detect(rows: DataFrame, dim: int, contamination: float = 0.1, algorithm: str = "isolation_forest") -> DataFrame:
    return ensemble(rows, dim, contamination) if algorithm == "ensemble" else AnomalyDetector(algorithm, contamination).fit_predict(rows, dim)


def risk_scores(rows: DataFrame, dim: int, contamination: float = 0.1) -> DataFrame:
    return detect(rows, dim, contamination).select("row_id", "score")


def capped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

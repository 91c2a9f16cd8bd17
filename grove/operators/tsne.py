"""t-SNE of any number of rows: landmarks are laid out together, every other row finds its own place among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.operators.sums import matrix
from grove.storage import sealed

#: So many landmarks at most, laid out in one task; steps of a row among them.
LANDMARKS, PERPLEXITY, SEED, STEPS = 2000, 30.0, 42, 40


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


def affinities(d: np.ndarray, goal: float) -> np.ndarray:
    """Each row's chances of neighbours at squared distances ``d`` (infinite: none), with the entropy ``goal``."""
    d = d - d.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    finite = np.where(np.isfinite(d), d, 0.0)
    for _ in range(60):
        e = np.exp(-d * beta[:, None])
        total = e.sum(axis=1)
        entropy = np.log(total) + beta * (e * finite).sum(axis=1) / total
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return e / total[:, None]


def layout(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Coordinates of all rows together, from scaled principal components on, with gains and early exaggeration."""
    n = len(x)
    d = squares(x, x)
    np.fill_diagonal(d, np.inf)
    p = affinities(d, np.log(max(1.0, min(PERPLEXITY, (n - 1) / 3)))) if n > 1 else np.zeros((n, n))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    middle = x - x.mean(axis=0)
    y = middle @ np.linalg.svd(middle, full_matrices=False)[2][:k].T
    y = np.pad(y, ((0, 0), (0, k - y.shape[1])))
    y *= 1e-4 / max(y[:, 0].std(), 1e-12)
    y += np.random.default_rng(SEED).standard_normal(y.shape) * 1e-6
    v, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(rounds):
        near = 1 / (1 + squares(y, y))
        np.fill_diagonal(near, 0)
        w = (p * (12 if step < 100 else 1) - near / max(near.sum(), 1e-300)) * near
        slope = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        gain = np.maximum(np.where((slope > 0) != (v > 0), gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if step < 100 else 0.8) * v - max(n / 48, 50) * gain * slope
        y = y + v
    return y


def placed(x: np.ndarray, marks: np.ndarray, at: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Coordinates of rows among fixed landmarks: drawn to near ones, pushed off by all, from their neighbours' mean on."""
    p = affinities(squares(x, marks), np.log(max(1.0, min(PERPLEXITY, (len(marks) - 1) / 3))))
    y, v = p @ at, 0.0
    for _ in range(steps):
        near = 1 / (1 + squares(y, at))
        w = (p - near / near.sum(axis=1, keepdims=True)) * near
        slope = w.sum(axis=1)[:, None] * y - w @ at
        v = 0.5 * v - slope / np.maximum((p * near).sum(axis=1)[:, None], 1e-12) / 2  # by the pull's own stiffness
        y = y + v
    return y


def tsne(rows: DataFrame, k: int = 2, rounds: int = 500, landmarks: int = LANDMARKS) -> DataFrame:
    """``row_id, features``: k coordinates of each row.

    Landmarks are the ``landmarks`` rows with the smallest hashed ids, or all if there are no more. They are laid out
    in one task; all others are placed batch by batch where they are, so the work grows with the rows.
    """
    some = rows.select("row_id", F.transform("features", lambda v: v.cast("double")).alias("features")).orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("row_id")
        return f.assign(at=list(layout(matrix(f), k, rounds)))

    fitted = sealed(some.groupBy(F.lit("landmarks")).applyInPandas(fit, "row_id long, features array<double>, at array<double>")).orderBy("row_id").collect()
    if not fitted:
        return rows.select("row_id", "features")
    marks, at = np.array([r["features"] for r in fitted]), np.array([r["at"] for r in fitted])
    known = {r["row_id"]: i for i, r in enumerate(fitted)}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 500):
                g = f.iloc[a : a + 500]
                own = np.array([known.get(i, -1) for i in g["row_id"]])
                y = np.zeros((len(g), k))
                y[own >= 0] = at[own[own >= 0]]
                if (own < 0).any():
                    y[own < 0] = placed(matrix(g)[own < 0], marks, at)
                yield pd.DataFrame({"row_id": g["row_id"], "features": list(y)})

    return rows.select("row_id", "features").mapInPandas(place, "row_id long, features array<double>")

"""Distance joins against all pairs, and the exact quantile."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.operators import cluster, fusion, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i * 3 - 50, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


def blobs(n, centers=12, dim=3, seed=0):
    r = np.random.default_rng(seed)
    return r.uniform(-40, 40, (centers, dim))[r.integers(0, centers, n)] + r.standard_normal((n, dim))


SETS = {
    "blobs": blobs(600), "noise": np.random.default_rng(1).standard_normal((200, 16)), "same": np.zeros((70, 2)), "one": np.ones((1, 2)),
    "grid": np.array([(i, j) for i in range(15) for j in range(15)], float), "half same": np.r_[np.zeros((90, 3)), blobs(90)],
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("block", [2000, 40])
def test_joins_match_all_pairs(spark, name, block):
    x = SETS[name]
    d, ids, rows = neighbours.apart(x, x), [i * 3 - 50 for i in range(len(x))], frame(spark, x)
    near = {(r["a"], r["b"]) for r in neighbours.distances(rows, eps=1.0, block=block).collect()}
    assert near == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= 1.0), strict=True)}
    got = {}
    for r in neighbours.distances(rows, k=4, block=block).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append((round(r["d"], 9), r["b"]))
    for i in range(len(x)):
        want = sorted((round(d[i, j], 9), ids[j]) for j in range(len(x)) if j != i)[:4]
        assert got.get(ids[i], []) == want


def test_empty_rows(spark):
    rows = frame(spark, np.zeros((0, 2)))
    assert neighbours.distances(rows, eps=1.0).count() == neighbours.distances(rows, k=3).count() == 0


def test_less_is_compared_on_clustered_rows(spark):
    shares = {n: (neighbours.share_of_pairs(frame(spark, blobs(n, 60)), eps=1.0, block=50), neighbours.share_of_pairs(frame(spark, blobs(n, 60)), k=5, block=50)) for n in (400, 1600)}
    print("share of pairs compared, within 1.0 and for 5 neighbours:", shares)
    assert all(shares[1600][i] < shares[400][i] and shares[1600][i] < 0.25 for i in (0, 1))


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantile_is_exact(spark, few):
    r = np.random.default_rng(2)
    for v in (r.standard_normal(500), np.r_[np.zeros(300), r.lognormal(0, 8, 200)], np.zeros(9), np.array([5.0]), r.integers(0, 4, 100).astype(float)):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
        for q in (0.1, 1.0):
            assert fusion.quantile(df, "v", q, bins=8, few=few) == pytest.approx(df.agg(F.percentile("v", q)).first()[0], rel=1e-12, abs=1e-300)
    assert fusion.quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None


def test_density_clusters_over_small_units(spark, monkeypatch):
    rows = frame(spark, blobs(300, 5, seed=4))
    want = sorted(map(tuple, cluster.dbscan(rows, 1.5).collect()))
    original = neighbours.distances
    monkeypatch.setattr(cluster, "distances", lambda rows, eps: original(rows, eps=eps, block=20))
    assert sorted(map(tuple, cluster.dbscan(rows, 1.5).collect())) == want

"""Hierarchies, k-means, one-class machines and graph training against plain versions that hold all rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from grove.operators import anomaly, cluster, embed, gcn, hierarchy, tsne, vectors
from grove.plans import pipeline
from grove.sources import tables


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


def labels_of(df):
    return [r["cluster"] for r in df.orderBy("row_id").collect()]


def plain_linkage(x, k, method):
    """Merges the two closest clusters, measured anew from their rows each time."""
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def between(a, b):
        if method == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        return {"single": np.min, "complete": np.max, "average": np.mean}[method](d[np.ix_(a, b)])

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: between(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    out = [0] * len(x)
    for n, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = n
    return out


def test_hierarchies_match_plain_merging(spark):
    x = np.random.default_rng(5).standard_normal((70, 3)) * [3, 2, 1]
    rows = frame(spark, x).repartition(3)
    for method in ("ward", "complete", "average"):
        assert labels_of(hierarchy.compact(rows, 6, method)) == plain_linkage(x, 6, method)
    assert labels_of(hierarchy.single(rows, 12, block=20)) == plain_linkage(x, 12, "single")
    assert labels_of(hierarchy.single(frame(spark, np.zeros((5, 2))), 2)) in ([0, 0, 0, 0, 1], [0, 1, 1, 1, 1], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0])
    assert labels_of(cluster.hierarchical(rows.limit(1), 3, "ward")) == [0]


def test_hierarchies_of_files_read_in_parts_without_rows(spark):
    """A file with one group of rows, read in many parts: rows are in one of them, the others have none."""
    x = np.random.default_rng(13).standard_normal((70, 3)) * [3, 2, 1]
    rows, name = frame(spark, x).coalesce(1), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300b")
    try:
        for method in ("ward", "complete", "average"):
            assert labels_of(hierarchy.compact(rows, 6, method)) == plain_linkage(x, 6, method)
    finally:
        spark.conf.set(name, before)


def test_hierarchies_of_repeated_rows_end():
    """Rows of length 1 as 32-bit numbers, each several times: rounded distances used to lead chains in circles."""
    r = np.random.default_rng(0)
    for trial in range(60):
        n = int(r.integers(40, 160))
        base = r.standard_normal((int(r.integers(2, n)), 64))
        base = (base / np.sqrt((base**2).sum(axis=1))[:, None]).astype(np.float32).astype(float)
        kind, size = r.integers(0, len(base), n), r.integers(1, 6, n).astype(float)
        x = base[kind] * size[:, None] * 3 / (size[:, None] * 3)
        d = np.maximum((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * x @ x.T, 0)
        d = 2 * d * size[:, None] * size / (size[:, None] + size)
        k = min(8, len(np.unique(kind)))
        got = hierarchy.merged(d, size, k, "ward")
        assert len(np.unique(got)) == k, trial
        assert all(len(np.unique(got[kind == c])) == 1 for c in np.unique(kind)), trial  # what is equal stays together


def test_hierarchies_of_many_rows(spark):
    r = np.random.default_rng(6)
    truth = r.integers(0, 5, 20_000)
    rows = frame(spark, np.eye(5)[truth] * 60 + r.standard_normal((20_000, 5))).repartition(8)
    first = {t: i for i, t in enumerate(dict.fromkeys(truth))}
    assert labels_of(cluster.hierarchical(rows, 5, "ward")) == [first[t] for t in truth]


def test_one_class_machine_agrees_with_pairwise_steps(spark):
    r = np.random.default_rng(7)
    x = np.r_[r.standard_normal((1700, 8)), r.standard_normal((300, 8)) * 3]
    x = (x - x.mean(axis=0)) / x.std(axis=0)  # as the detector does
    nu, gamma = 0.1, 1 / 8
    k = np.exp(-gamma * np.maximum((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * x @ x.T, 0))
    top, a = 1 / (nu * len(x)), np.zeros(len(x))
    a[: int(nu * len(x))] = top
    g = k @ a
    for _ in range(20_000):
        i, j = np.argmin(np.where(a < top - 1e-12, g, np.inf)), np.argmax(np.where(a > 1e-12, g, -np.inf))
        if g[j] - g[i] < 1e-7:
            break
        step = min((g[j] - g[i]) / max(2 - 2 * k[i, j], 1e-12), top - a[i], a[j])
        a[i], a[j], g = a[i] + step, a[j] - step, g + step * (k[:, i] - k[:, j])
    rows = frame(spark, x).repartition(4)
    model = anomaly.OneClassSVM(nu).fit(rows)
    got = model(x)
    odd, want = -got < model.rho - 1e-6 * abs(model.rho), a > top - 1e-9  # surely outside the boundary
    both, same = (odd & want).sum() / want.sum(), (odd == want).mean()
    print("share of the exact machine's outliers found:", both, "rows judged alike:", same, "correlation of scores:", np.corrcoef(got, -g)[0, 1])
    assert both > 0.9 and same > 0.97 and np.corrcoef(got, -g)[0, 1] > 0.98 and odd.mean() <= nu


def test_graphs_train_as_in_a_plain_loop(spark):
    r = np.random.default_rng(8)
    data = []
    for i in range(9):
        n = int(r.integers(3, 9))
        src = list(range(1, n)) + list(range(n - 1))
        dst = list(range(n - 1)) + list(range(1, n))
        data.append((f"f{i}", [int(t) for t in r.integers(0, 20, n)], src, dst, float(i % 3) / 3))
    rows = spark.createDataFrame(data, "filepath string, types array<int>, src array<int>, dst array<int>, target double").repartition(3)
    w, losses = gcn.train(rows, epochs=6, steps=1)
    plain, m, s, want = gcn.fresh(), {}, {}, []
    for t in range(1, 7):
        total, sums = 0.0, {}
        for name, types, src, dst, target in data:
            kept = (np.random.default_rng([42, t, zlib.crc32(name.encode())]).random(32) >= 0.5) / 0.5
            loss, g = gcn.gradients(plain, *gcn._inputs(types, src, dst), target, kept)
            total += loss
            sums = {k: sums.get(k, 0) + v / len(data) for k, v in g.items()}
        for k, g in sums.items():
            m[k], s[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.999 * s.get(k, 0) + 0.001 * g * g
            plain[k] = plain[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        want.append(total / len(data))
    assert losses == pytest.approx(want, rel=1e-9) and all(np.allclose(w[k], plain[k]) for k in plain)
    assert gcn.train(rows.limit(0), epochs=2)[1] == []


def test_k_means_of_several_sizes_share_their_rounds(spark):
    r = np.random.default_rng(9)
    x = r.uniform(-30, 30, (6, 4))[r.integers(0, 6, 400)] + r.standard_normal((400, 4))
    rows = frame(spark, x).repartition(3)
    k, tried = cluster.optimal_k(rows, (4, 8))
    assert k == 6 and [t["k"] for t in tried] == [4, 5, 6, 7, 8]
    for t in tried:
        (c, cost), = cluster.fitted(rows, [t["k"]])
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert cost == pytest.approx(t["inertia"]) == pytest.approx(d.min(axis=1).sum())
        assert np.allclose(c, [x[own == i].mean(axis=0) for i in range(len(c))], atol=1e-5)


def test_landmarks_keep_neighbours(spark):
    r = np.random.default_rng(10)
    x = r.uniform(-6, 6, (12, 10))[r.integers(0, 12, 1500)] + r.standard_normal((1500, 10))
    got = tsne.tsne(frame(spark, x).repartition(4), landmarks=400).orderBy("row_id").collect()
    y = np.array([g["features"] for g in got])
    far, near, k, n = tsne.squares(x, x), tsne.squares(y, y), 12, len(x)
    np.fill_diagonal(far, -1)
    np.fill_diagonal(near, np.inf)
    rank = np.argsort(np.argsort(far, axis=1), axis=1)
    lost = np.maximum(np.take_along_axis(rank, np.argpartition(near, k, axis=1)[:, :k], 1) - k, 0).sum()
    trust = 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * lost
    print("trustworthiness with 400 landmarks of 1500 rows:", trust)
    assert trust > 0.95
    assert [len(g["features"]) for g in tsne.tsne(frame(spark, x[:2]), rounds=20).collect()] == [2, 2]
    assert tsne.tsne(frame(spark, x[:0])).count() == 0


def test_main_axes_match_numpy(spark):
    r = np.random.default_rng(11)
    x = (r.random((300, 60)) < 0.1) * r.random((300, 60)) + (r.random((300, 4)) < 0.3) @ r.random((4, 60))
    long = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    rows = vectors.compressed(spark.createDataFrame(long, "id long, pos int, weight double").repartition(5))
    values, axes = vectors.singular(rows, 60, 8, power=8)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    best = x - x @ v[:8].T @ v[:8]
    assert np.allclose(values[:4], s[:4], rtol=1e-6) and (values <= s[:8] + 1e-9).all()  # those above the noise; no others can be larger
    assert np.linalg.norm(x - x @ axes @ axes.T) < 1.001 * np.linalg.norm(best)
    docs = spark.createDataFrame([(i,) for i in range(300)] + [(999,)], "id long")
    got = {e["id"]: np.array(e["embedding"]) for e in vectors.projected(rows, docs, "id", axes, 10).collect()}
    assert all(np.allclose(got[i], np.r_[x[i] @ axes, 0, 0], atol=1e-5) for i in range(300)) and not got[999].any()


def test_embeddings_from_sql(spark):
    files = spark.createDataFrame([("a", "def foo(bar): return bar"), ("b", "class K: foo = 1"), ("c", None), ("d", "42")], "filepath string, code string")
    model = vectors.tfidf_fit(files, "filepath", "code", 20)
    want = {r["filepath"]: r["embedding"] for r in embed.code_embeddings(files, dim=20).collect()}
    assert pipeline.registered(spark, embed.tfidf_encoder(model, 20), 20) == ["ast_nodes", "clean_code", "embed"]
    files.createOrReplaceTempView("some_files")
    got = {r["filepath"]: r["e"] for r in spark.sql("SELECT filepath, embed(code) AS e FROM some_files").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    small = embed.code_embeddings(files, dim=20, components=2).collect()
    assert all(len(r["embedding"]) == 2 for r in small) and {r["filepath"] for r in small if not any(r["embedding"])} == {"c", "d"}


def test_a_matrix_is_read_by_ranges(spark, tmp_path):
    x = np.random.default_rng(12).standard_normal((5000, 16))
    np.save(tmp_path / "m.npy", x)
    names = [f"f{i}" for i in range(5000)]
    got = tables.read_matrix(spark, str(tmp_path / "m.npy"), names, split_bytes=100_000)
    parts = spark.read.format("npy_matrix").option("path", str(tmp_path / "m.npy")).option("split_bytes", 100_000).load()
    assert parts.rdd.getNumPartitions() == 7
    rows = got.orderBy("row_id").collect()
    assert np.allclose([r["embedding"] for r in rows], x) and [r["filepath"] for r in rows] == names
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(ValueError, match="row order"):
        tables.read_matrix(spark, str(tmp_path / "f.npy"), names)

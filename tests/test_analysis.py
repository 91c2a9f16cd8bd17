"""Scaling, clusters, anomalies, store, configuration and reports."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove import config
from grove.operators import anomaly, cluster, embed, fusion, gcn, profile, store, vectors
from grove.plans import report
from grove.sources import files as sources


def rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(42)
    return rows(spark, np.concatenate([r.normal(m, 0.3, (20, 3)) for m in (0, 5, 10)]))


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["cluster"], set()).add(r["row_id"])
    return sorted(map(sorted, out.values()))


def test_all_algorithms_find_separate_blobs(blobs):
    truth = [list(range(0, 20)), list(range(20, 40)), list(range(40, 60))]
    assert groups(cluster.kmeans(blobs, 3, starts=3)[0]) == truth
    assert groups(cluster.dbscan(blobs, 2.0)) == truth
    for linkage in ("ward", "complete", "average", "single"):
        assert groups(cluster.hierarchical(blobs, 3, linkage)) == truth
    assert cluster.quality(blobs, cluster.dbscan(blobs, 2.0), 3)["silhouette"] > 0.8


def test_noise_and_border(spark):
    x = rows(spark, [[0], [1], [2], [3.5], [50]])
    assert {r["row_id"]: r["cluster"] for r in cluster.dbscan(x, 1.5).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def test_components_match_numpy(blobs):
    x = np.array([r["features"] for r in blobs.orderBy("row_id").collect()])
    got = np.array([r["features"] for r in cluster.pca(blobs, 3, 2).orderBy("row_id").collect()])
    _, _, v = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ v[:2].T), atol=1e-8)


def test_constant_columns_become_zero(spark):
    got = fusion.standardized(rows(spark, [[1, 5], [3, 5]]), "features", 2).orderBy("row_id").collect()
    assert [list(r["features"]) for r in got] == [[-1.0, 0.0], [1.0, 0.0]]


def test_outliers_are_found(spark):
    r = np.random.default_rng(42)
    x = rows(spark, np.concatenate([r.normal(5, 2, (80, 10)), r.normal(25, 2, (20, 10))]))
    for algorithm in ("isolation_forest", "one_class_svm"):
        got = anomaly.detect(x, 10, 0.2, algorithm).collect()
        assert len(got) == 100 and all(0 <= g["score"] <= 100 and 0 <= g["percentile"] <= 100 for g in got)
    got = anomaly.detect(x, 10, 0.2).where("is_anomaly and row_id >= 80").count()
    assert got > 15
    soft, hard = (anomaly.ensemble(x, 10, 0.2, v) for v in ("soft", "hard"))
    assert soft.where("is_anomaly and row_id >= 80").count() > 5 and hard.count() == 100
    with pytest.raises(ValueError, match="Unknown algorithm"):
        anomaly.AnomalyDetector("nope").fit(x, 10)
    with pytest.raises(RuntimeError):
        anomaly.AnomalyDetector().predict(x)
    with pytest.raises(ValueError):
        anomaly.ensemble(x.limit(1), 10)


def test_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([("a.py", "x", [1.0]), ("b.py", "y", [2.0])], "filepath string, code string, embedding array<float>")
    assert s.count() == 0 and s.add(files.limit(0)) == 0
    assert s.add(files) == 2
    new = spark.createDataFrame([("b.py", "z", [3.0]), ("c.py", "w", [4.0]), ("a.py", "x", [9.0])], "filepath string, code string, embedding array<float>")
    assert {r["filepath"] for r in store.new_or_changed(new, s.all()).collect()} == {"b.py", "c.py"}
    s.add(store.new_or_changed(new, s.all()))
    asked = spark.createDataFrame([(0, "c.py"), (1, "no.py"), (2, "a.py")], "pos int, filepath string")
    assert [r["embedding"] for r in store.lookup(s.all(), asked).collect()] == [[4.0], None, [1.0]]
    assert s.count() == 3 and s.hashes().count() == 3
    s.clear()
    assert s.count() == 0


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(0, "def foo"), (1, "foo foo bar"), (2, None)], "id int, text string")
    model = vectors.tfidf_fit(docs, "id", "text", 10)
    assert [r["term"] for r in model.orderBy("pos").collect()] == ["bar", "def", "def foo", "foo", "foo bar", "foo foo"]
    d = vectors.dense(vectors.tfidf(docs, model, "id", "text"), docs, "id", 6)
    assert {r["id"]: round(sum(v * v for v in r["embedding"]), 5) for r in d.collect()} == {0: 1.0, 1: 1.0, 2: 0.0}
    e = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in e.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]


def test_encoder_falls_back(spark):
    def fail(xs):
        raise RuntimeError("no device")

    assert embed.encoded(["a", "b"], fail, lambda xs: np.ones((len(xs), 2)), 2).tolist() == [[1, 1], [1, 1]]
    assert embed.encoded(["a"], fail, None, 2).tolist() == [[0, 0]]


def test_graph_network_learns():
    x, spread = gcn._inputs([0, 1, 2], [0, 1, 0, 2], [1, 0, 2, 0])
    w = gcn.fresh()
    loss, g = gcn.gradients(w, x, spread, 0.3)
    for k, at in (("w0", (1, 3)), ("w2", (5, 7)), ("b1", (2,)), ("w", (4, 0))):
        up = {n: v.copy() for n, v in w.items()}
        up[k][at] += 1e-6
        assert abs((gcn.gradients(up, x, spread, 0.3)[0] - loss) / 1e-6 - g[k][at]) < 1e-3
    assert gcn.forward(w, x, spread)[1].shape == (32,)


def test_profiles(spark):
    x = rows(spark, [[1, 10], [3, 10], [100, 0]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, -1)], "row_id long, cluster int")
    p = profile.profiles(x, labels, ["loop_count", "cyclomatic_complexity"]).first()
    assert (p["size"], round(p["percentage"], 2), p["means"]["loop_count"], p["stds"]["loop_count"], list(p["representatives"])) == (2, 66.67, 2.0, 1.0, [0, 1])
    assert p["description"] == f"Cluster {p['cluster']}: high complexity"


def test_config(tmp_path):
    assert config.load_config(tmp_path / "none.yaml") == config.ProjectConfig()
    made = config.save_config(tmp_path / "c.yaml", config.get_preset("strict"))
    assert config.load_config(made) == config.get_preset("strict")
    (tmp_path / "c.yaml").write_text("- a\n- b\n")
    assert config.load_config(made) == config.ProjectConfig()
    (tmp_path / "c.yaml").write_text("analysis:\n  n_clusters: 4\n")
    assert config.load_config(made).n_clusters == 4
    with pytest.raises(ValueError, match="Unknown preset"):
        config.get_preset("x")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("<a>.py", 70.0, 0, True), ("b.py", 20.0, 1, False)], "filename string, risk_score double, cluster int, is_anomaly boolean")
    page = report.html_report(df, [{"cluster_id": 0, "size": 2, "percentage": 100.0, "description": "d & e"}], tmp_path / "r.html", "T <x>").read_text()
    assert "&lt;a&gt;.py" in page and "T &lt;x&gt;" in page and "d &amp; e" in page and "<a>.py" not in page
    assert report.html_report(df.limit(0), [], tmp_path / "e.html").exists()
    assert report.html_report(df.select("filename"), [], tmp_path / "m.html").exists()
    assert [r["n"] for r in report.histogram(df.limit(1), "risk_score", 4).orderBy("bin").collect()] == [0, 0, 1, 0]


def test_batches_shrink(spark):
    f = spark.createDataFrame([(f"{i:02}.py", "x") for i in range(11)], "path string, code string")
    got = sources.batches(f, 5, F.col("path") != "02.py").groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [4, 5, 1]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, data in {"a.py": b"x" * 50, "b.py": b"x" * 49, "c.py": b"\xff" * 60, "test_d.py": b"x" * 60, "e.txt": b"x" * 60}.items():
        (tmp_path / "src" / name).write_bytes(data)
    patterns = ("test_d.py",)
    assert [r["filename"] for r in sources.scan(spark, str(tmp_path), patterns=patterns).collect()] == ["a.py"]
    assert sources.lenient(spark, str(tmp_path)).count() == 3


def test_weighted_risk(spark):
    df = spark.createDataFrame([(50.0, 100.0), (None, 20.0), (500.0, 500.0)], "a double, b double")
    parts = {"anomaly": F.col("a"), "rule_based": F.col("b")}
    risk = lambda w: [round(r[0], 6) for r in df.select(fusion.weighted_risk(parts, w)).collect()]
    assert risk({"structural": 0.4, "anomaly": 0.3, "rule_based": 0.3}) == [75.0, 10.0, 100.0]
    assert risk({"anomaly": 3, "rule_based": 1}) == [62.5, 5.0, 100.0]
    assert risk({}) == risk({"structural": 1.0}) == [0.0, 0.0, 0.0]

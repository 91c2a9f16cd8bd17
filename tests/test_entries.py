"""The batch entries, the stream, tables from files, and plots' coordinates, end to end on small inputs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.config import ProjectConfig
from grove.operators import cluster, gcn
from grove.operators.ast_table import ast_nodes
from grove.operators.store import VectorStore
from grove.plans import pipeline, report
from grove.plans.corpus import source_corpus
from grove.sources import tables
from grove.streaming import incremental


@pytest.fixture(scope="module")
def corpus(spark):
    return source_corpus(spark.range(1, 45).withColumnRenamed("id", "doc_id")).select("filepath", "code")


def test_extract_and_analyse(spark, corpus, tmp_path):
    features = pipeline.extract(corpus)
    assert features.count() == 40  # every eleventh file is broken
    config = ProjectConfig(n_clusters=3, anomaly_algorithm="isolation_forest")
    vectors = corpus.select("filepath", F.array(F.length("code").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = pipeline.analyse(features, corpus, vectors, 2, config)
    scored = out.collect()
    low, high = (f(r["cyclomatic_complexity"] for r in scored) for f in (min, max))
    for r in scored:
        part = 100 * (r["cyclomatic_complexity"] - low) / (high - low) if high > low else 0
        w = config.risk_weights
        assert abs(r["combined_risk"] - (w["structural"] * part + w["anomaly"] * r["anomaly_score"] + w["rule_based"] * r["risk_score"])) < 1e-6
    assert out.count() == 40 and {"cluster", "risk_score", "risk_findings", "is_anomaly", "anomaly_score"} <= set(out.columns)
    info = pipeline.cluster_info(out)
    assert sum(r["size"] for r in info.collect()) == 40
    path = str(tmp_path / "csv")
    features.write.csv(path, header=True)
    again = tables.read_features(spark, path)
    assert again.count() == 40 and dict(again.dtypes)["has_recursion"] == "boolean"
    assert report.report_stats(out, 3)["total"] == 40


def test_run_writes_everything(spark, corpus, tmp_path, tmp_path_factory):
    src = tmp_path_factory.mktemp("source")  # no folder may be named like a test
    for i, r in enumerate(corpus.limit(12).collect()):
        (src / f"f{i}.py").write_text(r["code"] + "# " + "x" * 60)
    (src / "test_a.py").write_text("x = 1\n" * 20)
    config = ProjectConfig(algorithm="hierarchical", n_clusters=2, anomaly_algorithm="isolation_forest")
    load = lambda: lambda codes: np.array([[len(c), 1.0, c.count("def")] for c in codes], np.float32)
    out = tmp_path / "out"
    results = pipeline.run(spark, str(src), str(out), config, load, 3)
    n = results.count()
    assert n >= 10 and not any("test_a" in r["filepath"].rpartition("/")[2] for r in results.collect())
    read = lambda name: spark.read.parquet(str(out / name))
    assert read("features").count() == tables.read_features(spark, str(out / "features_csv")).count() == read("results").count() == n
    assert read("embeddings").count() == VectorStore(spark, str(out / "vector_store"), 3).count() == 12
    assert sum(json.loads(x)["size"] for f in (out / "cluster_info").glob("*.json") for x in f.read_text().splitlines()) == n
    assert {p.name for p in (out / "plots").iterdir()} == {"clusters", "risk_histogram", "riskiest", "importance"}
    assert "<h2>Clusters</h2>" in (out / "report.html").read_text()


def test_the_store_spares_the_encoder(spark, tmp_path):
    files = spark.createDataFrame([("a", "x"), ("b", "yy")], "filepath string, code string")
    store, encoded = VectorStore(spark, str(tmp_path / "s")), spark.sparkContext.accumulator(0)

    def encode(frames):
        for f in frames:
            encoded.add(len(f))
            yield f[["filepath"]].assign(embedding=[[float(len(c))] for c in f["code"]])

    make = lambda f: f.mapInPandas(encode, "filepath string, embedding array<float>")
    for rows, seen in ((files, 2), (files, 2), (files.withColumn("code", F.concat("filepath", F.lit("!"))), 4), (files.limit(1), 5)):
        assert pipeline.cached_embeddings(rows, store, make).count() == rows.count() and encoded.value == seen


def _vectors(spark, names, value=1.0):
    return spark.createDataFrame([(n, f"{n} {value}", [value]) for n in names], "filepath string, code string, embedding array<float>")


def test_a_broken_write_leaves_the_store_as_it_was(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    store.add(_vectors(spark, "a"))
    for kind in ("delta", "full"):  # broken off before _SUCCESS
        half = tmp_path / "v1" / kind / next((tmp_path / "v0" / "delta").glob("bucket=*")).name
        half.mkdir(parents=True)
        (half / "part-0.parquet").write_text("half")
    assert store.count() == 1
    store.add(_vectors(spark, "b"))
    store.add(_vectors(spark, "a", 2.0))
    assert {r["filepath"]: r["embedding"] for r in store.all().collect()} == {"a": [2.0], "b": [1.0]} and (tmp_path / "v2").exists()


def test_an_upsert_writes_its_buckets_only(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    names = [f"f{i}.py" for i in range(500)]
    assert store.add(_vectors(spark, names)) == 500
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert store.add(_vectors(spark, [*names[:9], "new.py"], 2.0)) == 10
    assert len(list((tmp_path / "v1").rglob("*.parquet"))) <= 10 and {p: p.stat().st_mtime_ns for p in before} == before
    got = {r["filepath"]: r["embedding"][0] for r in store.all().collect()}
    assert len(got) == 501 and all(got[n] == (2.0 if n in names[:9] else 1.0) for n in names) and got["new.py"] == 2.0
    asked = spark.createDataFrame([("new.py",), ("no.py",), ("f3.py",), ("f3.py",)], "filepath string")
    assert sorted((r["filepath"], r["embedding"][0]) for r in store.of(asked).collect()) == [("f3.py", 2.0), ("new.py", 2.0)]


def test_compaction_keeps_the_newest_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VectorStore, "MOST", 3)
    monkeypatch.setattr(VectorStore, "BUCKETS", 4)
    store, want = VectorStore(spark, str(tmp_path)), {}
    for step in range(7):
        names = [f"f{i}" for i in range(step, step + 6)]
        old = store.all()
        store.add(_vectors(spark, names, float(step)))
        assert {r["filepath"]: r["embedding"][0] for r in old.collect()} == want  # readers of the state before go on
        want |= {n: float(step) for n in names}
        assert {r["filepath"]: r["embedding"][0] for r in store.all().collect()} == want
    assert list(tmp_path.glob("v*/full/bucket=*")) and not (tmp_path / "v0").exists()
    assert store.compact(1) and store.count() == len(want)


def test_sql_functions(spark):
    assert pipeline.registered(spark) == ["ast_nodes", "clean_code"]
    assert spark.sql("SELECT clean_code('x = 1  # one') AS c").first()[0].strip() == "x = 1"
    rows = spark.sql("SELECT f.id, n.type, n.name FROM VALUES (1, 'def f(): pass'), (2, 'x ='), (3, NULL) AS f(id, code), LATERAL ast_nodes(f.code) AS n").collect()
    assert [r["name"] for r in rows if r["type"] == "FunctionDef"] == ["f"] and len([r for r in rows if r["id"] == 2]) == 1


def test_cleaned_files_lookup_demo_rows_and_plot_tables(spark, tmp_path):
    from grove.functions.text import write_cleaned

    files = spark.createDataFrame([("a/x.py", "x = 1  # c\n"), ("b/x.py", "'" * 3 + "d" + "'" * 3 + "\ny = 2\n"), ("c.py", None)], "filepath string, code string")
    write_cleaned(files, str(tmp_path / "clean"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "clean")).collect())) == [("a/x.py", "x.py", "x = 1\n"), ("b/x.py", "x.py", "y = 2\n")]
    rows = report.demo_rows(spark)
    assert rows.count() == 100 and rows.collect() == report.demo_rows(spark).collect() and report.dashboard_table(rows)
    assert [r["row_id"] for r in report.file_row(rows, "file_007.py").collect()] == [7] and report.file_row(rows, "none").count() == 0
    x = rows.select("row_id", F.array(F.col("risk_score"), F.col("complexity").cast("double"), F.col("function_count").cast("double")).alias("features"))
    points = report.cluster_points(x, rows.select("row_id", "cluster"), 3).collect()
    assert len(points) == 100 and all(p["size"] == sum(q["cluster"] == p["cluster"] for q in points) for p in points)
    assert report.elbow(spark, [{"k": 3, "inertia": 2.0, "silhouette": 0.5}]).first()[:] == (3, 2.0, 0.5)


def test_stream_upserts(spark, tmp_path, tmp_path_factory):
    src = tmp_path_factory.mktemp("incoming")
    (src / "a.py").write_text("x = 1\n" * 20)
    store = VectorStore(spark, str(tmp_path / "store"))
    embed = lambda df: df.select("filepath", F.array(F.length("code").cast("float")).alias("embedding"))
    incremental.follow(spark, str(src), store, embed, str(tmp_path / "cp")).awaitTermination()
    (src / "b.py").write_text("y = 2\n" * 20)
    (src / "short.py").write_text("y")
    incremental.follow(spark, str(src), store, embed, str(tmp_path / "cp")).awaitTermination()
    assert store.count() == 2


def test_matrix_with_names(spark, tmp_path):
    np.save(tmp_path / "e.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "e.json").write_text(json.dumps(["a", "b", "c"]))
    got = tables.read_matrix(spark, str(tmp_path / "e.npy"), str(tmp_path / "e.json")).orderBy("row_id").collect()
    assert [(r["filepath"], list(r["embedding"])) for r in got] == [("a", [0, 1]), ("b", [2, 3]), ("c", [4, 5])]
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "e.npy"), ["a"])


def test_graph_training_lowers_the_error(spark, corpus, tmp_path):
    rows = gcn.graphs(ast_nodes(corpus.limit(6))).withColumn("target", F.size("types") / 500)
    w, losses = gcn.train(rows, epochs=15)
    assert losses[-1] < losses[0]
    gcn.save(str(tmp_path / "w.npz"), w)
    assert all((gcn.load(str(tmp_path / "w.npz"))[k] == v).all() for k, v in w.items())


def test_reduced_coordinates(spark):
    r = np.random.default_rng(0)
    x = spark.createDataFrame([(i, [float(v) for v in r.normal(5 * (i % 2), 0.1, 4)]) for i in range(120)], "row_id long, features array<double>")
    got = {g["row_id"]: np.array(g["features"]) for g in cluster.reduced(x, 4, "tsne", 2, rounds=200).collect()}
    near = [np.linalg.norm(got[i] - got[j]) for i in got for j in got if i < j and (i - j) % 2 == 0]
    far = [np.linalg.norm(got[i] - got[j]) for i in got for j in got if (i - j) % 2]
    assert np.isfinite(near).all() and np.median(near) < np.median(far)

"""What reviews found: lone syntax nodes, distance joins over few large units, clusters from forests, sums, wide plans."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grove.functions import text
from grove.operators import ast_table, cluster, gcn, neighbours, rules, sums, vectors
from grove.plans.corpus import source_corpus
from grove.plans.queries import QUERIES


def documents(spark, path, ids):
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_lone_node_has_no_tree_edge(spark, tmp_path):
    got = {r["doc_id"]: (r["nodes"], r["edges"]) for r in QUERIES["ast_graph"](spark, documents(spark, tmp_path, [2160, 11, 1])).collect()}
    assert got[2160] == (1, 0) and sorted(got) == [1, 2160]
    assert got[1][1] == 2 * (got[1][0] - 1) > 0


SETS = {"blobs": np.random.default_rng(0).uniform(-40, 40, (5, 3))[np.random.default_rng(1).integers(0, 5, 400)] + np.random.default_rng(2).standard_normal((400, 3)), "noise": np.random.default_rng(3).standard_normal((300, 16)), "far": 1e6 + np.round(np.random.default_rng(4).standard_normal((150, 3)), 1), "same": np.ones((90, 2))}
REACH = {"blobs": 0.5, "noise": 4.0, "far": 0.5, "same": 0.0}


def frame(spark, x):
    return spark.createDataFrame([(i * 7 - 50, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")


@pytest.mark.parametrize("name", SETS)
def test_few_large_units_give_what_all_pairs_give(spark, monkeypatch, name):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    monkeypatch.setattr(neighbours, "AT_ONCE", 900)
    x, eps = SETS[name], REACH[name]
    d, ids, rows = neighbours.apart(x, x), np.arange(len(x)) * 7 - 50, frame(spark, x)
    if name in ("noise", "far", "same"):  # no row is sent to more than some units, however many small ones there would be
        cells, _, met = neighbours._placed(rows, eps, None, None)
        assert cells.count() <= 3 * neighbours.UNITS and sum(n for *_, n in met) <= 3 * neighbours.UNITS * len(x)
    assert {r["row_id"]: r["near"] for r in neighbours.counted(rows, eps).collect()} == dict(zip(ids.tolist(), (d <= eps).sum(axis=1).tolist(), strict=True))
    assert sorted((r["a"], r["b"]) for r in neighbours.distances(rows, eps=eps).collect()) == sorted((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(d <= eps), strict=True))
    got = sorted((r["a"], r["rank"], r["b"]) for r in neighbours.distances(rows, k=4).collect())
    far = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    assert got == sorted((int(ids[i]), n + 1, int(ids[j])) for i in range(len(x)) for n, j in enumerate(np.lexsort((ids, far[i]))[:4]))


@pytest.mark.parametrize("name", SETS)
def test_density_clusters_by_forests(spark, monkeypatch, name):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    x, eps, least = SETS[name], REACH[name], 4
    near = neighbours.apart(x, x) <= eps
    core, root = near.sum(axis=1) >= least, np.arange(len(x))
    for i, j in zip(*np.nonzero(near & core[:, None] & core), strict=True):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    number = {r: n for n, r in enumerate(sorted(set(root[core])))}
    want = [number[root[i]] if core[i] else min((number[root[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    assert [r["cluster"] for r in cluster.dbscan(frame(spark, x), eps, least).orderBy("row_id").collect()] == want


def test_silhouette_over_few_blocks(spark, monkeypatch):
    x = np.r_[SETS["blobs"], SETS["blobs"][:20]]
    labels = np.random.default_rng(5).integers(0, 4, len(x))
    labels[0] = 9
    rows = frame(spark, x)
    of = spark.createDataFrame([(i * 7 - 50, int(c)) for i, c in enumerate(labels)], "row_id long, cluster int")
    d, s = neighbours.apart(x, x), []
    for i, c in enumerate(labels):
        mean = {k: d[i, labels == k].sum() / ((labels == k).sum() - (k == c) or 1) for k in set(labels)}
        other = min(v for k, v in mean.items() if k != c)
        s.append((other - mean[c]) / max(other, mean[c]) if (labels == c).sum() > 1 else 0.0)
    left, _ = cluster._blocks(rows, None)
    assert left.count() <= neighbours.UNITS * len(x)
    for block in (None, 50):
        got = cluster.cluster_distances(rows, of, ["cluster"], block)
        assert got.count() == len(x) * 5 and got.agg(F.sum("s")).first()[0] == pytest.approx(d.sum())
    assert cluster.silhouette(rows, of).first()[0] == pytest.approx(np.mean(s))


def test_one_sum_reaches_the_driver(spark):
    rows = frame(spark, np.ones((200, 2))).repartition(40)
    made = sums.added(rows, lambda f: sums.matrix(f).sum(axis=0))
    assert [list(r["v"]) for r in made.collect()] == [[200.0, 200.0]] and list(sums.summed(rows, lambda f: sums.matrix(f).sum(axis=0))) == [200.0, 200.0]
    assert sums.summed(rows.where("row_id < -99"), lambda f: np.zeros(1)) is None


def test_graphs_are_made_where_files_are_parsed(spark):
    files = source_corpus(spark.createDataFrame([(i,) for i in (1, 11, 59, 2160)], "doc_id long")).select("filepath", "code")
    files = files.union(spark.createDataFrame([("none", None), ("large", "x = 1\n" * 2000)], "filepath string, code string"))
    want = sorted(map(tuple, gcn.graphs(ast_table.ast_nodes(files)).collect()))
    assert len(want) == 3 and sorted(map(tuple, gcn.parsed_graphs(files).collect())) == want


def test_relations_from_the_columns_they_read(spark):
    files = source_corpus(spark.createDataFrame([(i,) for i in (7, 11, 59, 1234)], "doc_id long"))
    full = ast_table.ast_nodes(files)
    for made, asked in ((ast_table.functions, ast_table.OF_FUNCTIONS), (ast_table.classes, ast_table.OF_CLASSES), (ast_table.imports, ast_table.OF_IMPORTS), (ast_table.summaries, {"columns": ast_table.OF_SUMMARIES})):
        assert sorted(map(str, made(ast_table.ast_nodes(files, **asked)).collect())) == sorted(map(str, made(full).collect()))


def test_white_space_is_normalised_where_code_is_cleaned(spark):
    odd = [f"x = 1{c}\n\n{c}{c}\n{c}\n\n\ny = 2 {c}" for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])]
    rows = spark.createDataFrame([(x,) for x in [*odd, "", " \n\t", "\n\nx\n\n\n\n\n\ny \t\n", "a\n\n\nb", "def ( \n"]], "c string")
    assert all(r[0] == text.tidied(r[1]) for r in rows.select(text.normalized(F.col("c")), "c").collect())
    files = spark.createDataFrame([('"""d"""\nx = 1  # c  \n\n\n\n\n\ny\t\n',), ("def ( \n",), (None,), ("",)], "c string").select(text.cleaned(F.col("c")).alias("c"))
    assert [r["c"] for r in files.collect()] == ["x = 1\n\n\ny\n", "def ( \n", None, ""]
    assert "regexp_replace" not in files._jdf.queryExecution().toString()  # one pass, not more over the text in the JVM


def test_findings_come_from_one_aggregation(spark):
    code = "def f():\n    a, _b, c = 1, 2, 3\n    a = c = 9\n    def g():\n        a = 7\n        return c\n    try:\n        f()\n    except Exception:\n        def h():\n            raise\n    return [3, 4, 5]\ntry:\n    x\nexcept BaseException:\n    f()\n"
    files = spark.createDataFrame([("a", code), ("b", "def ("), ("c", "x = 1\n"), ("d", None)], "filepath string, code string")
    found = rules.findings(ast_table.ast_nodes(files, columns=rules.COLUMNS, types=rules.TYPES))
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r["rule_id"], r["line_number"], r["ord"], r["message"].split()[-1]) for r in found.where("filepath = 'a'").collect() if r["rule_id"] in ("UNUSED_VARIABLE", "MAGIC_NUMBER", "BROAD_EXCEPTION", "RECURSION_NO_BASE"))
    assert [x[:2] + x[3:] for x in got if x[0] != "MAGIC_NUMBER"] == [("BROAD_EXCEPTION", 15, "again"), ("RECURSION_NO_BASE", 1, "condition"), ("UNUSED_VARIABLE", 1, "a"), ("UNUSED_VARIABLE", 4, "a")]
    assert sorted(x[2] for x in got if x[0] == "MAGIC_NUMBER") == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in found.where("filepath != 'a'").select("filepath", "rule_id", "severity", "ord").collect()] == [("b", "SYNTAX_ERROR", "critical", 0)]


def test_vocabulary_counts_only_terms_that_may_belong(spark):
    r = np.random.default_rng(6)
    texts = [" ".join(f"W{int(k)}" if k % 3 else f"\u0130w{int(k)}-9" for k in r.zipf(1.3, 200) % 5000) for _ in range(150)] + [None, "", "a"]
    total, df = Counter(), Counter()
    for x in texts:
        total.update(vectors.terms(x))
        df.update(set(vectors.terms(x)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for size in (30, 10**6):
        want = sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
        got = vectors.tfidf_fit(docs, "doc_id", "text", size).orderBy("pos").collect()
        assert [x["term"] for x in got] == want and [x["idf"] for x in got] == pytest.approx([math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in want])
    passes = np.zeros(vectors.COUNTERS, bool)
    passes[vectors._Terms(["w1"]).slot] = True
    rows = [x for b in vectors._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]), passes) for x in b.to_pylist()]
    assert {x["term"]: (x["total"], x["df"]) for x in rows}["w1"] == (total["w1"], df["w1"]) and len(rows) < 0.01 * len(total)

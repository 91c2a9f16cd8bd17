"""The two batch entries: extracting features from source files, and analysing a feature table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.config import ProjectConfig
from grove.functions.text import basename, cleaned, guarded
from grove.operators import anomaly, cluster, fusion, gcn, profile
from grove.operators.ast_table import NodeColumns, ast_nodes
from grove.operators.embed import code_embeddings, embed, register_embed
from grove.operators.rules import COLUMNS as RULED
from grove.operators.rules import TYPES as RULED_TYPES
from grove.operators.rules import findings, risk
from grove.operators.store import VectorStore, new_or_changed
from grove.operators.structural import COLUMNS as STRUCTURE
from grove.operators.structural import TYPES as STRUCTURE_TYPES
from grove.operators.structural import FEATURES, available, structural, vector
from grove.plans.report import html_report, plot_data
from grove.sources.files import scan
from grove.storage import sealed, stored


def extract(files: DataFrame, config: ProjectConfig | None = None) -> DataFrame:
    """Features of ``filepath, code``: cleaned if configured, parsed once; files that don't parse drop out."""
    config = config or ProjectConfig()
    if config.clean_code:
        files = sealed(files.select("filepath", cleaned(F.col("code")).alias("code")))
    return structural(ast_nodes(files, columns=STRUCTURE, types=STRUCTURE_TYPES), files)


def analyse(features: DataFrame, files: DataFrame | None = None, embeddings: DataFrame | None = None, dim: int = 768, config: ProjectConfig | None = None) -> DataFrame:
    """``features`` with ``cluster, risk_score, risk_findings, is_anomaly, anomaly_score, combined_risk``; identity is the
    path throughout.

    Clusters come from the scaled blocks side by side, anomalies from the raw features, risks from the uncleaned files.
    ``combined_risk`` weighs the complexity (0 at the least, 100 at the most of all files), the anomaly and the rules as
    ``risk_weights`` says; without files or complexities, their weights are left out.
    """
    config = config or ProjectConfig()
    names = available(features)
    keyed = sealed(features.withColumn("row_id", F.xxhash64("filepath")).withColumn("raw", vector(features, names)))
    beside = fusion.STRUCTURAL_BESIDE if embeddings is not None else fusion.STRUCTURAL
    rows, width = fusion.standardized(keyed.select("row_id", "filepath", F.col("raw").alias("part")), "part", len(names), beside), len(names)
    if embeddings is not None:
        rows = fusion.standardized(fusion.aligned(rows, embeddings, dim), "embedding", dim, fusion.EMBEDDING)
        width += dim
    rows = sealed(fusion.fused(rows, "part", *(["embedding"] if embeddings is not None else [])).select("row_id", "features"))
    x = cluster.pca(rows, width, cluster.MOST_COMPONENTS) if width > cluster.MOST_COMPONENTS else rows
    n = x.count()
    if config.algorithm == "dbscan":
        labels = cluster.dbscan(x)
    elif config.algorithm == "hierarchical":
        labels = cluster.hierarchical(x, min(config.n_clusters or cluster.K, n))
    else:
        labels = cluster.kmeans(x, min(config.n_clusters or cluster.optimal_k(x)[0], n))[0]
    raw = keyed.select("row_id", F.col("raw").alias("features"))
    odd = anomaly.detect(raw, len(names), config.contamination, config.anomaly_algorithm)
    parts = {"anomaly": F.col("anomaly_score")}
    if "cyclomatic_complexity" in names:
        keyed = fusion.min_max(keyed, "cyclomatic_complexity", "_complexity")
        parts["structural"] = F.col("_complexity")
    out = keyed.drop("raw").join(labels, "row_id").join(odd.select("row_id", "is_anomaly", F.col("score").alias("anomaly_score")), "row_id")
    if files is not None:
        scores = risk(findings(stored(ast_nodes(files, columns=RULED, types=RULED_TYPES))).where("rule_id != 'SYNTAX_ERROR'"), files)
        out = out.join(scores.select("filepath", "risk_score", "risk_findings"), "filepath", "left")
        out = out.withColumns({"risk_score": F.coalesce("risk_score", F.lit(0.0)), "risk_findings": F.coalesce("risk_findings", F.lit(0))})
        parts["rule_based"] = F.col("risk_score")
    return out.withColumn("combined_risk", fusion.weighted_risk(parts, config.risk_weights)).drop("_complexity")


def cluster_info(results: DataFrame) -> DataFrame:
    """``cluster_id, size, percentage, description`` of the clusters of a result table."""
    names = [c for c in FEATURES if c in results.columns]
    rows = results.select("row_id", vector(results, names).alias("features"))
    return profile.profiles(rows, results.select("row_id", "cluster"), names).select(F.col("cluster").alias("cluster_id"), "size", "percentage", "description")


def cached_embeddings(files: DataFrame, store: VectorStore, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``filepath, embedding`` of all files; the encoder sees only what the store doesn't have yet or has another text of."""
    fresh = sealed(new_or_changed(files, store.of(files)))
    if not fresh.isEmpty():
        store.add(fresh.join(make(fresh), "filepath"))
    return files.select("filepath").join(store.of(files).select("filepath", "embedding"), "filepath")


def run(spark: SparkSession, directory: str, out: str | None = None, config: ProjectConfig | None = None, load: Callable | None = None, dim: int = 768) -> DataFrame:
    """Scan, extract, embed, analyse and write what both entries of the batch write.

    ``features`` and ``results`` (Parquet and CSV), ``embeddings`` (Parquet, with paths), ``cluster_info`` (JSON), and if
    configured the plots' tables and ``report.html``. With an encoder (``load``) its embeddings are kept in the vector
    store, so a second run encodes new and changed files only; without one, TF-IDF is fitted to all files.
    """
    config = config or ProjectConfig()
    out = out or config.output_dir
    files = sealed(scan(spark, directory, patterns=config.excluded_patterns).select(F.col("path").alias("filepath"), "code"))
    features = sealed(extract(files, config))
    if features.isEmpty():
        return features
    both = {"header": True, "mode": "overwrite"}
    features.write.mode("overwrite").parquet(f"{out}/features")
    features.write.csv(f"{out}/features_csv", **both)
    embeddings = None
    if config.embeddings:
        store = VectorStore(spark, f"{out}/vector_store", dim)
        cached = load is not None and config.use_cache
        embeddings = stored(cached_embeddings(files, store, lambda f: embed(f, load, dim)) if cached else code_embeddings(files, load, dim))
        embeddings.write.mode("overwrite").parquet(f"{out}/embeddings")
    results = stored(analyse(features, files, embeddings, dim, config))
    results.write.mode("overwrite").parquet(f"{out}/results")
    results.write.csv(f"{out}/results_csv", **both)
    info = stored(cluster_info(results))
    info.coalesce(1).write.mode("overwrite").json(f"{out}/cluster_info")
    names = available(features)
    if config.plots:
        rows = results.select("row_id", vector(results, names).alias("features"))
        for name, table in plot_data(results, rows, len(names), names).items():
            table.write.mode("overwrite").parquet(f"{out}/plots/{name}")
    if config.html_report:
        shown = results if "filename" in results.columns else results.withColumn("filename", basename(F.col("filepath")))
        html_report(shown, [r.asDict() for r in info.orderBy("cluster_id").collect()], f"{out}/report.html")
    return results


def graph_embeddings(files: DataFrame, weights: dict | None, out: str) -> DataFrame:
    """Writes the graph model's ``filepath, embedding`` as Parquet, and returns them."""
    rows = stored(gcn.embed(files, stored(ast_nodes(files)), weights))
    rows.write.mode("overwrite").parquet(out)
    return rows


def registered(spark: SparkSession, load: Callable | None = None, dim: int = 768) -> list[str]:
    """Makes the code functions callable from SQL; their names. ``embed`` is among them if an encoder is given."""

    class Nodes:
        def eval(self, code: str):  # noqa: ANN201
            made = NodeColumns()
            if code is not None:
                made.add("", code)
            for r in made.batch().to_pylist():
                yield r["pre"], r["parent_pre"], r["type"], r["lineno"], r["name"]

    spark.udtf.register("ast_nodes", F.udtf(Nodes, returnType="pre int, parent_pre int, type string, lineno int, name string"))
    spark.udf.register("clean_code", F.pandas_udf(lambda s: s.map(guarded, na_action="ignore"), "string"))
    return ["ast_nodes", "clean_code", *([register_embed(spark, load, dim)] if load else [])]

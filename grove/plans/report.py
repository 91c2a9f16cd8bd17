"""Aggregates behind reports, and an HTML page of them."""

from __future__ import annotations

import html
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.cluster import reduced
from grove.operators.rules import band
from grove.storage import write_text

RENAMED = {"filename": "file", "max_nesting_depth": "nesting_depth", "cyclomatic_complexity": "complexity"}
REQUIRED = ("file", "cluster", "risk_score", "function_count", "loop_count", "nesting_depth", "complexity")


def dashboard_table(df: DataFrame) -> DataFrame:
    """Columns under their dashboard names; what is missing is an error."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in df.columns and b not in df.columns})
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("files"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("risk_score") >= 60).alias("high_risk"), F.round(F.avg("risk_score"), 6).alias("avg_risk"))


def bands(df: DataFrame) -> DataFrame:
    b = band(F.col("risk_score"))
    return df.agg(*(F.count_if(b == x).alias(x) for x in ("low", "medium", "high")))


def cluster_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("files")).orderBy("cluster")


def cluster_stats(df: DataFrame) -> DataFrame:
    """Per cluster (noise too): risk mean, sample deviation and maximum, mean features, rows; two decimals."""
    r = lambda c, name: F.round(c, 2).alias(name)
    return df.groupBy("cluster").agg(r(F.avg("risk_score"), "risk_mean"), r(F.stddev_samp("risk_score"), "risk_std"), r(F.max("risk_score"), "risk_max"), r(F.avg("function_count"), "functions"), r(F.avg("nesting_depth"), "nesting"), r(F.avg("complexity"), "complexity"), F.count("*").alias("files"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """``bin, lo, hi, n``: equal bins from the minimum to the maximum, the last one closed; a single value widens by a half."""
    x = F.col(col).cast("double")
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if s["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = (s["lo"], s["hi"]) if s["hi"] > s["lo"] else (s["lo"] - 0.5, s["hi"] + 0.5)
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    step = (hi - lo) / bins
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (lo + F.col("id") * step).alias("lo"), (lo + (F.col("id") + 1) * step).alias("hi"))
    return every.join(F.broadcast(n), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def riskiest(df: DataFrame, n: int = 10, ties: str = "first") -> DataFrame:
    """The n rows with the largest risk; of equals the first (or last) by ``row_id``."""
    return df.orderBy(F.desc("risk_score"), F.asc("row_id") if ties == "first" else F.desc("row_id")).limit(n)


def first_anomalies(df: DataFrame, n: int = 10) -> DataFrame:
    return df.where("is_anomaly").orderBy("row_id").limit(n)


def feature_importance(df: DataFrame, names: list[str], n: int = 15) -> DataFrame:
    """``feature, importance``: the population variance of cluster means (noise left out), the largest n."""
    means = df.where("cluster != -1").groupBy("cluster").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in names))
    long = means.select("cluster", F.posexplode(F.array(*map(F.col, names))).alias("i", "v"))
    top = long.groupBy("i").agg(F.var_pop("v").alias("importance")).orderBy(F.desc("importance"), F.desc("i")).limit(n)
    return top.select(F.element_at(F.lit(names), F.col("i") + 1).alias("feature"), "importance")


def feature_means(df: DataFrame, n: int = 5) -> DataFrame:
    """Means of the first n numeric columns."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")][:n]
    return df.agg(*(F.avg(c).alias(c) for c in numeric))


def report_stats(df: DataFrame, n_clusters: int) -> dict:
    """Counts and the mean risk; what has no column is 0."""
    has = set(df.columns)
    flag = F.coalesce(F.col("is_anomaly").cast("boolean"), F.lit(False)) if "is_anomaly" in has else F.lit(False)
    risk = F.col("risk_score") if "risk_score" in has else F.lit(None).cast("double")
    row = df.agg(F.count("*").alias("total"), F.count_if(flag).alias("anomalies"), F.coalesce(F.avg(risk), F.lit(0.0)).alias("avg_risk"), F.count_if(risk >= 60).alias("high_risk")).first()
    return row.asDict() | {"clusters": n_clusters}


def file_row(df: DataFrame, file: str) -> DataFrame:
    """The first row of a file by ``row_id``; none if it isn't there."""
    return df.where(F.col("file") == file).orderBy("row_id").limit(1)


def demo_rows(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Made-up dashboard rows, the same for a seed."""
    u = lambda k: F.rand(seed + k)
    whole = lambda k, top: F.floor(u(k) * top).cast("long")
    return spark.range(n, numPartitions=1).select(
        F.col("id").alias("row_id"), F.format_string("file_%03d.py", F.col("id")).alias("file"), whole(0, 5).cast("int").alias("cluster"), F.round(100 * u(1), 1).alias("risk_score"),
        whole(2, 20).alias("function_count"), whole(3, 15).alias("loop_count"), whole(4, 8).alias("nesting_depth"), whole(5, 25).alias("complexity"), (u(6) < 0.1).alias("is_anomaly"),
    )


def cluster_points(rows: DataFrame, labels: DataFrame, dim: int, method: str = "pca") -> DataFrame:
    """``row_id, x, y, cluster, size``: two coordinates of each row and how many rows its label has."""
    at = reduced(rows, dim, method).select("row_id", F.try_element_at("features", F.lit(1)).alias("x"), F.coalesce(F.try_element_at("features", F.lit(2)), F.lit(0.0)).alias("y"))
    return at.join(labels.select("row_id", "cluster"), "row_id").join(labels.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("row_id", "x", "y", "cluster", "size")


def elbow(spark: SparkSession, tried: list[dict]) -> DataFrame:
    """``k, inertia, silhouette`` of what ``optimal_k`` tried."""
    return spark.createDataFrame([(r["k"], r["inertia"], r["silhouette"]) for r in tried], "k int, inertia double, silhouette double")


def plot_data(results: DataFrame, rows: DataFrame, dim: int, names: list[str]) -> dict[str, DataFrame]:
    """The tables behind the summary figures: points by cluster, risks, riskiest files, features that part clusters."""
    return {
        "clusters": cluster_points(rows, results.select("row_id", "cluster"), dim), "risk_histogram": histogram(results, "risk_score"),
        "riskiest": riskiest(results, 20).select("row_id", "filepath", "risk_score"), "importance": feature_importance(results, names),
    }


def html_report(df: DataFrame, cluster_info: list[dict], path: str, title: str = "Code analysis", plots: list[str] | None = None) -> Path:
    """Writes the page; ten rows and the clusters are all that reaches the driver. All texts are escaped."""
    stats = report_stats(df, len(cluster_info))
    rows = riskiest(df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())).collect() if "risk_score" in df.columns else []
    e = lambda x: html.escape(str(x))
    level = lambda x: "high" if x >= 60 else "medium" if x >= 30 else "low"
    cards = "".join(f"<div class='card'><b>{v:.1f}</b><span>{e(k)}</span></div>" if isinstance(v, float) else f"<div class='card'><b>{v}</b><span>{e(k)}</span></div>" for k, v in stats.items())
    risky = "".join(f"<tr class='{level(r['risk_score'])}'><td>{e(r['filename'])}</td><td>{r['risk_score']:.1f}</td><td>{level(r['risk_score'])}</td></tr>" for r in rows if r["risk_score"] is not None)
    groups = "".join(f"<tr><td>{e(c.get('cluster_id'))}</td><td>{e(c.get('size'))}</td><td>{float(c.get('percentage', 0)):.1f}%</td><td>{e(c.get('description', ''))}</td></tr>" for c in cluster_info)
    images = "".join(f"<img src='{e(p)}' alt='plot'>" for p in plots or [])
    style = ".card{display:inline-block;margin:8px;padding:12px;border:1px solid #ccc}.card span{display:block}.high{background:#fdd}.medium{background:#ffd}table{border-collapse:collapse}td,th{padding:4px 10px;border:1px solid #ddd}"
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title><style>{style}</style></head><body><h1>{e(title)}</h1><p>{datetime.now():%Y-%m-%d %H:%M}</p>{cards}<h2>Riskiest files</h2><table><tr><th>File</th><th>Risk</th><th>Level</th></tr>{risky}</table><h2>Clusters</h2><table><tr><th>Cluster</th><th>Size</th><th>Share</th><th>Description</th></tr>{groups}</table>{images}</body></html>"
    write_text(df.sparkSession, str(path), page)
    return Path(path)


def anomaly_text(scores: DataFrame, stats: DataFrame, n: int = 10) -> str:
    s = stats.first()
    lines = [f"{s['anomalies']} of {s['total']} rows are anomalies ({s['rate']:.1f} %), from {s['threshold']:.1f} on"]
    return "\n".join(lines + [f"  row {r['row_id']}: {r['score']:.1f}" for r in first_anomalies(scores, n).collect()])


def cluster_text(profiles: DataFrame) -> str:
    rows = profiles.orderBy("cluster").collect()
    return "\n".join(f"cluster {r['cluster']}: {r['size']} rows ({r['percentage']:.1f} %), {r['description']}; rows {list(r['representatives'])}" for r in rows)

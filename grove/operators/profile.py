"""What clusters look like: sizes, means, representatives, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (feature, words when above, words when below) and what makes a cluster an outlier.
TRAITS = (
    ("loop_count", (5, "many loops"), (2, "few loops")), ("max_nesting_depth", (4, "deeply nested"), (2, "shallow")), ("has_recursion", (0.5, "recursive patterns"), None),
    ("function_count", (5, "many functions"), (2, "few functions")), ("cyclomatic_complexity", (8, "high complexity"), (3, "low complexity")),
)
OUTLIER = {"max_nesting_depth": 5.0, "bare_except_count": 0.5, "cyclomatic_complexity": 10.0}


def sizes(labels: DataFrame) -> DataFrame:
    """Rows of each label, noise too."""
    return labels.groupBy("cluster").agg(F.count("*").alias("size"))


def members(labels: DataFrame, cluster: int) -> DataFrame:
    return labels.where(F.col("cluster") == cluster).select("row_id")


def representatives(rows: DataFrame, labels: DataFrame, n: int = 3) -> DataFrame:
    """``cluster, rank, row_id``: the rows nearest to their cluster's mean (ties by row). Means are small and broadcast by size."""
    both = rows.join(labels.where("cluster != -1"), "row_id")
    mean = both.select("cluster", F.posexplode("features").alias("p", "v")).groupBy("cluster", "p").agg(F.avg("v").alias("m"))
    mean = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("center"))
    d = F.sqrt(F.aggregate(F.zip_with("features", "center", lambda x, c: (x.cast("double") - c) ** 2), F.lit(0.0), lambda s, x: s + x))
    w = Window.partitionBy("cluster").orderBy("d", "row_id")
    return both.join(mean, "cluster").withColumn("d", d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cluster", "rank", "row_id")


def profiles(rows: DataFrame, labels: DataFrame, names: list[str] | None = None, dim: int | None = None, n: int = 3) -> DataFrame:
    """Size, share of all rows, means, population deviations, representatives and a description of every cluster but noise."""
    names = names or [f"f{i}" for i in range(dim or 0)]
    total = labels.count()
    both = rows.join(labels.where("cluster != -1"), "row_id")
    at = [F.col("features")[i].cast("double") for i in range(len(names))]
    by = both.groupBy("cluster").agg(F.count("*").alias("size"), F.array(*(F.avg(x) for x in at)).alias("m"), F.array(*(F.stddev_pop(x) for x in at)).alias("s"))
    keys = F.array(*map(F.lit, names))
    reps = representatives(rows, labels, n).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"]).alias("representatives"))
    out = by.select("cluster", "size", (100 * F.col("size") / total).alias("percentage"), F.map_from_arrays(keys, "m").alias("means"), F.map_from_arrays(keys, "s").alias("stds")).join(reps, "cluster")
    return out.withColumn("description", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), description(F.col("means"))))


def description(means) -> F.Column:
    parts = []
    for name, above, below in TRAITS:
        v = F.try_element_at(means, F.lit(name))
        say = F.when(v > above[0], above[1])
        parts.append(say.when(v < below[0], below[1]) if below else say)
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "general code patterns").otherwise(text)


def profile_of(summary: DataFrame, cluster: int) -> DataFrame:
    return summary.where(F.col("cluster") == cluster)


def compared(summary: DataFrame, feature: str) -> DataFrame:
    return summary.select("cluster", F.try_element_at("means", F.lit(feature)).alias("mean"))


def outliers(summary: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Clusters with any mean over its limit."""
    over = [F.coalesce(F.try_element_at(F.col("means"), F.lit(k)) > v, F.lit(False)) for k, v in (limits or OUTLIER).items()]
    return summary.where(F.greatest(F.lit(False), F.lit(False), *over)).select("cluster")

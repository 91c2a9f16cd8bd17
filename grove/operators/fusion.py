"""Aligning and scaling feature blocks, and combining scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.storage import running

#: Weights of the blocks; the structural one is smaller beside transformer embeddings.
STRUCTURAL, STRUCTURAL_BESIDE, EMBEDDING, GRAPH = 1.0, 0.4, 0.6, 0.5


def aligned(features: DataFrame, embeddings: DataFrame, dim: int, key: str = "filepath") -> DataFrame:
    """``features`` with ``embedding``; of repeated keys the last by ``row_id`` counts, missing ones are zero vectors."""
    if "row_id" in embeddings.columns:
        embeddings = embeddings.groupBy(key).agg(F.max_by("embedding", "row_id").alias("embedding"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return features.join(embeddings.select(key, "embedding"), key, "left").withColumn("embedding", F.coalesce("embedding", zero))


def standardized(df: DataFrame, col: str, dim: int, factor: float = 1.0) -> DataFrame:
    """The array column centred and divided by the population deviation (constant columns become 0), times ``factor``."""
    at = [F.col(col)[i].cast("double") for i in range(dim)]
    stats = df.agg(F.array(*(F.avg(x) for x in at)).alias("_mean"), F.array(*(F.stddev_pop(x) for x in at)).alias("_sd"))
    step = F.transform(F.arrays_zip(F.col(col), F.col("_mean"), F.col("_sd")), lambda z: (z[col].cast("double") - z["_mean"]) / F.when(z["_sd"] == 0, 1.0).otherwise(z["_sd"]) * factor)
    return df.crossJoin(F.broadcast(stats)).withColumn(col, step).drop("_mean", "_sd")  # the other side is one row


def fused(df: DataFrame, *blocks: str) -> DataFrame:
    """The blocks side by side in one array."""
    return df.withColumn("features", F.concat(*(F.transform(F.col(b), lambda x: x.cast("double")) for b in blocks)))


def min_max(df: DataFrame, col: str, out: str, top: float = 100.0) -> DataFrame:
    """Scaled to 0 .. ``top``; all zeros when constant."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * top).otherwise(0.0)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")  # one row


def percentile_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """The share of rows at or below each value, in per cent. Values are counted first, then ranged."""
    by = df.groupBy(col).agg(F.count("*").alias("_n"))
    total = df.count()
    ranks = running(by, [F.col(col)], F.col("_n"), "_upto").select(col, (F.col("_upto") / total * 100).alias(out))
    return df.join(ranks, df[col].eqNullSafe(ranks[col])).drop(ranks[col])


def combined_risk(anomaly: Column, rule: Column, weight: float = 0.4) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), weight * anomaly + (1 - weight) * rule))


def weighted_risk(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The mean of the parts (0 to 100 each) by their weights, within 0 and 100; a null part counts as 0.

    Weights of parts that aren't there are left out, and the others need not add up to 1; with no weight at all it is 0.
    """
    total = sum(weights.get(k, 0.0) for k in parts)
    if not total:
        return F.lit(0.0)
    share = sum((F.coalesce(c.cast("double"), F.lit(0.0)) * (weights.get(k, 0.0) / total) for k, c in parts.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))


def quantile(rows: DataFrame, col: str, q: float, bins: int = 1024, few: int = 10_000) -> float | None:
    """The exact quantile with linear interpolation, None without values (nulls don't count).

    Values are counted in equal ranges between the smallest and the largest one, then in ranges of the one that holds
    the place, until it has ``few`` values or they are all equal. A job gives at most ``bins`` counts.
    """
    values = rows.select(F.col(col).cast("double").alias("v")).where("v is not null")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = q * (n - 1)

    def at(rank: int) -> float:
        lo, hi, before, inside = low, high, 0, n
        while lo < hi and inside > few:
            b = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
            for r in values.where(F.col("v").between(lo, hi)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
                if rank < before + r["n"]:
                    lo, hi, inside = r["lo"], r["hi"], r["n"]
                    break
                before += r["n"]
        return lo if lo == hi else sorted(r["v"] for r in values.where(F.col("v").between(lo, hi)).collect())[rank - before]

    lower = math.floor(place)
    below = at(lower)
    return below if place == lower else (lower + 1 - place) * below + (place - lower) * at(lower + 1)

"""Mixing sources to target weights: entropy balancing by Newton's method, rates rounded into copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WORD, attach, keep


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows, so that reruns agree to the last bit."""
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def ranked(keys: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Distinct ``keys`` with their 0-based ``rank`` in code point order, nulls last; no task sees more than its range."""
    spark = keys.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).isNull(), F.col(key)]
    rows = keep(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    before, total = {}, 0
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        before[r["p"]], total = total, total + r["count"]
    start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[part] if before else F.lit(0)
    return rows.withColumn("rank", start + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row")


def capped_targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """``target`` of each source: a share of all sizes by weight, at most ``cap`` times its own size.

    A source is at its cap when weight * level > cap * size; what others can't take raises the level until no source
    changes sides. Each round is one sum over the sources.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": w.cast("double"), "_most": F.col("source_size") * cap})
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        over = F.col("weight") * level > F.col("_most")
        s = sources.agg(exact_sum(F.when(over, F.col("_most"))).alias("given"), exact_sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if s["n"] == full or not s["free"]:
            break
        full, level = s["n"], (total - (s["given"] or 0.0)) / s["free"]
    over = F.col("weight") * level > F.col("_most")
    return sources.withColumn("target", F.when(over, F.col("_most")).otherwise(F.col("weight") * level)).drop("_most")


def balanced_rates(rows: DataFrame, cells: DataFrame, traits: list[str], cap: float, steps: int = 25, close: float = 1e-7) -> DataFrame:
    """``rows`` (``source, size, traits``) with ``rate``, exponentially tilted and at most ``cap``.

    The rates are those closest to 1 in relative entropy, weighted by size, under which every source has its ``target``
    tokens and the mix has the corpus's token mean of each trait (traits have mean 0 and deviation 1, weighted by
    tokens, so that is a sum of 0). The dual is convex in a number for each source and one for each trait, which
    couples all sources. Each Newton step is one aggregation over the documents, a row for each source; as the
    sources' block of the Hessian is diagonal, it is eliminated there, and only sums by traits reach the driver. A
    small ridge on the traits keeps unreachable means from running away. Sources with a target of ``cap`` times their
    size have no choice and take no part but for what they add to the traits.
    """
    spark, d = rows.sparkSession, range(len(traits))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = keep(cells.where("source_size > 0 and target > 0").select(F.struct("source").alias("_key"), "target", full.alias("_full"), F.log(F.col("target") / F.col("source_size")).alias("_tilt")))
    n, mu = state.count(), np.zeros(len(traits))
    total = state.agg(exact_sum(F.col("target"))).first()[0] or 0.0
    x = [F.col(t) for t in traits]

    def rated(state: DataFrame, mu: np.ndarray) -> DataFrame:
        tilted = F.exp(F.col("_tilt") + sum((F.lit(float(m)) * c for m, c in zip(mu, x, strict=True)), F.lit(0.0)))
        both = attach(rows.withColumn("_key", F.struct("source")), state, "_key", "left", rows=n)
        return both.withColumn("rate", F.when(F.col("size") > 0, F.when(F.col("_full"), float(cap)).otherwise(F.least(F.lit(float(cap)), tilted))).otherwise(0.0)).fillna(0.0, ["rate"])

    for _ in range(steps):
        mass = F.col("size") * F.col("rate")
        loose = F.when(~F.col("_full") & (F.col("rate") < cap), mass).otherwise(0.0)
        sums = [exact_sum(mass).alias("_g"), exact_sum(loose).alias("_h"), *(exact_sum(mass * x[i]).alias(f"_m{i}") for i in d), *(exact_sum(loose * x[i]).alias(f"_b{i}") for i in d), *(exact_sum(loose * x[i] * x[j]).alias(f"_c{i}_{j}") for i in d for j in d if j <= i)]
        by = keep(rated(state, mu).where("_tilt is not null").groupBy("_key").agg(F.first("target").alias("target"), F.first("_full").alias("_full"), F.first("_tilt").alias("_tilt"), *sums))
        off, live = F.col("_g") - F.col("target"), ~F.col("_full") & (F.col("_h") > 0)
        share = lambda c: exact_sum(F.when(live, c / F.col("_h")).otherwise(0.0))  # noqa: B023, E731
        s = by.agg(F.max(F.when(live, F.abs(off) / F.col("target"))).alias("far"), *(exact_sum(F.col(f"_m{i}")).alias(f"m{i}") for i in d), *(share(F.col(f"_b{i}") * off).alias(f"r{i}") for i in d), *((exact_sum(F.col(f"_c{i}_{j}")) - share(F.col(f"_b{i}") * F.col(f"_b{j}"))).alias(f"s{i}_{j}") for i in d for j in d if j <= i)).first()
        ridge = 1e-4 * total
        slope = np.array([(s[f"m{i}"] or 0.0) + ridge * mu[i] for i in d])
        if not total or (s["far"] or 0.0) < close and (abs(slope) < 1e-6 * total).all():
            break
        hessian = np.array([[s[f"s{max(i, j)}_{min(i, j)}"] or 0.0 for j in d] for i in d]).reshape(len(traits), len(traits)) + ridge * np.eye(len(traits))
        step = np.clip(-np.linalg.solve(hessian, slope - np.array([s[f"r{i}"] or 0.0 for i in d])), -0.5, 0.5) if len(traits) else mu
        down = (off + sum((F.lit(float(v)) * F.col(f"_b{i}") for i, v in enumerate(step)), F.lit(0.0))) / F.col("_h")
        state = by.select("_key", "target", "_full", F.when(live, F.col("_tilt") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), down))).otherwise(F.col("_tilt")).alias("_tilt"))
        mu = mu + step
    return rated(state, mu).drop("_key", "target", "_full", "_tilt")


def round_group(sizes: np.ndarray, share: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which documents get one copy more, so that their sizes add up to about the sum of ``share`` times size.

    By size, documents are taken whenever the running sum of shares passes a half, so what is left out is made up for
    by a document of about the same size; then the one change that leaves the smallest error is made while it helps.
    """
    order = np.lexsort((h, sizes))
    extra = np.zeros(len(sizes), bool)
    extra[order] = np.diff(np.floor(np.r_[0.0, np.cumsum(share[order])] + 0.5)) > 0
    extra &= share > 0
    error = float((sizes * share).sum() - sizes[extra].sum())
    for _ in range(8):
        after = np.where(share > 0, np.abs(error - np.where(extra, -sizes, sizes)), np.inf)
        i = int(np.argmin(after)) if len(after) else 0
        if not len(after) or after[i] >= abs(error):
            break
        error -= -sizes[i] if extra[i] else sizes[i]
        extra[i] = ~extra[i]
    return extra


def searched(sizes: np.ndarray, copies: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, goal: float) -> tuple[np.ndarray, float]:
    """Changes one or two copies at a time, between ``floor`` and ``ceiling``, while that brings their sizes nearer to
    ``goal``: the copies, and what is still lacking."""
    copies = copies.copy()
    while True:
        gap = goal - float(sizes @ copies)
        up, down = np.flatnonzero(copies < ceiling), np.flatnonzero(copies > floor)
        row, by = np.r_[-1, up, down], np.r_[0.0, sizes[up], -sizes[down]]  # -1: no change
        order = np.lexsort((row, by))
        row, by = row[order], by[order]
        other = np.clip(np.searchsorted(by, gap - by)[:, None] + np.arange(-2, 2), 0, len(by) - 1)
        left = np.where((row[other] == row[:, None]) & (row[other] >= 0), np.inf, np.abs(gap - by[:, None] - by[other]))
        i, j = np.unravel_index(int(np.argmin(left)), left.shape)
        if left[i, j] > abs(gap) - 0.5:
            return copies, gap
        for k in (i, other[i, j]):
            if row[k] >= 0:
                copies[row[k]] += 1 if by[k] > 0 else -1


def repaired(sizes: np.ndarray, copies: np.ndarray, rate: np.ndarray, goal: float, most: int, near: float = 1e-3) -> np.ndarray:
    """``copies`` changed until their sizes add up to ``goal``, but for about ``near`` of it.

    First only copies that are rates rounded up or down count; if the rest is still larger than that, all within 0 to
    ``most``. If that is stuck at documents larger than the rest, each of them in turn takes a copy
    less (or more) for good and the others are searched again.
    """
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return copies
    own, rate, out = sizes[some], rate[some], copies.copy()
    none, full, enough = np.zeros(len(some)), np.full(len(some), float(most)), max(0.5, near * goal)
    best, gap = searched(own, copies[some], np.floor(rate), np.minimum(np.ceil(rate), most), goal)
    if abs(gap) > enough:
        best, gap = searched(own, best, none, full, goal)
    if abs(gap) > enough:
        start, way = best, 1 if gap > 0 else -1
        for i in np.flatnonzero((own > abs(gap)) & ((start < full) if way > 0 else (start > none))):
            tried = start.copy()
            tried[i] += way
            floor, ceiling = none.copy(), full.copy()
            floor[i] = ceiling[i] = tried[i]
            tried, rest = searched(own, tried, floor, ceiling, goal)
            if abs(rest) < abs(gap):
                best, gap = tried, rest
    out[some] = best
    return out


def met(rounded: DataFrame, cap: float, near: float, rounds: int) -> DataFrame:
    """``rounded`` documents with copies moved between all groups of a source, until it takes about its ``target`` words.

    What a source lacks or has too much is dealt out to its groups by what each could still take or give, no document
    counting for more than that gap, and each group changes copies until it has its part. Only gaps, a row for each source and
    for each group, leave the documents' tasks. Ends when all sources are within ``near`` of their targets (or half a
    word), or after ``rounds``.
    """
    keys, most, schema = ["rank", "_group"], int(cap), rounded.schema
    for _ in range(rounds):
        rounded = keep(rounded)
        taken = rounded.groupBy("rank").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("_gap"), F.first("target").alias("_goal"))
        taken = keep(taken.where(F.abs("_gap") > F.greatest(F.lit(0.5), near * F.col("_goal"))).select("rank", "_gap"))
        n = taken.count()
        if not n:
            break
        could = F.when(F.col("_gap") > 0, most - F.col("copies")).otherwise(F.col("copies")) * F.least(F.col("size"), F.abs("_gap"))
        rooms = attach(rounded, taken, "rank", "inner", rows=n).groupBy(*keys).agg(F.first("_gap").alias("_gap"), exact_sum(could).alias("_room"))
        rooms = keep(rooms.where("_room > 0"))
        shares = attach(rooms, keep(rooms.groupBy("rank").agg(exact_sum(F.col("_room")).alias("_all"))), "rank", "inner", rows=n)
        part = F.col("_gap") * F.col("_room") / F.col("_all")
        dealt = F.floor(part + F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / (1 << 20))
        parts = shares.select(F.struct(*keys).alias("_key"), F.when(F.col("_room") == F.col("_all"), part).otherwise(dealt.cast("double")).alias("_part"))
        with_parts = attach(rounded.withColumn("_key", F.struct(*keys)), keep(parts), "_key", "left").drop("_key").fillna(0.0, ["_part"])

        def change(pdf: pd.DataFrame) -> pd.DataFrame:
            part = float(pdf["_part"].iloc[0])
            if part:
                pdf = pdf.sort_values(["size", "h", "copies"], kind="stable", ignore_index=True)
                sizes, copies = pdf["size"].to_numpy(np.float64), pdf["copies"].to_numpy()
                pdf["copies"] = repaired(sizes, copies, pdf["rate"].to_numpy(), float(sizes @ copies) + part, most, near)
            return pdf.drop(columns="_part")

        rounded = with_parts.groupBy(*keys).applyInPandas(change, schema)
    return rounded


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, group_rows: int = 1000, near: float = 1e-3, traits: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rates and copies of documents so that the sources' words meet target shares; a row per document.

    Sources in code point order (null last) have the ``weights`` in turn. The log of a document's size, and any numeric
    columns named in ``traits`` (null: 0), keep their mean over the corpus's words, so that the mix does not drift to
    short or long documents; which documents of a source are copied follows from that. Rates are rounded down or up
    into copies inside groups of about ``group_rows`` documents of one source, so the largest source is dealt over many
    tasks and only ids and sizes are shuffled. Where a source then misses its target by more than ``near`` of it (one
    document may be most of a source), copies between 0 and ``cap`` are moved in all its groups (``met``). Copies depend on ids, texts and traits alone: reruns agree. A null text
    has size 0 and takes no words; null ids are dealt out by their texts; repeated rows each take their own; an empty
    table gives an empty result; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(f"_t{i}") for i, t in enumerate(traits, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, text_col).alias("h"), *own)
    rows = keep(rows.withColumn("_t0", F.log1p("size")))
    names = [f"_t{i}" for i in range(len(traits) + 1)]
    sums = keep(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")))
    m = rows.agg(F.sum("size").alias("n"), *(exact_sum(F.col("size") * F.col(t)).alias(t) for t in names), *(exact_sum(F.col("size") * F.col(t) ** 2).alias(f"{t}2") for t in names)).first()
    mean = [(m[t] or 0.0) / (m["n"] or 1) for t in names]
    dev = [max((m[f"{t}2"] or 0.0) / (m["n"] or 1) - a * a, 0.0) ** 0.5 for t, a in zip(names, mean, strict=True)]
    scaled = {t: (F.col(t) - a) / (s or 1.0) for t, a, s in zip(names, mean, dev, strict=True)}
    cells = keep(capped_targets(ranked(sums, "source"), [float(w) for w in weights], cap))
    rated = balanced_rates(rows.withColumns(scaled), cells, names, cap).drop(*names)
    cells = cells.select(F.struct("source").alias("_key"), "source_size", "target", "rank", F.ceil(F.col("_n") / group_rows).alias("_groups"))
    nearest = F.round("rate")
    rate = F.when(F.abs(F.col("rate") - nearest) < 1e-9, nearest).otherwise(F.col("rate"))
    spread = attach(rated.withColumns({"_key": F.struct("source"), "rate": rate}), cells, "_key", "left").drop("_key")
    spread = spread.withColumn("_group", F.pmod("h", F.col("_groups")))
    kind = rows.schema["id"].dataType.simpleString()

    def copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], kind="stable", ignore_index=True)
        low = np.floor(pdf["rate"].to_numpy())
        extra = round_group(pdf["size"].to_numpy(np.float64), pdf["rate"].to_numpy() - low, pdf["h"].to_numpy())
        pdf["copies"] = (low + extra).astype(np.int64)
        return pdf[names]

    columns = f"id {kind}, source string, size long, source_size long, target double, rate double, copies long"
    names = ["id", "source", "size", "source_size", "target", "rate", "copies", "rank", "_group", "h"]
    out = met(spread.groupBy("rank", "_group").applyInPandas(copies, f"{columns}, rank long, _group long, h long"), cap, near, 3)
    return out.drop("rank", "_group", "h").withColumn("taken", F.col("size") * F.col("copies")).withColumnRenamed("id", id_col)

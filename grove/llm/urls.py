"""URL filters: host and path rules, then a character language-model ratio for the rest. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import ascii_lower, attach, keep

#: (rule, verdict): a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The model's symbols: anything else is "?", the end is "$"; "^" pads the start.
SYMBOLS = "?abcdefghijklmnopqrstuvwxyz0123456789-._~/%:=&+$"
ORDERS, PIECE = 5, 512
#: Labelled URLs are scored by a model that has not seen their fold, a fifth of the hosts.
FOLDS = 5
#: So many contexts of an order (about 15 MB) are broadcast; more are joined by shuffling.
CONTEXTS = 20_000
#: The threshold is drawn to 0 as if so many URLs of each verdict had said 0.
PRIOR = 50


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "://([^/?#]*)", 1)), F.regexp_extract(rest, "://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equals the first by text) and its verdict, else nulls."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def positions(df: DataFrame, *cols: str) -> DataFrame:
    """A row for each symbol of ``seen`` and its end: the symbol's number and the numbers of the contexts before it.

    Texts are cut into pieces of PIECE symbols that overlap by the longest context, so long texts stay linear.
    """
    pad = ORDERS - 1
    text = F.concat(F.lit("^" * pad), F.regexp_replace("seen", r"[^a-z0-9\-._~/%:=&+]", "?"), F.lit("$"))
    df = df.select(*cols, text.alias("_t")).select(*cols, "_t", F.explode(F.sequence(F.lit(1), F.length("_t") - pad, F.lit(PIECE))).alias("_at"))
    df = df.select(*cols, (F.col("_at") == 1).alias("_first"), F.expr(f"substring(_t, _at, {PIECE + pad})").alias("_t"))
    df = df.select(*cols, "_t", "_first", F.explode(F.sequence(F.lit(1), F.length("_t") - pad)).alias("_i"))
    context = [F.expr(f"substring(_t, _i + {pad - k}, {k})") for k in range(ORDERS)]
    symbol = F.instr(F.lit(SYMBOLS), F.expr(f"substring(_t, _i + {pad}, 1)"))
    return df.select(*cols, (F.col("_first") & (F.col("_i") == 1)).alias("_first"), symbol.alias("symbol"), *(c.alias(f"c{k}") for k, c in enumerate(context)))


def train(labelled: DataFrame) -> DataFrame:
    """Counts of symbols after contexts of 0 to ORDERS - 1 symbols in accepted and rejected URLs (``accepted, _fold, seen``).

    A row for each context: its order ``k``, the counts of each symbol seen after it, their sums and kinds. Each is an
    array: over all URLs, then over those outside each fold. There are at most as many contexts as symbols in the
    labelled URLs; counts are added up before they are shuffled.
    """
    at, models = positions(labelled, "accepted", "_fold"), range(FOLDS + 1)
    each = at.select("accepted", "_fold", "symbol", F.posexplode(F.array(*(F.col(f"c{k}") for k in range(ORDERS)))).alias("k", "context"))
    used = [F.lit(True), *(F.col("_fold") != f for f in range(FOLDS))]
    count = lambda says: F.array(*(F.count_if(says & u) for u in used))
    counts = each.groupBy("k", "context", "symbol").agg(count(F.col("accepted")).alias("yes"), count(~F.col("accepted")).alias("no"))
    seen = F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("yes", "no"))))  # a symbol is there once
    sums = [F.array(*(F.sum(F.col(x)[i]) for i in models)).alias(f"n_{x}") for x in ("yes", "no")]
    kinds = [F.array(*(F.count_if(F.col(x)[i] > 0) for i in models)).alias(f"t_{x}") for x in ("yes", "no")]
    return counts.groupBy("k", "context").agg(seen.alias("seen_after"), *sums, *kinds)


def scored(df: DataFrame, model: DataFrame, *cols: str) -> DataFrame:
    """``llr``, the log-likelihood difference per symbol (end included) of ``seen``, for each row, by the model of all
    URLs or, where ``_fold`` (one of ``cols``) is not null, of those outside that fold.

    Witten-Bell smoothing: an order's estimate falls back on the next lower one in proportion to the kinds of symbols
    seen after the context, the lowest on equal chances. Rows that are equal in ``cols`` are scored once and repeated.
    """
    at = positions(df, *cols)
    yes = no = F.lit(1.0 / len(SYMBOLS))
    of = lambda counts: F.coalesce(F.get(counts, F.coalesce(F.col("_fold") + 1, F.lit(0)).cast("int")), F.lit(0))
    for k in range(ORDERS):
        table = model.where(F.col("k") == k).select(F.col("context").alias(f"c{k}"), "seen_after", *(f"{a}_{x}" for a in "nt" for x in ("yes", "no")))
        at = attach(at, table, f"c{k}", "left", CONTEXTS).withColumn("seen_after", F.element_at("seen_after", F.col("symbol")))
        at = at.withColumns({f"c_{x}": of(F.col("seen_after")[x]) for x in ("yes", "no")} | {f"{a}_{x}": of(F.col(f"{a}_{x}")) for a in "nt" for x in ("yes", "no")})
        yes, no = (F.when(F.col(f"n_{x}") > 0, (F.col(f"c_{x}") + F.col(f"t_{x}") * p) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(p) for x, p in (("yes", yes), ("no", no)))
        at = at.withColumns({f"p_yes{k}": yes, f"p_no{k}": no}).drop("seen_after", *(f"{a}_{x}" for a in "cnt" for x in ("yes", "no")))
        yes, no = F.col(f"p_yes{k}"), F.col(f"p_no{k}")
    out = at.select(*cols, "_first", F.log(yes / no).alias("_d")).groupBy(*cols).agg(F.avg("_d").alias("llr"), F.count_if("_first").alias("_n"))
    return out.select(*cols, "llr", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_")).drop("_")


def threshold(rows: DataFrame, prior: float = PRIOR) -> float:
    """The difference from which on URLs are accepted, from scores of labelled URLs by models without their folds.

    Where as many deviations lie below it to the rejected URLs' mean as above it to the accepted ones', so it moves with
    all scores a little, not with single ones; drawn to 0 by ``prior`` URLs, and 0 if the means are not apart.
    """
    by = {r["accepted"]: r for r in rows.groupBy("accepted").agg(F.count("*").alias("n"), F.avg("llr").alias("mean"), F.stddev_pop("llr").alias("dev")).collect()}
    if len(by) < 2:
        return 0.0 if not by else -math.inf if True in by else math.inf
    yes, no = by[True], by[False]
    if yes["mean"] <= no["mean"]:
        return 0.0
    wide = yes["dev"] + no["dev"]
    middle = (yes["mean"] * no["dev"] + no["mean"] * yes["dev"]) / wide if wide > 0 else (yes["mean"] + no["mean"]) / 2
    n = min(yes["n"], no["n"])
    return middle * n / (n + prior)


def held_out_accuracy(rows: DataFrame, cut: float) -> float | None:
    """The mean of both verdicts' shares of labelled URLs (``accepted, llr``) that the scores judge as their rules do."""
    right = F.when(F.col("accepted") == (F.col("llr") >= F.lit(cut)), 1.0).otherwise(0.0)
    return rows.groupBy("accepted").agg(F.avg(right).alias("right")).agg(F.avg("right")).first()[0]


def cross_fitted(labelled: DataFrame, model: DataFrame) -> DataFrame:
    """``accepted, llr`` of labelled URLs by models that have not seen their hosts."""
    return scored(labelled, model, "seen", "accepted", "_fold").select("accepted", "llr")


def prepared(pages: DataFrame, rules, id_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with host, path and rule, and those with a rule as labels; equal hosts are in one fold."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": verdict, "seen": ascii_lower(F.concat("host", "path"))})
    fold = F.when(F.col("says").isNotNull(), F.pmod(F.crc32("host"), F.lit(FOLDS)))
    rows = rows.withColumn("_fold", fold)
    return rows, rows.where("says is not null").select("seen", (F.col("says") == "allow").alias("accepted"), "_fold")


def url_filter(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict, llr``: the longest fitting rule's verdict, else the language models'.

    URLs with a rule are the labels: all train a model of accepted and one of rejected host-and-path strings, and each is
    also scored by the models without its fold, a fifth of the hosts; these scores set the ``threshold`` on the
    length-normalised log-likelihood difference. ``llr`` is by the models of all labels, for URLs with a rule by those
    without their fold. Contexts are exact; those of an order are broadcast up to CONTEXTS of them, beyond that joined by
    shuffling. A null or odd URL has empty host and path and is judged as the empty text; null ids stay null; repeated
    rows get a row each; an empty table gives an empty result; other columns are ignored. With labels of one kind only,
    everything gets that verdict; with none, "allow".
    """
    rows, labelled = prepared(pages, rules, id_col, url_col)
    model = keep(train(labelled))
    cut = threshold(cross_fitted(labelled, model))
    cols = ["_id", "host", "path", "rule", "says", "_fold"]
    out = scored(rows, model, *cols)
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("says", F.when(F.col("llr") >= cut, "allow").otherwise("block")).alias("verdict"), "llr")

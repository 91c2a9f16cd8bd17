"""Quality rules: word statistics of documents, failures by host, and host verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import attach, by_bytes, coded, filled, keep, lean, words

_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(code: np.ndarray, owner: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """For each of ``n`` texts, the words that lie in a window of ``width`` words found twice or more in that text."""
    if len(code) < width:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        start = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        h = owner[start].astype(np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(29))) * _ODD + code[start + k].astype(np.uint64)
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    at = np.searchsorted(twice, h)
    start = start[twice[np.minimum(at, len(twice) - 1)] == h]
    rows = np.column_stack([owner[start], *(code[start + k] for k in range(width))])  # equal hashes are verified
    _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    start = start[count[back.ravel()] > 1]
    edge = np.bincount(start, minlength=len(code) + 1) - np.bincount(start + width, minlength=len(code) + 1)[: len(code) + 1]
    return np.bincount(owner[np.cumsum(edge)[: len(code)] > 0], minlength=n).astype(np.int64)


def line_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line, of each text."""
    lists = pc.split_pattern(texts, "\n")
    line, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.match_substring_regex(line, r"[^\x20\x09-\x0D]")
    code, _ = coded(line.filter(some))
    owner = owner[some.to_numpy(zero_copy_only=False)]
    n = np.bincount(owner, minlength=len(texts))
    first = np.unique(owner * (int(code.max(initial=0)) + 1) + code)
    return n, n - np.bincount(first // (int(code.max(initial=0)) + 1), minlength=len(texts))


def batch_stats(texts: pa.Array, batch_bytes: int = 2 << 20) -> dict[str, np.ndarray]:
    texts = filled(texts)
    out = {k: np.zeros(len(texts), np.int64) for k in _STATS}
    for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
        part = texts.slice(a, b - a)
        word, owner = words(part)
        code, distinct = coded(word)
        out["n_words"][a:b] = np.bincount(owner, minlength=b - a)
        size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
        out["word_chars"][a:b] = np.bincount(owner, size[code] if len(code) else None, b - a)
        out["n_symbols"][a:b] = pc.count_substring_regex(part, "[#*$%&|<>]").to_numpy(zero_copy_only=False)
        out["n_capitals"][a:b] = pc.count_substring_regex(part, "[A-Z]{2,}").to_numpy(zero_copy_only=False)
        out["n_repeat_words"][a:b] = repeated_words(code, owner, b - a)
        out["n_lines"][a:b], out["n_dup_lines"][a:b] = line_stats(part)
    return out


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id_col, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            stats = batch_stats(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(stats[k]) for k in _STATS)], ["id", "host", *_STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, host string, " + ", ".join(f"{k} long" for k in _STATS)).withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_ratio: float = 1.5, host_z: float = 1.645, prior_docs: float = 200.0, max_symbols: float = 0.1, max_capitals: float = 0.3, max_dup_lines: float = 0.3, min_mean_chars: float = 2.0, max_mean_chars: float = 30.0) -> DataFrame:
    """Judges documents by their own rules and by their host's record; a row per document.

    A document fails its base rules with under 10 words or over 20 % of them in repeated 5-word windows. Soft rules
    look at symbols per word and words in capitals (two points each), repeated lines and the mean word length (one
    each). Per host, the share of documents that fail any rule is shrunk towards the corpus: a beta prior, worth
    ``prior_docs`` documents at most, is fitted to all hosts by moments, and ``host_rate`` is the posterior mean. A host
    is bad if its rate is ``host_ratio`` times that of the corpus (or half-way from there to 1, if that is less) even at
    the lower end of the posterior, ``host_z`` deviations below the mean. On a bad host a document with any point goes,
    on others one with two points, so that clean documents stay whatever their host, and where hosts are alike no host
    is bad. Only statistics are shuffled, added up before; verdicts are broadcast when there are few hosts. A null text
    has no words and fails; null hosts are one host; repeated rows are judged each; an empty table gives an empty
    result; other columns are ignored.
    """
    rules = [
        (2, F.col("n_symbols") > max_symbols * F.col("n_words")),
        (2, F.col("n_capitals") > max_capitals * F.col("n_words")),
        (1, F.col("n_dup_lines") > max_dup_lines * F.col("n_lines")),
        (1, ~(F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))).between(min_mean_chars, max_mean_chars)),
    ]
    soft = sum((weight * F.coalesce(rule, F.lit(False)).cast("int") for weight, rule in rules), F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = keep(text_stats(docs, id_col, text_col, host_col).withColumns({"base_failed": failed, "n_soft": soft, "host": F.struct("host")}))
    hosts = keep(stats.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | (F.col("n_soft") > 0)).alias("bad")))
    rate = F.col("bad") / F.col("n")
    m = hosts.agg(F.count("*").alias("k"), (F.sum("bad") / F.sum("n")).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    a, b = beta_prior(m["k"], m["mean"], m["var"], m["inv"], prior_docs)
    limit = min(host_ratio * (m["mean"] or 0.0), (1 + (m["mean"] or 0.0)) / 2)
    rate, n = (F.col("bad") + a) / (F.col("n") + (a + b)), F.col("n") + (a + b + 1)
    verdicts = hosts.select("host", rate.alias("host_rate"), (rate - host_z * F.sqrt(rate * (1 - rate) / n) > limit).alias("bad_host"))
    out = attach(stats, verdicts, "host", "left", rows=m["k"])
    return out.select(id_col, *_STATS, "base_failed", "n_soft", "host_rate", "bad_host", (~F.col("base_failed") & (F.col("n_soft") < F.when(F.col("bad_host"), 1).otherwise(2))).alias("kept"))


def beta_prior(k: int, mean: float | None, var: float | None, inv: float | None, most: float) -> tuple[float, float]:
    """Parameters, ``most`` in sum at most, of a beta distribution with the hosts' mean rate and their variance beyond sampling error."""
    if not k or mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    between = max((var or 0) - mean * (1 - mean) * inv, 1e-6)
    size = min(max(mean * (1 - mean) / between - 1, 1.0), most)
    return mean * size, (1 - mean) * size

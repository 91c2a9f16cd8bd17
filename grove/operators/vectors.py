"""TF-IDF and cosine similarity."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.operators.sums import summed
from grove.storage import stored

IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def terms(text: str | None) -> list[str]:
    """Identifiers of the lower-cased text, and pairs of neighbours."""
    words = re.findall(IDENTIFIER, (text or "").lower())
    return [*words, *map(" ".join, zip(words, words[1:], strict=False))]


#: Counters of the sketch of term counts (8 MB in a task, whatever the input), and how they are sent.
COUNTERS, _BLOCK = 1 << 20, 1 << 14


class _Terms:
    """Words of some texts as codes, and pairs of neighbours as ``code * words + next``; counters are the same everywhere."""

    def __init__(self, texts: list[str | None]):
        found = [re.findall(IDENTIFIER, (t or "").lower()) for t in texts]
        d = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
        self.code, self.words = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
        self.owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        inner = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        self.first, self.next, self.pair_owner = self.code[inner], self.code[inner + 1], self.owner[inner]
        self.pair = self.first * len(self.words) + self.next
        h = np.fromiter((zlib.crc32(w.encode()) for w in self.words), np.uint64, len(self.words))
        with np.errstate(over="ignore"):
            self.slot = self._slot(h[self.code])
            self.pair_slot = self._slot((h[self.first] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + h[self.next])

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(44)).astype(np.int64)

    def names(self, keys: np.ndarray, pairs: bool) -> list[str]:
        w, n = self.words, len(self.words)
        return [f"{w[k // n]} {w[k % n]}" if pairs else w[k] for k in keys.tolist()]


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[_Terms]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size > most:
                yield _Terms(held)
                held, size = [], 0
    yield _Terms(held)


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From each task: blocks of the sketch, and terms with counts that they surely have (of a chunk's commonest)."""
    sketch, best = np.zeros(COUNTERS, np.int64), Counter()
    for t in _chunks(batches):
        for slot, key, pairs in ((t.slot, t.code, False), (t.pair_slot, t.pair, True)):
            sketch += np.bincount(slot, minlength=COUNTERS)
            key, n = np.unique(key, return_counts=True)
            top = np.argsort(-n, kind="stable")[:size]
            best.update(dict(zip(t.names(key[top], pairs), n[top].tolist(), strict=True)))
        if len(best) > 20 * size:
            best = Counter(dict(best.most_common(5 * size)))
    at = np.flatnonzero(sketch.reshape(-1, _BLOCK).any(axis=1))
    packed = [zlib.compress(sketch[k * _BLOCK : (k + 1) * _BLOCK].tobytes(), 1) for k in at]
    terms, n = list(best), list(best.values())
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *[None] * len(terms)], pa.int32()), pa.array([*packed, *[None] * len(terms)], pa.binary()), pa.array([*[None] * len(at), *terms], pa.string()), pa.array([*[None] * len(at), *n], pa.int64())], ["block", "counts", "term", "n"])


def _counted(batches: Iterator[pa.RecordBatch], passes: np.ndarray, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """``term, total, df`` of terms whose counter ``passes``, passed on when there are over ``most`` terms."""
    total, df = Counter(), Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([df[t] for t in total], pa.int64())], ["term", "total", "df"])

    for t in _chunks(batches):
        for slot, key, owner, pairs in ((t.slot, t.code, t.owner, False), (t.pair_slot, t.pair, t.pair_owner, True)):
            on = passes[slot]
            key, at, n = np.unique(key[on], return_inverse=True, return_counts=True)
            each = np.unique(owner[on] * max(len(key), 1) + at) % max(len(key), 1)
            names = t.names(key, pairs)
            total.update(dict(zip(names, n.tolist(), strict=True)))
            df.update(dict(zip(names, np.bincount(each, minlength=len(key)).tolist(), strict=True)))
        if len(total) > most:
            yield out()
            total, df = Counter(), Counter()
    yield out()


def tfidf_fit(docs: DataFrame, id_col: str, text_col: str, size: int = 768) -> DataFrame:
    """``term, idf, pos``: the terms with the largest counts (ties by term), in alphabetical order.

    Exact in two passes whose memory doesn't grow with the distinct terms. The first adds up a sketch, in which a term's
    counter is never below its count, and counts that some terms surely have; the ``size``-th largest of these is no
    larger than that of all counts. The second counts the terms whose counter reaches it.
    """
    n = docs.count()
    texts = docs.select(F.col(text_col).cast("string"))
    made = stored(texts.mapInArrow(lambda batches: _sketched(batches, size), "block int, counts binary, term string, n long"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"]).tobytes()]})

    sure = made.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(size).collect()
    least = min((r["n"] for r in sure), default=0) if len(sure) == size else 0
    sketch = np.zeros(COUNTERS, np.int64)
    for r in made.where("block is not null").groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():  # 8 MB at most
        sketch[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.int64)
    passes = docs.sparkSession.sparkContext.broadcast(sketch >= least)
    counts = texts.mapInArrow(lambda batches: _counted(batches, passes.value), "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    top = counts.orderBy(F.desc("total"), "term").limit(size)
    return top.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"), (F.row_number().over(Window.orderBy("term")) - 1).alias("pos"))


def tfidf(docs: DataFrame, model: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, term, weight``: sparse rows of length 1, each made where its text is; ids are unique.

    The vocabulary has a fixed size and goes along with the function.
    """
    known = {r["term"]: (r["pos"], r["idf"]) for r in model.collect()}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, term, weight = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = [(known[t][0], t, n * known[t][1]) for t, n in Counter(filter(known.__contains__, terms(text.as_py()))).items()]
                length = math.sqrt(math.fsum(w * w for *_, w in found))
                at += [i] * len(found)
                pos += [p for p, _, _ in found]
                term += [t for _, t, _ in found]
                weight += [w / length for *_, w in found]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(term, pa.string()), pa.array(weight, pa.float64())], ["id", "pos", "term", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, pos int, term string, weight double")


def dense(rows: DataFrame, docs: DataFrame, id_col: str, size: int) -> DataFrame:
    """``id, embedding``: dense rows, zeros for texts without a known term."""
    by = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "weight"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)).cast("float"))
    return docs.select(F.col(id_col).alias("id")).join(by, "id", "left").select("id", at.alias("embedding"))


def compressed(rows: DataFrame) -> DataFrame:
    """``id, pos, w``: each text's places and weights as two arrays (``rows``: ``id, pos, weight``)."""
    by = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "weight"))).alias("e"))
    return by.select("id", F.col("e.pos").alias("pos"), F.col("e.weight").alias("w"))


def _spread(f: pd.DataFrame, size: int) -> np.ndarray:
    x = np.zeros((len(f), size))
    for row, pos, w in zip(x, f["pos"], f["w"], strict=True):
        row[pos] = w
    return x


def singular(rows: DataFrame, size: int, k: int, more: int = 10, power: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of sparse rows (``compressed``) of ``size`` columns, and their right vectors (size x k).

    Randomised subspace iteration: A^T A times a thin matrix is a sum over rows, which tasks add up; with ``power``
    rounds. Each vector's largest entry is positive. There are as many values as the rows' rank at most.
    """
    rows = stored(rows.select("pos", "w"))
    thin = min(size, k + more)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, thin)))[0]
    z = None
    for _ in range(power + 1):

        def part(f: pd.DataFrame, q=q) -> np.ndarray:
            out = np.zeros((size, thin))
            for a in range(0, len(f), 1000):
                x = _spread(f.iloc[a : a + 1000], size)
                out += x.T @ (x @ q)
            return out.ravel()

        got = summed(rows, part)
        if got is None:
            return np.zeros(0), np.zeros((size, 0))
        z, last = got.reshape(size, thin), q
        q = np.linalg.qr(z)[0]
    values, turn = np.linalg.eigh(last.T @ z)
    keep = np.argsort(-values)[:k]
    keep = keep[values[keep] > 1e-12 * max(values.max(), 1e-300)]
    axes = last @ turn[:, keep]
    axes = axes * np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    return np.sqrt(values[keep]), axes


def projected(rows: DataFrame, docs: DataFrame, id_col: str, axes: np.ndarray, k: int) -> DataFrame:
    """``id, embedding``: sparse rows on the axes, filled up with zeros to k; zeros for texts without a known term."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            y = np.stack([w @ axes[pos] for pos, w in zip(f["pos"], f["w"], strict=True)]) if len(f) else np.zeros((0, axes.shape[1]))
            yield pd.DataFrame({"id": f["id"], "embedding": list(np.pad(y, ((0, 0), (0, k - axes.shape[1]))).astype(np.float32))})

    made = rows.mapInPandas(run, f"id {kind}, embedding array<float>")
    zero = F.array_repeat(F.lit(0.0).cast("float"), k)
    return docs.select(F.col(id_col).alias("id")).join(made, "id", "left").select("id", F.coalesce("embedding", zero).alias("embedding"))


def parity(a: DataFrame, b: DataFrame, key: str, hard: float = 0.999, soft: float = 1e-4) -> DataFrame:
    """How far two embedding tables differ: largest and mean difference, smallest cosine, and the verdict."""
    x, y = a.select(key, F.col("embedding").alias("x")), b.select(key, F.col("embedding").alias("y"))
    gap = F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    rows = x.join(y, key).select(F.array_max(gap).alias("most"), (F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size(gap)).alias("mean"), cosine(F.col("x"), F.col("y")).alias("cos"))
    out = rows.agg(F.max("most").alias("max_diff"), F.avg("mean").alias("mean_diff"), F.min("cos").alias("min_cosine"))
    return out.withColumn("verdict", F.when(F.col("min_cosine") < hard, "fail").when(F.col("max_diff") < soft, "pass").otherwise("soft pass"))

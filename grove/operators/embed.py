"""Pluggable dense embeddings: any encoder runs batch by batch on the executors and is loaded once for each worker."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.vectors import compressed, dense, projected, singular, terms, tfidf, tfidf_fit
from grove.storage import stored

DIM, MOST_TOKENS, BATCH = 768, 512, 8
Encoder = Callable[[list[str]], np.ndarray]
_loaded: dict = {}


def encoder(load: Callable[[], Encoder], key: str) -> Encoder:
    """One encoder for each worker process."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def encoded(codes: list[str], primary: Encoder, fallback: Encoder | None, dim: int, batch: int = BATCH) -> np.ndarray:
    """Batches by ``primary``; one that fails is tried by ``fallback`` (say, on the CPU), then is zeros."""
    out = np.zeros((len(codes), dim), np.float32)
    for at in range(0, len(codes), batch):
        for model in filter(None, (primary, fallback)):
            try:
                out[at : at + batch] = model(codes[at : at + batch])
                break
            except Exception:  # noqa: BLE001  models fail in many ways
                continue
    return out


def embed(files: DataFrame, load: Callable[[], Encoder], dim: int = DIM, load_fallback: Callable[[], Encoder] | None = None, key: str = "model", batch: int = BATCH) -> DataFrame:
    """``filepath, embedding`` of ``filepath, code``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(load, key)
        other = encoder(load_fallback, f"{key}/fallback") if load_fallback else None
        for f in frames:
            yield pd.DataFrame({"filepath": f["filepath"], "embedding": list(encoded(f["code"].fillna("").tolist(), model, other, dim, batch))})

    return files.select(F.col("filepath").cast("string").alias("filepath"), "code").mapInPandas(run, "filepath string, embedding array<float>")


def code_embeddings(files: DataFrame, load: Callable[[], Encoder] | None = None, dim: int = DIM, components: int | None = None) -> DataFrame:
    """The given encoder's embeddings, else TF-IDF fitted to these files, on its ``components`` main axes if that is set."""
    if load is not None:
        return embed(files, load, dim)
    rows = tfidf(files, tfidf_fit(files, "filepath", "code", dim), "filepath", "code")
    if components is None:
        return dense(rows, files, "filepath", dim).withColumnRenamed("id", "filepath")
    sparse = stored(compressed(rows))
    return projected(sparse, files, "filepath", singular(sparse, dim, components)[1], components).withColumnRenamed("id", "filepath")


def tfidf_encoder(model: DataFrame, size: int = DIM) -> Callable[[], Encoder]:
    """What ``embed`` takes, from a fitted TF-IDF model: its vocabulary, of a fixed size, goes along with the function."""
    known = {r["term"]: (r["pos"], r["idf"]) for r in model.collect()}

    def load() -> Encoder:
        def encode(codes: list[str]) -> np.ndarray:
            out = np.zeros((len(codes), size), np.float32)
            for row, code in zip(out, codes, strict=True):
                for term, n in Counter(filter(known.__contains__, terms(code))).items():
                    row[known[term][0]] = n * known[term][1]
                row /= np.linalg.norm(row) or 1
            return out

        return encode

    return load


def register_embed(spark: SparkSession, load: Callable[[], Encoder], dim: int = DIM, name: str = "embed") -> str:
    """Makes an encoder callable from SQL: ``embed(code)`` gives its vector, zeros where it fails or the code is null."""
    key = f"sql/{name}/{uuid.uuid4().hex}"

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder(load, key)
        for codes in parts:
            yield pd.Series(list(encoded(codes.fillna("").tolist(), model, None, dim)))

    spark.udf.register(name, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER))
    return name

"""What the training-data operators share: words, batches, shared storage, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from grove.storage import running, sealed

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder, from where every executor can read them again."""
    return sealed(df)


def attach(df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", limit: int = 200_000, rows: int | None = None) -> DataFrame:
    """Joins ``small``: broadcast when it has at most ``limit`` rows, else shuffled (adaptive execution splits skewed keys)."""
    n = small.limit(limit + 1).count() if rows is None else rows
    return df.join(F.broadcast(small) if n <= limit else small.hint("merge"), on, how)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``id, t``: texts under numbers in the order of their ids, and the ids behind numbers unless they are integers."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, IntegralType):
        return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), None
    names = docs.select(F.col(id_col).alias("name")).where("name is not null").distinct()
    names = keep(running(names, [F.col("name")], F.lit(1).cast("long"), "number").select("name", "number"))
    return docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("t")).join(names, "name", "left").select(F.col("number").alias("id"), "t"), names


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold every row of each of their groups; one batch and one group are in memory at a time."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by).to_numpy()
        if rest and rest[0].column(by)[0].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        other = np.flatnonzero(key != key[-1])
        if len(other):
            yield pa.Table.from_batches([*rest, batch.slice(0, other[-1] + 1)])
            rest = []
        rest.append(batch.slice(other[-1] + 1 if len(other) else 0))
    if rest:
        yield pa.Table.from_batches(rest)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    while stem in df.columns:
        stem += "_"
    return stem


def fresh(stem: str) -> str:
    """A name that no other query uses."""
    return f"{stem}_{uuid.uuid4().hex[:12]}"


def filled(texts: pa.Array) -> pa.Array:
    """Null texts become empty ones."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def lean() -> None:
    """Lets an Arrow function's memory go back to the system at once, as several workers share an executor's memory."""
    pa.set_memory_pool(pa.system_memory_pool())


def by_bytes(sizes: np.ndarray, limit: int):
    """Slices of consecutive rows with about ``limit`` bytes each (one row at least)."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and for each the row it came from."""
    lists = pc.ascii_split_whitespace(texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), owner.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes and the distinct values behind them."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)

"""Vectors added up over all rows: what gradient and centre steps send to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(f: pd.DataFrame, col: str = "features") -> np.ndarray:
    return np.stack(f[col].to_numpy()).astype(float)


def added(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], groups: int = 16) -> DataFrame:
    """``v``: one row, the sum of ``part`` over batches of rows; none without rows.

    A task adds up its batches, ``groups`` tasks the tasks' vectors, and one task these.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            if len(f):
                total = part(f) if total is None else total + part(f)
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum(np.stack(f["v"].to_numpy()), axis=0)]})

    kind = "v array<double>"
    some = rows.mapInPandas(run, kind).groupBy((F.spark_partition_id() % groups).alias("g")).applyInPandas(add, kind)
    return some.groupBy(F.lit("all")).applyInPandas(add, kind)


def summed(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], groups: int = 16) -> np.ndarray | None:
    """The sum of ``part`` over batches of rows, None without rows: one vector reaches the driver, whatever the number of tasks."""
    got = added(rows, part, groups).collect()
    return np.array(got[0]["v"]) if got else None

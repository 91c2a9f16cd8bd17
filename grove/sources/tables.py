"""Feature tables and embedding matrices from files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grove.operators.structural import FEATURES

_WHOLE = [f for f in FEATURES if f not in ("avg_function_length", "has_recursion", "has_main_guard", "has_type_hints")]
SCHEMA = "filepath string, filename string, " + ", ".join(f"{f} {'long' if f in _WHOLE else 'double' if f == 'avg_function_length' else 'boolean'}" for f in FEATURES)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature CSV; columns are found by name, those of the known features get their types."""
    header = spark.read.option("header", True).csv(path)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return header.select(*(header[c].cast(kinds.get(c, "string")).alias(c) for c in header.columns))


class MatrixSource(DataSource):
    """A NumPy matrix (.npy, rows one after another) as ``row_id long, embedding array<float>``, read by ranges of rows.

    Options: ``path`` (local or any address that Arrow's file systems open) and ``split_bytes``, the size of a range.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row_id long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path = path if "://" in path or path.startswith("file:") else str(Path(path).absolute())
        with self._open() as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            self.start = f.tell()
        if len(shape) != 2 or fortran or kind.hasobject:
            raise ValueError(f"not a matrix of numbers in row order: shape {shape}, {kind}")
        self.rows, self.width, self.kind = *shape, kind
        self.step = max(1, split_bytes // max(1, self.width * kind.itemsize))

    def _open(self):
        where, path = fs.FileSystem.from_uri(self.path)
        return where.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.step, self.rows))) for a in range(0, self.rows, self.step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        size = self.width * self.kind.itemsize
        with self._open() as f:
            f.seek(self.start + first * size)
            for at in range(first, last, 4096):
                n = min(4096, last - at)
                x = np.frombuffer(f.read(n * size), self.kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], ["row_id", "embedding"])


def read_matrix(spark: SparkSession, path: str, names: list[str] | str, split_bytes: int = 64 << 20) -> DataFrame:
    """``filepath, embedding, row_id`` of a NumPy matrix and the paths in its rows' order (a list or a JSON file of one).

    Tasks read ranges of rows of about ``split_bytes`` at their place in the file; only the header is read before.
    """
    spark.dataSource.register(MatrixSource)
    rows = spark.read.format("npy_matrix").option("path", path).option("split_bytes", split_bytes).load()
    if isinstance(names, str):
        listed = spark.read.text(names, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("row_id", "filepath"))
    else:
        listed = spark.createDataFrame(list(enumerate(names)), "row_id long, filepath string")
    if (n := MatrixReader(path, split_bytes).rows) != (m := listed.count()):
        raise ValueError(f"the matrix has {n} rows for {m} files")
    return rows.join(listed.withColumn("row_id", F.col("row_id").cast("long")), "row_id").select("filepath", "embedding", "row_id")

"""Cutting lineage where an iterative plan needs it: files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one on a local master only."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="grove-"))
    return sc.getCheckpointDir()


def sealed(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``sealed``, but as Parquet, of which later steps read the columns that they need only."""
    at = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever it is stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text wherever the path is stored, over what is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def running(df: DataFrame, order: list[Column], value: Column, out: str, peers: bool = True) -> DataFrame:
    """``out``: the running total of ``value`` in the given order (with ``peers``, equal rows share theirs).

    Rows are dealt out by ranges of the order; only one total for each range reaches the driver, so no task sees all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sealed(df.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(rows.groupBy("_part").agg(F.sum("_value").alias("n")).collect()):
        before[r["_part"]], total = total, total + r["n"]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_part")) if before else F.lit(0)
    frame = Window.partitionBy("_part").orderBy(*order)
    inner = F.sum("_value").over(frame if peers else frame.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, inner + start).drop("_value", "_part")

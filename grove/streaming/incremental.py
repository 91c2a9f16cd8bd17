"""Keeping a store up to date from a folder that files arrive in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.config import EXCLUDED
from grove.operators.store import VectorStore, new_or_changed
from grove.sources.files import valid
from grove.storage import sealed


def follow(spark: SparkSession, directory: str, store: VectorStore, embed: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True, patterns=EXCLUDED):
    """Each micro-batch embeds the files whose hash is new and upserts them, under the scan's rules for names, sizes and encoding; edits in place are found by a batch run."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(directory)
    files = raw.where(valid(F.regexp_replace("path", "^file:/*", "/"), F.col("length"), F.col("content"), patterns)).select(F.col("path").alias("filepath"), F.decode("content", "UTF-8").alias("code"))

    def upsert(batch: DataFrame, _: int) -> None:
        fresh = sealed(new_or_changed(batch, store.of(batch)))
        store.add(fresh.join(embed(fresh), "filepath"))

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

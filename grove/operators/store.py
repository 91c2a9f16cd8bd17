"""A vector store in Parquet: hash-based change detection, a log of upserts by path, ordered lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.text import basename, code_hash

SCHEMA = "filepath string, filename string, code_hash string, embedding array<float>"
DEFAULT_PLACE = "data/vector_store"


def records(files: DataFrame) -> DataFrame:
    """Store records of ``filepath, code, embedding``."""
    return files.select("filepath", basename(F.col("filepath")).alias("filename"), code_hash(F.col("code")).alias("code_hash"), F.col("embedding").cast("array<float>").alias("embedding"))


def new_or_changed(files: DataFrame, store: DataFrame) -> DataFrame:
    """The files whose path is unknown or whose text has another hash; the model runs on these only."""
    known = store.where("filepath is not null and code_hash is not null").select("filepath", F.col("code_hash").alias("_hash"))
    return files.join(known, "filepath", "left").where(F.col("_hash").isNull() | (F.col("_hash") != code_hash(F.col("code")))).drop("_hash")


def merged(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store after an upsert: new records replace those with their path; of equal paths in ``new`` any one stays."""
    return store.join(new.select("filepath"), "filepath", "left_anti").select(store.columns).unionByName(new.dropDuplicates(["filepath"]))


def lookup(store: DataFrame, requests: DataFrame) -> DataFrame:
    """``pos, filepath, embedding`` of ``requests`` (``pos, filepath``), null where the store has none."""
    return requests.join(store.select("filepath", "embedding"), "filepath", "left").select("pos", "filepath", "embedding").orderBy("pos")


class VectorStore:
    """A log of upserts at a path, merged when read.

    Each ``add`` writes a folder ``v<N>`` with its records by ``bucket``, a hash of the path. Records of a path in a later
    folder replace those before. A bucket that ``MOST`` folders have is rewritten as a whole: ``full/bucket=b`` in a new
    folder stands for everything before it there. Spark writes ``_SUCCESS`` last, and folders without it are not read,
    so a write that breaks off changes nothing. What a rewriting made useless goes with the next one, so that readers
    of the state before can end.
    """

    BUCKETS, MOST = 64, 8

    def __init__(self, spark: SparkSession, path: str = DEFAULT_PLACE, dim: int = 768):
        self.spark, self.path, self.dim = spark, path, dim

    def _fs(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, *below: str) -> list[str]:
        fs, path = self._fs()
        at = path("/".join((self.path, *below)))
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[int]:
        """All folders' numbers, broken off ones too, as a number is used once only."""
        return sorted(int(n[1:]) for n in self._names() if n[:1] == "v" and n[1:].isdigit())

    def _log(self) -> dict[int, list[tuple[int, str, bool]]]:
        """For each bucket the complete folders that have it, as number, kind and whether it is still needed."""
        out: dict[int, list[tuple[int, str, bool]]] = {}
        for n in self._versions():
            for kind in ("delta", "full"):
                names = self._names(f"v{n}", kind)
                for name in names if "_SUCCESS" in names else ():
                    if name.startswith("bucket="):
                        out.setdefault(int(name[7:]), []).append((n, kind, True))
        for b, log in out.items():
            start = max((n for n, kind, _ in log if kind == "full"), default=-1)
            out[b] = [(n, kind, n >= start) for n, kind, _ in log]
        return out

    def _folders(self, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.path}/v{n}/{kind}/bucket={b}" for b, log in self._log().items() if buckets is None or b in buckets for n, kind, needed in log if needed]

    def _read(self, folders: list[str]) -> DataFrame:
        """The newest record of each path; nulls are a path too."""
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders).select("*", F.regexp_extract("_metadata.file_path", r"/v(\d+)/(?:delta|full)/bucket=", 1).cast("int").alias("_v"))
        if len({f.split("/bucket=")[1] for f in folders}) == len(folders):  # no bucket has two folders
            return rows.drop("_v")
        kept = [c for c in rows.columns if c not in ("filepath", "_v")]
        return rows.groupBy("filepath").agg(F.max_by(F.struct(*kept), "_v").alias("r")).select("filepath", *(F.col(f"r.{c}") for c in kept))

    def _write(self, rows: DataFrame, kind: str) -> int:
        n = max(self._versions(), default=-1) + 1
        bucket = F.pmod(F.xxhash64("filepath"), F.lit(self.BUCKETS)).cast("int")
        rows = rows.withColumn("bucket", bucket).repartition(F.col("bucket"))
        if kind == "delta":
            rows = rows.dropDuplicates(["bucket", "filepath"])
        rows.write.partitionBy("bucket").parquet(f"{self.path}/v{n}/{kind}")
        return n

    def all(self) -> DataFrame:
        return self._read(self._folders())

    def of(self, paths: DataFrame) -> DataFrame:
        """The records of some ``filepath``: only their buckets are read."""
        bucket = F.pmod(F.xxhash64("filepath"), F.lit(self.BUCKETS)).cast("int")
        asked = {r["b"] for r in paths.select(bucket.alias("b")).distinct().collect()}
        return self._read(self._folders(asked)).join(paths.select("filepath").distinct(), "filepath", "left_semi")

    def add(self, files: DataFrame) -> int:
        """Upserts ``filepath, code, embedding``; returns how many. ``files`` are evaluated once, by the write."""
        n = self._write(records(files), "delta")
        if not any(name.startswith("bucket=") for name in self._names(f"v{n}", "delta")):
            fs, path = self._fs()
            fs.delete(path(f"{self.path}/v{n}"), True)
            return 0
        added = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{n}/delta").count()
        self.compact()
        return added

    def compact(self, most: int | None = None) -> set[int]:
        """Rewrites the buckets that ``most`` folders or more have, and removes what the rewriting before made useless."""
        log = self._log()
        due = {b for b, seen in log.items() if sum(needed for *_, needed in seen) >= (most or self.MOST)}
        if due:
            fs, path = self._fs()
            useless = [f"{self.path}/v{n}/{kind}/bucket={b}" for b, seen in log.items() for n, kind, needed in seen if not needed]
            self._write(self._read(self._folders(due)), "full")
            for at in useless:
                fs.delete(path(at), True)
            for n in self._versions()[:-1]:
                if not any(name.startswith("bucket=") for kind in ("delta", "full") for name in self._names(f"v{n}", kind)):
                    fs.delete(path(f"{self.path}/v{n}"), True)
        return due

    def hashes(self) -> DataFrame:
        return self.all().select("filepath", "code_hash").where("filepath is not null and code_hash is not null")

    def count(self) -> int:
        return self.all().count()

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

"""Scanning source trees: globs, sizes, encodings, batches and file statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.config import EXCLUDED, MAX_BYTES, MIN_BYTES
from grove.functions.text import basename, code_lines, total_lines
from grove.storage import running


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression for a shell glob in which ``*`` and ``?`` also match slashes."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w/])", r"\\\1", c)
    return rf"(?s)\A{out}\z"


def excluded(path: Column, patterns=EXCLUDED) -> Column:
    """Whether the whole path or its last part matches any glob."""
    hits = [F.coalesce(p.rlike(glob_regex(g)), F.lit(False)) for g in patterns for p in (path, basename(path))]
    return F.greatest(F.lit(False), F.lit(False), *hits)


def valid(path: Column, size: Column, content: Column, patterns=EXCLUDED) -> Column:
    """A Python file that no pattern leaves out, within the size bounds, in UTF-8."""
    return path.endswith(".py") & ~excluded(path, patterns) & size.between(MIN_BYTES, MAX_BYTES) & F.is_valid_utf8(content)


def scan(spark: SparkSession, directory: str, recursive: bool = True, patterns=EXCLUDED) -> DataFrame:
    """``path, filename, size_bytes, content, code`` of the valid files; sizes are tested before contents are read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    rows = raw.where(F.col("length").between(MIN_BYTES, MAX_BYTES)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), "content")
    rows = rows.where(~excluded(F.col("path"), patterns) & F.is_valid_utf8(F.col("content")))
    return rows.select("path", basename(F.col("path")).alias("filename"), "size_bytes", "content", F.decode("content", "UTF-8").alias("code"))


def lenient(spark: SparkSession, directory: str) -> DataFrame:
    """``path, code`` of every Python file with some text, undecodable bytes left out, in path order (for training)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(directory)
    rows = raw.select("path", F.regexp_replace(F.expr("make_valid_utf8(cast(content AS string))"), "�", "").alias("code"))
    return rows.where(F.col("code").rlike(r"\S")).orderBy("path")


def first_files(files: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` files by path; 0 or None: all."""
    return files.orderBy("path").limit(limit) if limit else files


def batches(files: DataFrame, size: int = 32, readable: Column | None = None) -> DataFrame:
    """``batch_id``: slices of ``size`` files by path, cut before unreadable ones drop out, so batches may shrink."""
    if size < 1:
        raise ValueError("a batch holds one file at least")
    numbered = running(files, [F.col("path")], F.lit(1), "_n", peers=False).withColumn("batch_id", F.floor((F.col("_n") - 1) / size)).drop("_n")
    return numbered.where(readable) if readable is not None else numbered


def file_info(files: DataFrame) -> DataFrame:
    """Size, lines and code lines of each file, or its error."""
    ok = F.is_valid_utf8(F.col("content")) if "content" in files.columns else F.col("code").isNotNull()
    text = F.when(ok, F.col("code"))
    return files.select("path", basename(F.col("path")).alias("filename"), "size_bytes", total_lines(text).alias("lines"), code_lines(text).alias("code_lines"), F.when(~ok, "not UTF-8").alias("error"))


def collection_stats(info: DataFrame) -> DataFrame:
    """Count, kilobytes, lines and lines a file; files with an error count, their lines don't."""
    fine = F.col("error").isNull()
    n = F.count("*")
    total = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0)).cast("long")
    return info.agg(n.alias("file_count"), F.round(total("size_bytes") / 1024, 2).alias("total_size_kb"), total("lines").alias("total_lines"), total("code_lines").alias("total_code_lines"), F.coalesce(F.round(total("lines") / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("avg_lines"))


def repo_info(files: DataFrame, pattern: str = r"([^/]+__[^/]+)/") -> DataFrame:
    """Files and megabytes of each repository folder (``owner__name``), without exclusions."""
    repo = F.regexp_extract("path", pattern, 1)
    return files.where(F.col("path").endswith(".py")).groupBy(repo.alias("repo")).agg(F.count("*").alias("python_files"), F.round(F.sum("size_bytes") / 1048576, 2).alias("size_mb"))

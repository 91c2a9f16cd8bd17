"""The corpus pipeline: rules, near duplicates, personal data, mixing, packing; each stage reads what the one before wrote.

Decisions are joined back by a hash of a row's whole content, not by ``doc_id``: null and repeated ids are fine, and rows
that are equal in every column get equal decisions. All stages give an empty result for an empty table, and keep columns
that they don't know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import attach, free_name, fresh, keep
from grove.llm.mixing import mix
from grove.llm.ngram_join import ngram_components
from grove.llm.packing import pack
from grove.llm.pii import masked, personal_data
from grove.llm.quality import quality_rules
from grove.storage import removed, shared_dir

#: So many rows of keys and counts (16 MB) are broadcast; more are joined by shuffling.
ROWS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a hash of their content, and that column's name."""
    key = free_name(docs, "_key")
    return docs.withColumn(key, F.xxhash64(*docs.columns)), key


def _single(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key. Only keys are counted; rows that are alone with theirs are not shuffled."""
    again = keep(rows.groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return rows
    return attach(rows, again, key, "left_anti", ROWS).unionByName(attach(rows, again, key, "left_semi", ROWS).dropDuplicates([key]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and wordless texts fail the rules; equal rows go or stay together."""
    rows, key = _keyed(docs)
    gone = keep(quality_rules(rows, id_col=key).where(~F.col("kept")).select(key).distinct())
    return attach(rows, gone, key, "left_anti", ROWS).drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by alike word shingles, directly or through others, one stays, chosen by its hash.

    Rows that are equal in every column count once. Texts without words are linked with nothing.
    """
    rows, key = _keyed(docs)
    gone = keep(ngram_components(rows, id_col=key).where(F.col("component_id") != F.col(key)).select(key).distinct())
    return attach(_single(rows, key), gone, key, "left_anti", ROWS).drop(key)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; null texts stay null."""
    name = free_name(docs, "spans")
    text = masked(F.col("text"), F.col(name))
    return personal_data(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; equal rows share theirs. Texts without words are left out."""
    rows, key = _keyed(docs)
    many = free_name(docs, "_copies")
    copies = keep(mix(rows, id_col=key).groupBy(key).agg(F.sum("copies").cast("int").alias(many)).where(F.col(many) > 0))
    rows = attach(_single(rows, key), copies, key, "inner", ROWS)
    return rows.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece. Null texts are their end alone; every row is packed."""
    return pack(docs)


STAGES = [("quality rules", quality), ("n-gram join", near_duplicates), ("personal data", private), ("mixing", mixing), ("packing", packing)]
#: The stages run models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder, read again and then removed."""
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    top = f"{shared_dir(spark)}/{fresh('pipeline')}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, rows, sf_dir).write.parquet(f"{top}/{k}")
        if before:
            removed(spark, before)
        before = f"{top}/{k}"
        rows = spark.read.parquet(before)
    return rows

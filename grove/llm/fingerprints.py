"""Document fingerprints: a homomorphic multiset hash of paragraphs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import numbered

#: Exact lanes of 32 bits; sketch lanes of 16 bits, two to a summed column.
EXACT, PACKED = 8, 32
SKETCH = 2 * PACKED
_32, _16 = 1 << 32, 1 << 16


def vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, vec``: for each group of rows, the sum of its paragraphs' vectors.

    A paragraph (a line) adds EXACT hashes of itself, modulo 2**32, and for each pair of its neighbouring words +1 or -1
    to one of SKETCH lanes, modulo 2**16. Sums don't depend on order; a paragraph is deleted by subtracting its vector.
    """
    line = df.select(*keys, F.explode(F.split(text, "\n")).alias("_p"))
    words = F.split("_p", " ")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    whole = [F.xxhash64(F.lit(i), "_p").bitwiseAND(_32 - 1).alias(f"_e{i}") for i in range(EXACT)]
    line = line.select(*keys, *whole, pairs.alias("_pairs"))  # the line itself stays behind: it may be long
    unit = line.select(*keys, *(f"_e{i}" for i in range(EXACT)), F.posexplode("_pairs").alias("_j", "_h"))
    unit = unit.withColumns({"_slot": F.col("_h").bitwiseAND(PACKED - 1), "_one": F.expr("shiftleft(if(_h & 64 = 0, 1L, -1L), if(_h & 128 = 0, 0, 32))")})
    exact = [F.sum(F.when(F.col("_j") == 0, F.col(f"_e{i}")).otherwise(F.lit(0))).alias(f"e{i}") for i in range(EXACT)]
    packed = [F.sum(F.when(F.col("_slot") == i, F.col("_one")).otherwise(F.lit(0))).alias(f"s{i}") for i in range(PACKED)]
    sums = unit.groupBy(*keys).agg(*exact, *packed)
    low = lambda c: F.pmod(c + _32 // 2, F.lit(_32)) - _32 // 2  # noqa: E731  the lower of two signed numbers
    lanes = [F.pmod(F.col(f"e{i}"), F.lit(_32)) for i in range(EXACT)]
    for i in range(PACKED):
        c = F.col(f"s{i}")
        lanes += [F.pmod(low(c), F.lit(_16)), F.pmod(F.shiftright(c - low(c), 32), F.lit(_16))]
    return sums.select(*keys, F.array(*lanes).alias("vec"))


def text_of(vec: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.lower(F.array_join(F.transform(vec, lambda x, i: F.when(i < EXACT, F.lpad(F.hex(x), 8, "0")).otherwise(F.lpad(F.hex(x), 4, "0"))), ""))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of a text with the paragraphs of another inserted (sign 1) or deleted (-1)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.pmod(x["a"] + sign * x["b"], F.when(i < EXACT, F.lit(_32)).otherwise(F.lit(_16))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the sketch lanes, at least 0."""
    part = lambda v: F.transform(F.slice(v, EXACT + 1, SKETCH), lambda x: F.when(x >= _16 // 2, x - _16).otherwise(x).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(part(x), part(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, fingerprint, vec`` of every document; rows with equal id and text share a row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    vec = vectors(rows.select("_id", F.length("_t").cast("long").alias("n_chars"), F.sha2("_t", 256).alias("_sha"), "_t").distinct(), ["_id", "n_chars", "_sha"], "_t")
    return vec.select(F.col("_id").alias(id_col), "n_chars", text_of(F.col("vec")).alias("fingerprint"), "vec")


def _bucket(bounds: list[int], c: Column, step: int = 64) -> Column:
    """How many bounds after the first are at or below a value, by a search in two levels; nulls come last."""
    if not bounds:
        return F.lit(0)
    step = max(step, int(len(bounds) ** 0.5))
    every = F.lit(bounds[::step])
    coarse = F.greatest(F.size(F.filter(every, lambda b: b <= c)) - 1, F.lit(0))
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)), lambda b: b <= c))
    return F.coalesce(F.greatest(coarse * step + fine - 1, F.lit(0)), F.lit(len(bounds) - 1))


def with_next(rows: DataFrame, bucket_bytes: int = 32 << 20, most_buckets: int = 1 << 15) -> DataFrame:
    """``_bucket, _row, _id, _t, _next, _guard``: each text beside the next by id (ties: by text; nulls last; then the first).

    ``rows`` are ``_id`` (a number), ``_t``. Ids are cut at quantiles into buckets of about ``bucket_bytes``, several to a
    shuffle partition. Each bucket also gets the first row of the next one as its guard, so no window spans more than a
    bucket, which may spill; texts are shuffled once.
    """
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = min(most_buckets, max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes))
    bounds = sorted(set(rows.agg(F.percentile_approx("_id", [i / n for i in range(n)], max(20_000, 4 * n))).first()[0] or []))
    first = rows.agg(F.min("_id")).first()[0]
    bounds = sorted({first, *bounds}) if bounds else []
    own = rows.withColumns({"_bucket": _bucket(bounds, F.col("_id")), "_guard": F.lit(False)})
    if bounds:
        guard = rows.where(F.col("_id").isin(bounds)).groupBy("_id").agg(F.min("_t").alias("_t"))
        before = F.pmod(_bucket(bounds, F.col("_id")) - 1, F.lit(len(bounds)))
        own = own.unionByName(guard.withColumns({"_bucket": before, "_guard": F.lit(True)}))
    w = Window.partitionBy("_bucket").orderBy("_guard", F.col("_id").asc_nulls_last(), "_t")
    return own.select("_bucket", F.row_number().over(w).alias("_row"), "_id", "_t", F.coalesce(F.lead("_t").over(w), F.first("_t").over(w)).alias("_next"), "_guard")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edit (second half replaced by the next text's start) and their likeness.

    Everything after the one shuffle of texts stays in the partitions of their buckets. A null text is empty; with one
    row only, it is its own next; repeated rows get a row each, ordered by text; ids may have any type that sorts; an
    empty table gives an empty result; other columns are ignored.
    """
    rows, names = numbered(docs, id_col, text_col)
    rows = with_next(rows.select(F.col("id").alias("_id"), F.coalesce("t", F.lit("")).alias("_t")))
    n = F.length("_t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(_t, length(_t) - int(floor(length(_t) / 2)))"), F.expr("left(_next, int(floor(length(_t) / 2)))"))
    rows = rows.withColumns({"n_chars": n.cast("long"), "_half": half, "_edit": F.when(~F.col("_guard"), edited)})
    keys = ["_bucket", "_row", "_id", "_guard", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("_edit", 256))
    both = rows.select(*keys, F.posexplode(F.when(F.col("_guard"), F.array("_t")).otherwise(F.array("_t", "_edit"))).alias("_which", "_text"))
    vec = vectors(both, [*keys, "_which"], "_text")
    w = Window.partitionBy("_bucket").orderBy("_row", "_which")
    vec = vec.withColumns({"_edited": F.lead("vec").over(w), "_after": F.coalesce(F.lead("vec", 2).over(w), F.first("vec").over(w))})
    vec = vec.where((F.col("_which") == 0) & ~F.col("_guard"))
    v, e, x = F.col("vec"), F.col("_edited"), F.col("_after")
    if names is None:
        vec = vec.withColumn("_name", F.col("_id").cast(docs.schema[id_col].dataType))
    else:
        vec = vec.join(names.select(F.col("number").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    return vec.select(F.col("_name").alias(id_col), "n_chars", "edited_sha256", text_of(v).alias("fingerprint"), text_of(e).alias("edited_fingerprint"), likeness(v, e).alias("near_edited"), likeness(v, x).alias("near_next"))

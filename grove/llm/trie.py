"""Conversation prefix trie: turns keyed by digests of their prefixes, rolled up to all ancestors by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import attach, keep

LANES = 4


def prefix_sums(rows: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """``values`` summed up over each key's rows in the given order, the row itself included.

    Rows are dealt out by ranges of key and order, so that the rows of one key may lie in many tasks; of keys that go on
    in the next range, one row of sums a range reaches the driver.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, F.col(key), *order, F.col("_salt")).withColumn("_part", F.spark_partition_id()))
    ends = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.min(key), F.max(key)).collect())
    split = sorted({a[2] for a, b in zip(ends, ends[1:], strict=False) if a[2] == b[1]})
    frame = Window.partitionBy("_part", key).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({v: F.sum(v).over(frame) for v in values})
    if split:
        spark = rows.sparkSession
        some = dealt.join(F.broadcast(spark.createDataFrame([(k,) for k in split], f"{key} {rows.schema[key].dataType.simpleString()}")), key)
        before, carried = {}, []
        for r in sorted(some.groupBy(key, "_part").agg(*(F.sum(v).alias(v) for v in values)).collect(), key=lambda r: (r[key], r["_part"])):
            total = before.get(r[key], [0] * len(values))
            carried.append((r["_part"], r[key], *total))
            before[r[key]] = [t + r[v] for t, v in zip(total, values, strict=True)]
        more = spark.createDataFrame(carried, f"_part int, {key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"_{v} long" for v in values))
        out = out.join(F.broadcast(more), ["_part", key], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*(f"_{v}" for v in values))
    return out.drop("_part", "_salt")


def turns_in_order(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, i, said, n_bytes``: each turn's place from 0, the digest of role and text, and the text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("said"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("i")
    )
    return prefix_sums(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")], ["i"]).select("conv", (F.col("i") - 1).alias("i"), "said", "n_bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The conversations with borrowed heads: their turns (``conv, i, said, n_bytes``), and ``conv, n``, each one's number of turns.

    The first h = crc32(conv) % heads turns are those of conversation conv - conv % group (as many as it has), the rest
    a conversation's own after its first h. At most heads - 1 turns go from a conversation to group others.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = sizes.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % group})
    lent = sizes.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("own").alias("has"))
    convs = keep(convs.join(lent, "base", "left").withColumn("b", F.least("h", F.coalesce("has", F.lit(0)))).select("conv", "base", "own", "h", "b"))
    own = attach(turns, convs.select("conv", "h", "b"), "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("b")).alias("i"), "said", "n_bytes")
    first = turns.where((F.col("i") < heads - 1) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    borrowed = convs.select("conv", "base", "h").join(first, "base").where("i < h").select("conv", "i", "said", "n_bytes")
    return own.unionByName(borrowed), convs.select("conv", (F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *lanes).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, key, up, n_bytes`` of each turn: its prefix's digest, the one before it, and the text's bytes.

    A prefix's digest comes from sums of four 32-bit parts of its turns' SHA-256, each taken with the turn's place, so
    that prefixes of long conversations can be summed up in many tasks.
    """
    placed = F.sha2(F.concat(F.col("i").cast("string"), F.lit(":"), F.col("said")), 256)
    lanes = {f"p{k}": F.conv(F.substring("_p", 8 * k + 1, 8), 16, 10).cast("long") for k in range(LANES)}
    rows = turns.withColumn("_p", placed).withColumns(lanes).drop("_p", "said").withColumns({f"s{k}": F.col(f"p{k}") for k in range(LANES)})
    rows = prefix_sums(rows, "conv", [F.col("i")], [f"s{k}" for k in range(LANES)])
    key = _key(F.col("i") + 1, [F.col(f"s{k}") for k in range(LANES)])
    up = _key(F.col("i"), [F.col(f"s{k}") - F.col(f"p{k}") for k in range(LANES)])
    return rows.select("conv", (F.col("i") + 1).alias("depth"), key.alias("key"), up.alias("up"), "n_bytes")


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """``key, first, ids``: up to ``most`` numbers of a key (sorted rows ``key, conv``) as one text."""
    key, ids, out = None, [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([c[0] for _, c in out], pa.int64()), pa.array([",".join(map(str, c)) for _, c in out], pa.string())], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if k != key or len(ids) == most:
                if ids:
                    out.append((key, ids))
                key, ids = k, []
            ids.append(c)
        yield made()
        out = []
    if ids:
        out.append((key, ids))
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends_sha256`` of sorted chunks; a key's chunks pass one after another and none is kept."""
    key, running, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if running:
                    out.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(ids.encode())
            else:
                running.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "ends_sha256"])
        out = []
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["key", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of a key's numbers (``key, conv``) in ascending order, comma-joined.

    Numbers become texts of 4,096 each in the tasks of their range; only these texts meet in a key's task.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = ends.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(_chunks, "key binary, first long, ids string")
    return chunks.repartition(F.col("key")).sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str], count: int, depth: int) -> DataFrame:
    """``key`` and ``values`` summed over each node's subtree, the node included (``nodes``: ``key, up, depth`` and values).

    After round k a node points to its ancestor 2^k levels up and has the sums of the descendants less than 2^k levels
    below. A round adds to a node the sums of those that point to it and lets every pointer jump, so rounds are as many
    as the depth has binary digits.
    """
    reach, state = 1, nodes.select("key", "up", "depth", *values)
    while reach <= depth:
        low = state.where(F.col("depth") >= reach)  # the others point above the root
        more = low.groupBy("up").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("up", "key")
        jump = low.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        far = attach(low.where(F.col("depth") >= 2 * reach), jump, "up", "left", rows=count).withColumn("up", F.col("_up")).drop("_up")
        all_ = far.unionByName(state.where(F.col("depth") < 2 * reach))
        state = keep(attach(all_, more, "key", "left", rows=count).select("key", "up", "depth", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
        reach *= 2
    return state.select("key", *values)


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 5, heads: int = 9) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations: its members, children and subtree.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, (n_convs - 1) times the bytes of a node's last text), ``ends_sha256``.

    Turns stand in the order of ``turn`` (nulls first), of equals by role, then by the SHA-256 of role and text, and
    repeated rows are turns of their own; null roles and texts are empty. Rows with a null conversation belong to none
    and are left out; an empty table gives an empty result, without a root; other columns are ignored. Long texts are
    hashed where they are read, and one conversation's turns may lie in many tasks.
    """
    turns, convs = rebuilt(turns_in_order(conversations, conv_col, turn_col, role_col, text_col), group, heads)
    rows = keep(prefixes(turns))
    zero = _key(F.lit(0), [F.lit(0)] * LANES)
    start = convs.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = keep(rows.unionByName(start).groupBy("key").agg(F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n_convs")))
    size = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    count, depth = size["n"], size["d"] or 0
    children = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    nodes = attach(attach(nodes, children, "key", "left", rows=count), above, "up", "left", rows=count).withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = keep(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"], count, depth)
    last = attach(rows.select("conv", "depth", "key"), convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"]).select("key", "conv")
    ends = ends_digests(last.unionByName(convs.where("n = 0").select(zero.alias("key"), "conv")))
    out = attach(attach(nodes.drop("n_leaves", "saved_tokens"), sums, "key", rows=count), ends, "key", "left", rows=count)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

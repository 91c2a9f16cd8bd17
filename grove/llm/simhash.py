"""SimHash near-duplicates: fingerprints within a Hamming radius, found by BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import attach, by_bytes, filled, keep, lean, ragged, whole_groups, words
from grove.llm.components import components

#: Differing bits that link; words of a shingle; fingerprints under one key and in one shard's tree; trees that are broadcast.
RADIUS, SHINGLE, MEMBERS, SHARD, TREES = 2, 3, 4096, 8192, 128


def fingerprints(texts: pa.Array, width: int = SHINGLE, batch_bytes: int = 4 << 20, block: int = 400_000) -> np.ndarray:
    """64 bits of each text: those that are set in over half of its shingles' XXH64 (seed 42)."""
    texts, out = filled(texts), np.zeros(len(texts), np.uint64)
    hashed = xxhash.xxh64_intdigest
    for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
        flat, owner = words(pc.ascii_lower(texts.slice(a, b - a)))
        n = np.bincount(owner, minlength=b - a)
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        spaced = pc.binary_join_element_wise(flat.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).buffers()[2]  # each word and a space
        spaced = spaced.to_pybytes() if spaced else b""
        first = np.cumsum(n) - n
        shingles = np.maximum(n - width + 1, np.minimum(n, 1))
        head = ragged(first, shingles)
        of = np.repeat(np.arange(b - a), shingles)
        tail = np.minimum(head + width, (first + n)[of]) - 1
        left, right = start[head].tolist(), (start[tail] + size[tail]).tolist()
        votes = np.zeros((b - a, 64), np.int64)
        for s in range(0, len(head), block):
            e = min(s + block, len(head))
            h = np.fromiter((hashed(spaced[x:y], 42) for x, y in zip(left[s:e], right[s:e], strict=True)), np.uint64, e - s)
            bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
            edge = np.flatnonzero(np.r_[True, of[s + 1 : e] != of[s : e - 1]])
            votes[of[s:e][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
        out[a:b] = np.packbits(2 * votes > shingles[:, None], axis=1).view(np.uint64).ravel()
    return out


def bk_forest(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: a root) and edge of every fingerprint: one BK-tree for each group (sorted), all grown a level at a time."""
    parent, edge = np.full(len(x), -1, np.int64), np.zeros(len(x), np.uint8)
    at, above, apart = np.arange(len(x)), group.astype(np.int64), np.zeros(len(x), np.uint8)
    roots = True
    while len(at):
        order = np.lexsort((at, apart, above))
        at, above, apart = at[order], above[order], apart[order]
        new = np.r_[True, (above[1:] != above[:-1]) | (apart[1:] != apart[:-1])]  # the first one of a parent and distance is the child
        child = at[new]
        if not roots:
            parent[child], edge[child] = above[new], apart[new]
        above, at, roots = child[np.cumsum(new) - 1][~new], at[~new], False
        apart = np.bitwise_count(x[at] ^ x[above])
    return parent, edge


def bk_search(x: np.ndarray, parent: np.ndarray, edge: np.ndarray, q: np.ndarray, root: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within the radius: from its root a query follows the edges that differ by at most the radius from its distance."""
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(len(x)))
    count = np.bincount(parent[parent >= 0], minlength=len(x))
    who, node, hits = np.arange(len(q)), root, []
    while len(who):
        d = np.bitwise_count(q[who] ^ x[node]).astype(np.int64)
        hits.append((who[d <= radius], node[d <= radius]))
        child = order[ragged(first[node], count[node])]
        who, d = np.repeat(who, count[node]), np.repeat(d, count[node])
        follow = np.abs(edge[child] - d) <= radius
        who, node = who[follow], child[follow]
    return tuple(np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in (0, 1))


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tree for each shard of ``shard, key, fp``: a node's fingerprint, parent and edge, one root for each key."""
    for table in whole_groups(batches, "shard"):
        for s in np.unique(shard := table["shard"].to_numpy()):
            key, x = (table[c].to_numpy()[shard == s] for c in ("key", "fp"))
            order = np.argsort(key, kind="stable")
            key, x = key[order], x[order].view(np.uint64)
            parent, edge = bk_forest(np.unique(key, return_inverse=True)[1], x)
            cells = [np.array(v).tobytes() for v in (key[parent < 0], np.flatnonzero(parent < 0), x, parent.astype(np.int32), edge)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["shard", "roots", "at", "x", "parent", "edge"])


def _asked(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a task that ask a shard's tree, in one row for each shard."""
    waiting: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        shard, key, fp = (table[c].to_numpy() for c in ("shard", "key", "fp"))
        for s in np.unique(shard):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([key[shard == s].tobytes()], pa.binary()), pa.array([fp[shard == s].tobytes()], pa.binary())], ["shard", "keys", "fps"])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) > most:
            yield from out()
            waiting = []
    if waiting:
        yield from out()


def _searched(batches: Iterator[pa.RecordBatch], radius: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``a, b``: links that join what the radius joins among fingerprints and a tree, a forest of them for each share of the questions."""
    lean()
    for batch in batches:
        for r in batch.to_pylist():
            key, q, roots, at, x = (np.frombuffer(r[c], t) for c, t in (("keys", np.int64), ("fps", np.uint64), ("roots", np.int64), ("at", np.int64), ("x", np.uint64)))
            parent, edge = np.frombuffer(r["parent"], np.int32).astype(np.int64), np.frombuffer(r["edge"], np.uint8).astype(np.int64)
            which = np.searchsorted(roots, key)
            members = np.diff(np.r_[at, len(x)])[which]  # nodes stand in the order of their keys
            for a, b in by_bytes(members, most):
                who, node = bk_search(x, parent, edge, q[a:b], at[which[a:b]], radius)
                kinds, back = np.unique(np.concatenate([q[a:b][who], x[node]]), return_inverse=True)
                least = _smallest(back[: len(who)], back[len(who) :], len(kinds))
                far = np.flatnonzero(least != np.arange(len(kinds)))
                yield pa.RecordBatch.from_arrays([pa.array(kinds[far].view(np.int64)), pa.array(kinds[least[far]].view(np.int64))], ["a", "b"])


def _thirds(fixed: int, radius: int) -> list[int]:
    """The fixed bits, and with them each of radius + 1 shares of the free ones."""
    free = [1 << i for i in range(64) if not fixed >> i & 1]
    cut = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [fixed | sum(free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def keyed(distinct: DataFrame, radius: int = RADIUS, members: int = MEMBERS) -> DataFrame:
    """``key, fp``: fingerprints under keys of bits that linked ones have in common, at most ``members`` under a key.

    Of radius + 1 shares of the bits, links agree on one. Fingerprints under a fuller key are dealt out again by shares
    of the bits that are still free. With 12 free bits no more than 4,096 can differ, so this ends.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    spark, out = distinct.sparkSession, None
    paths, rows = [0], distinct.select(F.lit(0).alias("path"), "fp")
    while True:
        pairs = [(i, m) for i, p in enumerate(paths) for m in _thirds(p, radius)]
        masks = spark.createDataFrame([(i, j, signed(m)) for j, (i, m) in enumerate(pairs)], "path int, next int, mask long")
        masked = rows.join(F.broadcast(masks), "path").select(F.col("next").alias("path"), F.xxhash64("next", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
        count = keep(masked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        split = members if min(m.bit_count() for _, m in pairs) + radius < 64 else 1 << 62
        small = attach(masked, count.where(F.col("n") <= split).select("key"), "key").select("key", "fp")
        out = small if out is None else out.union(small)
        full = count.where(F.col("n") > split).select("key")
        if full.isEmpty():
            return out
        rows, paths = keep(attach(masked, full, "key").select("path", "fp")), [m for _, m in pairs]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join the same fingerprints (``fp``, each once) as all links within the radius do."""
    asked = keep(keyed(distinct, radius))
    shards = max(1, -(-asked.count() // SHARD))
    asked = asked.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).cast("int"))
    dealt = asked.repartition(F.col("shard"))
    trees = keep(dealt.sortWithinPartitions("shard").mapInArrow(_plant, "shard int, roots binary, at binary, x binary, parent binary, edge binary"))
    asked = (asked if shards <= TREES else dealt).select("shard", "key", "fp").mapInArrow(_asked, "shard int, keys binary, fps binary")
    return attach(asked, trees, "shard", limit=TREES, rows=shards).drop("shard").mapInArrow(lambda b: _searched(b, radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id_col, fingerprint, component_id``: 16 hex digits, and the smallest id that links of at most ``radius`` bits reach.

    Shingles are three words (A-Z lower-cased) with repeats; a text of fewer words is one shingle; no word or no text
    gives zero, which links like any other. Equal fingerprints are searched once. Rows with a null id are linked too,
    and have their component's smallest id, null if there is none; repeated rows get a row each; an empty table gives
    an empty result; other columns are ignored.

    A shard is some keys of ``keyed`` and its tree holds about SHARD fingerprints. Up to TREES trees (17 MB) are
    broadcast to the tasks that hold the questions; more are joined with the questions by shard.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], ["id", "fp"])

    rows = keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(made, f"id {kind}, fp long"))
    each = keep(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    up = components(near_links(each.select("fp"), radius))
    each = attach(each, up.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = each.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).where("n > 1")
    shared = keep(attach(each.select("fp", "root"), whole.select("root", "component_id"), "root").select("fp", "component_id", F.lit(True).alias("_shared")))
    out = attach(rows, shared, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("_shared"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))

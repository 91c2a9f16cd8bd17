"""N-gram Jaccard join: exact links between shingle sets, bounded by count vectors in an R-tree."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import attach, by_bytes, coded, filled, keep, lean, numbered, ragged, whole_groups, words
from grove.llm.components import Joined, components

#: Bits of a shingle's token; with a level and a row number it fills 64.
BITS, LEVEL_BITS, ROWS = 48, 4, 1 << 12
#: Dimensions of a count vector, and counters of the frequency sketch (8 MB, whatever the input) in blocks.
GROUPS, COUNTERS, BLOCK = 256, 1 << 20, 1 << 12
#: Bounds of a task's data: prefix tokens of a part of the token range, documents of a block, tokens of a leaf's sets.
PART, MEMBERS, LEAF = 500_000, 1024, 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def token_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``row << BITS | token`` of all texts (ROWS at most), distinct, and the size of each text's set."""
    n = len(texts)
    word, owner = words(pc.ascii_lower(texts))
    code, distinct = coded(word)
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))
    h, count = known[code], np.bincount(owner, minlength=n)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(owner[: max(0, len(owner) - width + 1)] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
        total = np.full(len(at), width, np.uint64)
        for k in range(width):
            total = (total ^ (total >> np.uint64(31))) * _M + h[at + k]
        row = owner[at]
        short = np.flatnonzero((count > 0) & (count < width))
        start = np.cumsum(count) - count
        extra = np.array(count[short], np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            extra[more] = (extra[more] ^ (extra[more] >> np.uint64(31))) * _M + h[start[short[more]] + k]
        token = _mixed(np.concatenate([total, extra])) >> np.uint64(64 - BITS)
    keys = np.sort(np.concatenate([row, short]).astype(np.uint64) << np.uint64(BITS) | token)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return keys, np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=n)


def _parts(batch: pa.RecordBatch, batch_bytes: int = 2 << 20):
    """Ids and texts of at most ROWS rows and about ``batch_bytes`` bytes."""
    texts = filled(batch.column(1))
    for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
        for i in range(a, b, ROWS):
            yield batch.column(0).slice(i, min(ROWS, b - i)), texts.slice(i, min(ROWS, b - i))


def count_vectors(token: np.ndarray, size: np.ndarray) -> list[bytes]:
    """How many of a set's tokens fall into each group. Larger sets have more groups, about four tokens to each, so that
    the bound stays sharp; the first byte is the width of the counts that follow, or 0 for two counts below 16 in a byte."""
    out, low = [], (token & np.uint64((1 << 31) - 1)).astype(np.int64)
    for end, n in zip(np.cumsum(size), size, strict=True):
        groups = max(GROUPS, 1 << int(n // 4).bit_length())
        v = np.bincount(low[end - n : end] & (groups - 1), minlength=groups)
        most = v.max(initial=0)
        if most < 16:
            half = v.astype(np.uint8).reshape(-1, 2)
            out.append(b"\0" + (half[:, 0] | half[:, 1] << 4).tobytes())
            continue
        kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
        out.append(bytes([int(kind[2])]) + v.astype(kind).tobytes())
    return out


def _vector(raw: bytes, groups: int | None = None) -> np.ndarray:
    """A count vector, folded to ``groups`` groups if it has more: folding adds counts, so the bound still holds."""
    if raw[0]:
        v = np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)
    else:
        half = np.frombuffer(raw, np.uint8, offset=1)
        v = np.stack([half & 15, half >> 4], axis=1).ravel().astype(np.int64)
    return v if groups is None or len(v) == groups else v.reshape(-1, groups).sum(axis=0)


def _groups(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0] if raw[0] else 2 * (len(raw) - 1)


_SUMMARY = "id long, n long, k1 long, k2 long, vec binary, block int, counts binary"


def summaries(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (set size, a hash of the set, its count vector) and, from each task, blocks of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sketch = np.zeros(COUNTERS, np.int64)
        names = [f.split()[0] for f in _SUMMARY.split(", ")]
        for batch in batches:
            for ids, texts in _parts(batch):
                keys, size = token_sets(texts, width)
                token, row = keys & np.uint64((1 << BITS) - 1), (keys >> np.uint64(BITS)).astype(np.int64)
                sketch += np.bincount((token >> np.uint64(BITS - 20)).astype(np.int64), minlength=COUNTERS)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(len(size), np.uint64) for _ in range(2)]
                    start = (np.cumsum(size) - size)[size > 0]
                    for i, s in enumerate(sums):
                        if len(start):
                            s[size > 0] = np.add.reduceat(_mixed(token * _M + np.uint64(i * 77 + 1)), start)
                vec = count_vectors(token, size)
                none = pa.nulls(len(size), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), *(pa.array(s.view(np.int64)) for s in sums), pa.array(vec, pa.binary()), none, pa.nulls(len(size), pa.binary())], names)
        blocks = np.flatnonzero(sketch.reshape(-1, BLOCK).any(axis=1))
        if len(blocks):
            packed = [zlib.compress(sketch[k * BLOCK : (k + 1) * BLOCK].astype("<i8").tobytes(), 1) for k in blocks]
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(blocks), pa.binary()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(run, _SUMMARY)


def levels(blocks: DataFrame, calm: int = 200) -> tuple[bytes, int]:
    """For each counter of the sketch, how far it stands out: 0, or a step for each doubling over ``calm``; and the sum.

    The sketch orders tokens only: any order gives the same links, this one keeps very common tokens out of prefixes.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["counts"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [total.tobytes()]})

    sketch = np.zeros(COUNTERS, np.int64)
    for r in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").collect():  # 8 MB at most
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    mean = sketch.mean()
    over = (sketch - mean - 6 * np.sqrt(mean)) / calm
    return np.where(over > 1, np.clip(np.log2(np.maximum(over, 1)) + 1, 1, (1 << LEVEL_BITS) - 1), 0).astype(np.uint8).tobytes(), int(sketch.sum())


def _raw(token: np.ndarray) -> bytes:
    """Six bytes for each token."""
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def _tokens(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def prefixes(docs: DataFrame, level: bytes, width: int, percent: int, parts: int) -> DataFrame:
    """The tokens that linked sets must share one of: of n, the first n - ceil(n * percent / 100) + 1 in the common order.

    They come packed, a row for each part of the token range and batch: ids and sizes of documents, how many tokens
    each has there, and those tokens. Common tokens (``hot``) are spread over the parts by document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def packed(ids: np.ndarray, size: np.ndarray, row: np.ndarray, token: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        part = np.where(hot, ids[row].view(np.uint64) % np.uint64(parts), token * np.uint64(parts) >> np.uint64(BITS)).astype(np.int64)
        order = np.argsort(part * 2 + hot, kind="stable")
        part, row, token, hot = part[order], row[order], token[order], hot[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (hot[1:] != hot[:-1]) | (row[1:] != row[:-1])]
        each = np.flatnonzero(new)
        many = np.diff(np.r_[each, len(row)]).astype("<i4")
        cut = np.flatnonzero(np.r_[True, (part[each][1:] != part[each][:-1]) | (hot[each][1:] != hot[each][:-1]), True])
        ends = np.r_[each, len(row)]
        name, n = ids[row[each]].astype("<i8"), size[row[each]].astype("<i4")
        out = [(part[ends[a]], hot[ends[a]], name[a:b].tobytes(), n[a:b].tobytes(), many[a:b].tobytes(), _raw(token[ends[a] : ends[b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["part", "hot", "ids", "sizes", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        high = np.frombuffer(shared.value, np.uint8)
        held: list[tuple] = []
        rows = total = 0
        for part in itertools.chain((p for batch in batches for p in _parts(batch)), [None]):
            if part is not None:
                keys, size = token_sets(part[1], width)
                token, row = keys & np.uint64((1 << BITS) - 1), keys >> np.uint64(BITS)
                lv = high[(token >> np.uint64(BITS - 20)).astype(np.int64)]
                order = np.sort(row << np.uint64(52) | lv.astype(np.uint64) << np.uint64(BITS) | token)
                need = size - (size * percent + 99) // 100 + 1
                taken = order[ragged(np.cumsum(size) - size, np.where(size > 0, need, 0))]
                held.append((part[0].to_numpy(zero_copy_only=False), size, (taken >> np.uint64(52)).astype(np.int64) + rows, taken & np.uint64((1 << BITS) - 1), (taken >> np.uint64(BITS)) & np.uint64(15) > 0))
                rows, total = rows + len(size), total + len(taken)
            if total and (part is None or total >= PART):
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, rows, total = [], 0, 0

    return docs.mapInArrow(run, "part int, hot boolean, ids binary, sizes binary, counts binary, tokens binary")


def blocks_of(doc: np.ndarray, size: np.ndarray, token: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Documents that share a token, in runs by size that a link may span: documents, tokens, sizes and where runs start."""
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    doc, size, token = doc[order], size[order].astype(np.int64), token[order]
    order = np.lexsort((doc, size, token))
    doc, size, token = doc[order], size[order], token[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])] if len(doc) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return doc, token, size, start


def routed(packed: DataFrame, parts: int, percent: int) -> DataFrame:
    """Blocks of documents that share a prefix token: ``block, ids``, those with the same documents once in a part; those
    of over MEMBERS documents, and common tokens, as rows ``token, id, n``."""
    members = MEMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        names = ["block", "ids", "token", "id", "n"]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())

        def loose(token: np.ndarray, doc: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(doc), kinds[0]), pa.nulls(len(doc), kinds[1]), pa.array(token.astype(np.int64)), pa.array(doc), pa.array(size.astype(np.int64))], names)

        got: list[tuple] = []
        for batch in batches:
            for hot, *cols in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                many = np.frombuffer(cols[2], "<i4")
                one = (np.repeat(np.frombuffer(cols[0], "<i8"), many), np.repeat(np.frombuffer(cols[1], "<i4"), many), _tokens(cols[3]))
                if hot:
                    yield loose(one[2], one[0], one[1])
                else:
                    got.append(one)
        if not got:
            return
        doc, token, size, start = blocks_of(*map(np.concatenate, zip(*got, strict=True)), percent)
        del got
        many = np.diff(np.r_[start, len(doc)])
        large = many > members
        at = ragged(start[large], many[large])
        if len(at):
            yield loose(token[at], doc[at], size[at])
        start, many = start[~large & (many > 1)], many[~large & (many > 1)]
        if not len(start):
            return
        at = ragged(start, many)
        with np.errstate(over="ignore"):
            key = np.add.reduceat(_mixed(doc[at].astype(np.uint64) * _M + np.uint64(1)), np.cumsum(many) - many) * _M + many.astype(np.uint64)
        key, first = np.unique(key, return_index=True)
        values, many = doc[ragged(start[first], many[first])], many[first]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lists, *(pa.nulls(len(key), k) for k in kinds[2:])], names)

    return packed.repartitionById(parts, "part").mapInArrow(run, "block long, ids array<long>, token long, id long, n long")


def overlap_needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of n and m tokens whose similarity is at least ``percent`` per cent."""
    return -(-percent * (n + m) // (100 + percent))


def _vectors(raw: list[bytes], groups: int) -> np.ndarray:
    return np.stack([_vector(x, groups) for x in raw])


class RTree:
    """A packed R-tree over count vectors: leaves of neighbouring points, boxes of their largest coordinates and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        spread = np.argsort(-points.std(axis=0), kind="stable")[:2] if len(points) else [0, 0]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], sizes)) if len(points) else np.zeros(0, np.int64)
        self.points, self.sizes, self.leaf = points[self.order], sizes[self.order], leaf
        at = np.arange(0, len(points), leaf)
        self.top = np.maximum.reduceat(self.points, at) if len(at) else self.points
        self.low, self.high = self.sizes[at], self.sizes[np.minimum(at + leaf, len(points)) - 1]

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with ``point``, at most the sum of coordinate minima, may reach what a link needs."""
        fits = (100 * self.high >= percent * size) & (percent * self.low <= 100 * size)
        boxes = np.flatnonzero(fits)
        boxes = boxes[np.minimum(self.top[boxes], point).sum(axis=1) >= overlap_needed(np.maximum(self.low[boxes], -(-percent * size // 100)), size, percent)]
        at = (boxes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        at = at[at < len(self.points)]
        low, top = np.minimum(self.sizes[at], size), np.maximum(self.sizes[at], size)
        bound = np.minimum(self.points[at], point).sum(axis=1)
        ok = (100 * low >= percent * top) & (bound >= overlap_needed(self.sizes[at], size, percent))
        return self.order[at[ok][np.argsort(-bound[ok], kind="stable")]]

    def pairs(self, percent: int) -> np.ndarray:
        """All pairs of its points that a link is possible between, as rows of two numbers; a single leaf is compared at once."""
        if len(self.points) > self.leaf:
            near = [self.search(p, n, percent) for p, n in zip(self.points, self.sizes, strict=True)]
            return np.stack([np.repeat(self.order, [len(x) for x in near]), np.concatenate(near)], axis=1)
        a, b = np.triu_indices(len(self.points), 1)
        low, top = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        ok = (100 * low >= percent * top) & (np.minimum(self.points[a], self.points[b]).sum(axis=1) >= overlap_needed(low, top, percent))
        return np.stack([self.order[a[ok]], self.order[b[ok]]], axis=1)


def tree_pairs(raw: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """All pairs of count vectors that a link is possible between, as rows of two positions.

    There is a tree for each number of groups, as vectors folded to fewer bound less well; what may be linked has as
    many groups or half as many, so vectors are also sought, folded once, in the tree below theirs.
    """
    groups = np.fromiter(map(_groups, raw), np.int64, len(raw))
    out = [np.zeros((0, 2), np.int64)]
    for g in np.unique(groups).tolist():
        at, more = np.flatnonzero(groups == g), np.flatnonzero((groups > g) & (100 * n[groups == g].max() >= percent * n))
        tree = RTree(_vectors([raw[i] for i in at], g), n[at])
        out.append(at[tree.pairs(percent)])
        for i in more.tolist():
            hits = at[tree.search(_vector(raw[i], g), n[i], percent)]
            out.append(np.stack([np.full(len(hits), i), hits], axis=1))
    return np.concatenate(out)


def block_pairs(blocks: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs of documents of a block whose count vectors leave a link possible, each block searched through its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for table in whole_groups(batches, "block"):
            block, ids, n = (table.column(k).to_numpy() for k in ("block", "id", "n"))
            raw = table.column("vec").to_pylist()
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            out = [np.zeros((0, 2), np.int64)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out.append(ids[a:b][tree_pairs(raw[a:b], n[a:b], percent)])
            found = np.concatenate(out)
            found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    each = blocks.groupBy("block").agg(F.first("ids").alias("ids")).select("block", F.explode("ids").alias("id"))
    rows = each.join(sets.hint("merge"), "id").select("block", "id", "n", "vec")
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, set``: the sorted tokens, six bytes each, of the documents named in ``ids``, made again from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for names, texts in _parts(batch):
                keys, size = token_sets(texts, width)
                token, ends = keys & np.uint64((1 << BITS) - 1), np.cumsum(size)
                yield pa.RecordBatch.from_arrays([names, pa.array([_raw(token[e - s : e]) for s, e in zip(size, ends, strict=True)], pa.binary())], ["id", "set"])

    return attach(docs, keep(ids), "id", "left_semi", 1_000_000).mapInArrow(sets, "id long, set binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    low, top = sorted((len(x), len(y)))
    if 100 * low < percent * top:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def compared(asked: DataFrame, docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Links among the pairs of each cell (``cell, a, b``) that join the same components as all pairs whose sets have the
    similarity: a task gets each set of a cell once and passes over pairs that are linked already."""
    asked = keep(asked)
    member = asked.select("cell", F.explode(F.array("a", "b")).alias("a")).distinct()
    sets = shingle_sets(docs, member.select(F.col("a").alias("id")).distinct(), width)
    member = member.join(sets.hint("merge"), F.col("a") == F.col("id")).select("cell", "a", F.lit(None).cast("long").alias("b"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for table in whole_groups(batches, "cell"):
            cell, raw = table.column("cell").to_numpy(), table.column("set")
            a, b = (pc.fill_null(table.column(k), 0).to_numpy() for k in "ab")
            is_set = raw.is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            out: list[tuple[int, int]] = []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own: dict[int, list[np.ndarray]] = {}
                for k in range(i, j):
                    if is_set[k]:
                        own.setdefault(int(a[k]), []).append(raw[k].as_py())
                joined = Joined()
                for k in np.flatnonzero(~is_set[i:j]) + i:
                    x, y = int(a[k]), int(b[k])
                    if joined.root(x) != joined.root(y) and any(alike(_tokens(u), _tokens(v), percent) for u in own.get(x, ()) for v in own.get(y, ())):
                        joined.join(x, y)
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    rows = member.union(asked.select("cell", "a", "b", F.lit(None).cast("binary").alias("set")))
    return keep(rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """Links among ``pairs`` (``a, b``) that join the same components as all pairs whose sets have the similarity.

    What pairs hang together is cut by documents into leaves of a bounded size. Pairs inside a leaf are compared first,
    which joins most copies; then one pair for each two components, then every pair that still spans two of them.
    """
    pairs = keep(pairs)
    label = keep(components(pairs))
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")))
    weight = ids.join(sizes.hint("merge"), "id").groupBy("root").agg(F.ceil(F.sum("n") / (4 * LEAF)).alias("leaves"))
    placed = keep(ids.join(weight, "root").select("id", "root", F.pmod(F.xxhash64("id"), "leaves").alias("leaf")))
    side = lambda x: placed.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("leaf").alias(f"leaf_{x}"))
    pairs = keep(pairs.join(side("a"), "a").join(side("b").drop("root_b"), "b"))
    cell = F.xxhash64("root_a", F.least("leaf_a", "leaf_b"), F.greatest("leaf_a", "leaf_b")).alias("cell")
    links = compared(pairs.where("leaf_a = leaf_b").select(cell, "a", "b"), docs, width, percent, parts)
    rest = pairs.where("leaf_a != leaf_b")
    for few in (True, False):
        label = components(links)
        end = lambda x: label.select(F.col("node").alias(x), F.col("root").alias(f"c_{x}"))  # noqa: B023, E731
        rest = rest.join(end("a"), "a", "left").join(end("b"), "b", "left").withColumns({f"c_{x}": F.coalesce(f"c_{x}", x) for x in "ab"}).where("c_a != c_b")
        rest = keep(rest)
        if rest.isEmpty():
            break
        some = rest.groupBy(F.least("c_a", "c_b"), F.greatest("c_a", "c_b")).agg(F.min(F.struct("a", "b", cell)).alias("p")).select("p.cell", "p.a", "p.b") if few else rest.select(cell, "a", "b")
        links = keep(links.union(compared(some, docs, width, percent, parts)))
        rest = rest.drop("c_a", "c_b")
    return links


def leaf_links(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], asks: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join components of a leaf's documents: those that ask (or all) are sought in the tree over the others,
    best bounds first, and compared unless they are already in one component."""
    n = np.array([len(x) for x in sets], np.int64)
    g = max(GROUPS, 1 << int(n.min() // 4).bit_length())
    token = np.concatenate(sets)
    points = np.bincount(np.repeat(np.arange(len(n)) * g, n) + (token & np.uint64(g - 1)).astype(np.int64), minlength=len(n) * g).reshape(-1, g).astype(np.int32)
    base, who = (np.arange(len(n)), np.arange(len(n))) if asks is None else (np.flatnonzero(~asks), np.flatnonzero(asks))
    tree, joined, out = RTree(points[base], n[base]), Joined(), []
    for i in who.tolist():
        for j in base[tree.search(points[i], n[i], percent)].tolist():
            a, b = int(comp[i]), int(comp[j])
            if (asks is not None or j > i) and joined.root(a) != joined.root(b) and alike(sets[i], sets[j], percent):
                joined.join(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def searched(cells: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links found in each cell of ``cell, id, c, asks`` (``asks`` null: all against all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for table in whole_groups(batches, "cell"):
            cell, ids, comp = (table.column(k).to_numpy() for k in ("cell", "id", "c"))
            asks, raw = table.column("asks").to_pylist(), table.column("set")
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            out: list[tuple[int, int]] = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                flags = None if asks[a] is None else np.array(asks[a:b], bool)
                if flags is None or flags.any() and not flags.all():
                    out += leaf_links(ids[a:b], comp[a:b], [_tokens(x.as_py()) for x in raw.slice(a, b - a)], flags, percent)
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    rows = cells.join(sets.hint("merge"), "id").select("cell", "id", "c", "asks", "set")
    return keep(rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct())


def common_links(hot: DataFrame, links: DataFrame, docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """``links`` and those between documents that share a common token (``token, id, n``).

    A token all of whose documents have the same more common one adds nothing and is left out. The documents of a token
    are cut by size into bands that a link spans two of, and bands by bytes into leaves, so no task sees a whole token.
    Leaves are first searched by themselves, which joins groups of copies; then documents outside a token's largest
    component are sought in all its leaves of neighbouring bands, a chunk of them against a leaf in each task.
    """
    many = hot.groupBy("token").agg(F.count("*").alias("k"))
    best = attach(hot, keep(many), "token").withColumn("best", F.struct("k", "token"))
    first = best.groupBy("id").agg(F.max("best")["token"].alias("first"))
    ends = hot.join(first, "id").groupBy("token").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    rows = hot.join(ends.where("lo = hi and lo != token").select("token"), "token", "left_anti")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    rows = keep(rows.select("token", "id", "n", band.alias("band")).distinct())
    pieces = lambda df, name: df.groupBy("token", "band").agg(F.ceil(F.greatest(F.sum("n") / LEAF, F.count("*") / MEMBERS)).alias(name))
    leaves = keep(pieces(rows, "leaves"))
    sets = keep(shingle_sets(docs, rows.select("id").distinct(), width))
    spread = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    placed = attach(rows, leaves, ["token", "band"]).withColumn("leaf", spread("leaves"))

    def named(links: DataFrame) -> DataFrame:
        label = components(links)
        return placed.join(label, placed["id"] == label["node"], "left").select("token", "band", "leaf", "id", "n", F.coalesce("root", "id").alias("c"))

    cell = F.xxhash64("token", "band", "leaf").alias("cell")
    found = searched(named(links).select(cell, "id", "c", F.lit(None).cast("boolean").alias("asks")), sets, percent, parts)
    links = keep(links.union(found))
    now = keep(named(links))
    sizes = now.groupBy("token", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("token").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "main")
    mixed = attach(now, keep(main), "token")
    asks = mixed.where("c != main").select("token", "id", "n", "c", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    chunks = keep(pieces(asks, "chunks"))
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    asks = attach(attach(asks, leaves, ["token", "band"]), chunks, ["token", "band"]).withColumn("chunk", spread("chunks")).withColumn("leaf", upto("leaves"))
    base = attach(mixed, chunks, ["token", "band"]).withColumn("chunk", upto("chunks"))
    cell = F.xxhash64("token", "band", "leaf", "chunk").alias("cell")
    both = asks.select(cell, "id", "c", F.lit(True).alias("asks")).union(base.select(cell, "id", "c", F.lit(False)))
    return links.union(searched(both, sets, percent, parts))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``: components of documents whose shingle sets are at least ``percent`` % alike.

    1. Sets are hashed; documents with equal sets are one from here on. A sketch of fixed size counts tokens.
    2. Linked sets share a token of their prefixes (rare tokens first), which routes documents to blocks; blocks of the
       same documents are one.
    3. Each block is searched through an R-tree over its count vectors; pairs that the bound allows are verified on whole
       sets, which are shuffled once for all pairs that hang together.
    4. Tokens with too many documents for a block are searched leaf by leaf (``common_links``).
    So a group of copies gives pairs in proportion to its documents, and no link between different sets is lost. Ids may
    have any type that sorts. A null or wordless text has no shingles and is its own component, as is a row with a null
    id (component null); repeated rows share their id's result; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows, names = numbered(docs, id_col, text_col)
    made = keep(summaries(rows, width))
    whole = made.where("block is null").select("id", "n", "k1", "k2", "vec")
    some = whole.where("n > 0 and id is not null")
    classes = keep(some.groupBy("n", "k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    many = classes.where("copies > 1").select("n", "k1", "k2", "first")
    copies = keep(some.select("id", "n", "k1", "k2").join(many, ["n", "k1", "k2"]).where("id != first").select("id", "first").distinct())
    level, total = levels(made.where("block is not null").select("block", "counts"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    single = attach(rows.where("id is not null"), copies.select("id"), "id", "left_anti", 1_000_000)
    sets = attach(some, copies.select("id"), "id", "left_anti", 1_000_000).dropDuplicates(["id"]).select("id", "n", "vec")
    slots = max(parts, -(-total * (100 - percent) // (100 * PART)))
    found = keep(routed(prefixes(single, level, width, percent, slots), slots, percent))
    blocks, hot = found.where("block is not null").select("block", "ids"), found.where("token is not null").select("token", "id", "n")
    links = verified(block_pairs(blocks, sets, percent, parts), sets.select("id", "n"), rows, width, percent, parts)
    if not hot.isEmpty():
        links = common_links(hot, links, rows, width, percent, parts)
    labels = components(links)
    label = copies.join(labels, copies["first"] == labels["node"], "left").select("id", F.coalesce("root", "first").alias("root")).union(labels)
    out = whole.select("id", "n").join(label.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    kind = docs.schema[id_col].dataType
    if names is None:
        return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
    back = lambda c, name: names.select(F.col("number").alias(c), F.col("name").alias(name))
    return out.join(back("id", id_col), "id", "left").join(back("component_id", "_component"), "component_id", "left").select(id_col, "n_shingles", F.col("_component").alias("component_id"))

"""Suffix-array dedup: bytes of long repeated strings, found through sorted suffixes at content-chosen anchors."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import attach, by_bytes, filled, keep, lean, ragged, whole_groups

GRAM = 16
_M1, _M2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


# ---- deep-shallow sorting


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix of strings that agree up to ``at``."""
    top = min(len(a), len(b))
    if a[at:top] == b[at:top]:
        return top
    low = at
    while top - low > 1:
        mid = (low + top) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            top = mid
    return low


class BlindTrie:
    """Orders strings with long common prefixes: inner nodes keep a depth and one child for each next byte.

    A string goes down blindly to some leaf, is compared with that leaf only, and is put in where they part.
    """

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), [i], None]
            return
        node = self.root
        while node[2] is not None:
            node = node[2].get(_byte(s, node[0])) or next(iter(node[2].values()))
        other = self.strings[node[1][0]]
        part = common_prefix(s, other, self.depth)
        if part == len(s) == len(other):
            node[1].append(i)
            return
        node, above, edge = self.root, None, None
        while node[2] is not None and node[0] < part:
            above, edge, node = node, _byte(s, node[0]), node[2][_byte(s, node[0])]
        leaf = [len(s), [i], None]
        if node[2] is not None and node[0] == part:
            node[2][_byte(s, part)] = leaf
            return
        split = [part, [], {_byte(other, part): node, _byte(s, part): leaf}]
        if above is None:
            self.root = split
        else:
            above[2][edge] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings in order, and each one's common prefix with the one before (the first: unknown, -1)."""
        order, shared, todo = [], [], [(self.root, -1)]
        while todo:
            node, before = todo.pop()
            if node[2] is None:
                order += node[1]
                shared += [before] + [node[0]] * (len(node[1]) - 1)
            else:
                kids = [node[2][b] for b in sorted(node[2])]
                todo += [(k, node[0]) for k in reversed(kids[1:])] + [(kids[0], before)]
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of ``strings`` and the common prefix of each with the one before it.

    Multikey quicksort splits them by one byte after another down to ``shallow`` bytes; groups that still agree there
    have long common prefixes and are ordered by blind tries.
    """
    order: list[int] = []
    shared: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)]  # strings that agree up to a depth; the prefix they share with what is before
    while todo:
        group, depth, before = todo.pop()
        if len(group) == 1:
            order += group
            shared.append(before)
        elif depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.insert(i)
            ranked, lcp = trie.walk()
            order += ranked
            shared += [before, *lcp[1:]]
        else:
            keys = [_byte(strings[i], depth) for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, same, more = ([i for i, k in zip(group, keys, strict=True) if ok(k)] for ok in (lambda k: k < pivot, lambda k: k == pivot, lambda k: k > pivot))
            parts, first = [], True
            for part, deeper in ((less, depth), (same, depth + 1 if pivot >= 0 else shallow), (more, depth)):
                if part:
                    parts.append((part, deeper, before if first else depth))
                    first = False
            todo += reversed(parts)
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(texts: list[bytes], anchors: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` bytes of contexts that agree at their anchors occur in another context too.

    ``texts[i]`` holds the windows that start o bytes before the anchor, for o from ``low[i]`` to ``anchors[i]``. Two
    contexts share window o if they agree over o bytes to the left and length - o to the right of the anchor; both
    sides are sorted, and agreement over some depth is a run of large common prefixes.
    """
    m, wide = len(texts), int(anchors.max()) + 1
    depth = np.arange(wide)
    classes = []
    for side, need in (([t[:a][::-1] for t, a in zip(texts, anchors, strict=True)], depth), ([t[a:] for t, a in zip(texts, anchors, strict=True)], length - depth)):
        order, shared = deep_shallow(side)
        ids = np.cumsum(shared[:, None] < need[None, :], axis=0)
        out = np.empty_like(ids)
        out[order] = ids
        classes.append(out)
    code = classes[0] * (m + 1) + classes[1]
    valid = (depth >= low[:, None]) & (depth <= anchors[:, None])
    code = np.where(valid, code, -1 - np.arange(m)[:, None])
    rank = np.argsort(code, axis=0, kind="stable")
    sorted_code = np.take_along_axis(code, rank, axis=0)
    same = sorted_code[1:] == sorted_code[:-1]
    twice = np.zeros(code.shape, bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(code.shape, bool)
    np.put_along_axis(out, rank, twice, axis=0)
    return out & valid


def runs(flags: np.ndarray) -> list[int]:
    """Start and last index of each run of true values, flattened."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [int(x) for a, b in zip(edge[::2], edge[1::2], strict=True) for x in (a, b - 1)]


# ---- anchors


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.r_[np.uint64(1), np.cumprod(np.full(n, b, np.uint64))] for b in (_BASE, _INVERSE))


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _powers(1 << max(20, len(data).bit_length()))
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])]


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of data[a:b] that doesn't depend on a."""
    _, inverse = _powers(1 << max(20, (len(sums) - 1).bit_length()))
    with np.errstate(over="ignore"):
        h = (sums[b] - sums[a]) * inverse[a]
        h = (h ^ (h >> np.uint64(32)) ^ (b - a).astype(np.uint64)) * _M1
        return h ^ (h >> np.uint64(29))


def anchors_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """For texts data[start:start+size]: text number, anchor, and the lowest and highest start of its windows.

    The anchor of a window of ``length`` bytes is the smallest hashed gram among its first ``reach`` positions (the
    first of equals): equal windows have equal anchors, whatever is around them, and neighbouring windows share theirs.
    """
    n = len(data)
    whole = np.concatenate([data, np.zeros(-n % reach + 2 * reach + GRAM, np.uint8)])
    grams = len(whole) - GRAM + 1
    grams -= grams % reach
    words = np.ndarray((len(whole) - 7,), "<u8", whole, 0, (1,))
    with np.errstate(over="ignore"):
        h = words[:grams] * _M1 + words[8 : grams + 8] * _M2
        h ^= h >> np.uint64(31)
        h *= _M2
    h >>= np.uint64(32)
    h <<= np.uint64(32)
    h |= np.arange(grams, dtype=np.uint64)
    blocks = h.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    many = np.maximum(size - length + 1, 0)
    p = ragged(start, many)
    at = (np.minimum(behind[p], ahead[p + reach - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(start)), many)
    first = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])] if len(at) else np.zeros(0, bool)
    cut = np.flatnonzero(first)
    last = np.r_[cut[1:], len(at)] - 1
    return text[cut], at[cut], p[cut], p[last]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each starts and how long it is."""
    texts = filled(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and len(size) else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0] if len(size) else np.zeros(0, np.int64), size


#: Bytes of the shorter strings that are looked for in other texts.
SHARED = 256


def _represented(h: np.ndarray) -> np.ndarray:
    """For each row 0, but for the first of each h the number of its rows."""
    _, first, many = np.unique(h, return_index=True, return_counts=True)
    out = np.zeros(len(h), np.int32)
    out[first] = many
    return out


def anchors(rows: DataFrame, length: int, reach: int, parts: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """``key, pos, lo, hi, h, x, short``: anchors that may be in a repeat, how far before each its windows start, and hashes.

    ``h`` is of the bytes that every window of the anchor holds from it on, ``x`` of all that its windows cover; anchors
    whose h is unique are dropped. ``short`` rows are anchors of windows of SHARED bytes, one for each h of a text, whose
    h is in another text too. A batch sends one row for each h to that h's task, with the number of its rows; the others
    are repeats already and are dealt out anyhow, so a common passage gives a task no more rows than there are batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), filled(batch.column(1))
            for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
                data, start, size = _flat(texts.slice(a, b - a))
                sums = _sums(data)
                text, at, first, last = anchors_of(data, start, size, length, reach)
                h = _hash(sums, at, at + length - reach + 1).view(np.int64)
                cols = [keys[a:b][text], at - start[text], at - first, at - last, h, _hash(sums, first, last + length).view(np.int64), _represented(h), np.zeros(len(h), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "pos", "lo", "hi", "h", "x", "m", "short"])
                text, at, _, _ = anchors_of(data, start, size, SHARED, SHARED // 2)
                h = _hash(sums, at, at + SHARED // 2 + 1).view(np.int64)
                once = np.unique(np.stack([h, text], axis=1), axis=0, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
                text, at, h = text[once], at[once], h[once]
                none = np.zeros(len(h), np.int64)
                cols = [keys[a:b][text], at - start[text], none, none, h, none, _represented(h), np.ones(len(h), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "pos", "lo", "hi", "h", "x", "m", "short"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for table in whole_groups(batches, "h"):
            _, group = np.unique(table.column("h").to_numpy() * 2 + table.column("short").to_numpy(), return_inverse=True)
            m = table.column("m").to_numpy()
            yield from table.filter(pa.array((m == 0) | (np.bincount(group, m)[group] > 1))).drop_columns(["m"]).to_batches()

    made = rows.mapInArrow(run, "key long, pos int, lo int, hi int, h long, x long, m int, short boolean")
    dealt = made.repartition(parts, F.when(F.col("m") > 0, F.col("h")).otherwise(F.xxhash64("key", "pos")))
    return dealt.sortWithinPartitions("h").mapInArrow(again, "key long, pos int, lo int, hi int, h long, x long, short boolean")


def shared_bytes(short: DataFrame) -> DataFrame:
    """``key, n_shared``: the bytes that the cores at ``short`` anchors cover."""
    core = SHARED // 2 + 1
    steps = lambda p: F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(core)))
    spots = short.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return spots.select("key", F.aggregate(steps(F.col("p")), F.lit(core).cast("long"), lambda n, x: n + x).alias("n_shared"))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def _sorted_groups(table: pa.Table, length: int, step: int = 32) -> pa.RecordBatch:
    """The repeated windows of all contexts of some groups (rows sorted by h).

    Windows that start in the same ``step`` bytes before an anchor hold a common core. A context none of whose cores
    occurs in another context of its group has no repeated window; only the others are sorted.
    """
    h, x = table.column("h").to_numpy(), table.column("x").to_numpy()
    lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    texts = table.column("text").to_pylist()
    data, start, _ = _joined(texts)
    n = lo // step - hi // step + 1
    row, block = np.repeat(np.arange(len(h)), n), ragged(hi // step, n)
    begin = start[row] + lo[row] - block * step
    core = _hash(_sums(data), begin, begin + length - step + 1)
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
    _, back, count = np.unique(np.stack([group[row], block, core.view(np.int64)], axis=1), axis=0, return_inverse=True, return_counts=True)
    keep = np.zeros(len(h), bool)
    keep[row[count[back.ravel()] > 1]] = True
    at = np.flatnonzero(keep)
    out: list[list[int]] = []
    took = []
    for part in np.split(at, np.flatnonzero(np.diff(group[at])) + 1) if len(at) else []:
        if len(part) > 1:
            flags = repeated_windows([texts[i] for i in part], lo[part], hi[part], length)
            out += [runs(f) for f in flags]
            took.append(part)
    took = np.concatenate(took) if took else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(h[took]), pa.array(x[took]), pa.array(out, pa.list_(pa.int32()))], ["h", "x", "at"])


def repeats(rows: DataFrame, length: int, reach: int, most: int = 64) -> DataFrame:
    """``key, spans, n_shared``: for each text (``key, t``) the byte intervals that repeated strings of ``length`` bytes cover.

    Anchors whose h is unique cannot be in a repeat. Contexts that are wholly equal are repeats of each other; where a
    group of equal h has different ones, one of each kind is sorted with the others. Groups of over ``most`` kinds are
    dealt out by the hash of every single window instead, which gives the same answer without a large group in a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keep(anchors(rows, length, reach, parts).withColumn("row", F.monotonically_increasing_id()))
    member = found.where(~F.col("short"))
    kinds = keep(member.groupBy("h", "x").agg(F.count("*").alias("n"), F.min("row").alias("row")))
    mixed = keep(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))  # apart, so that Spark may split its join
    one = kinds.join(mixed.hint("merge"), "h").select("row", "kinds")
    one = keep(member.join(one, "row").select("key", "h", "x", "pos", "lo", "hi", "kinds"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for a, b in by_bytes(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False), 4 << 20):
                lists = batch.column(1).slice(a, b - a)
                at, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                texts = [x.encode() for x in batch.column(0).slice(a, b - a).to_pylist()]
                pos, lo, hi = (at.field(k).to_numpy() for k in ("pos", "lo", "hi"))
                some = pa.array([texts[i][p - x : p - y + length] for i, p, x, y in zip(owner, pos, lo, hi, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(at.field(k) for k in ("h", "x", "lo", "hi", "kinds")), some], ["h", "x", "lo", "hi", "kinds", "text"])

    def context(some: DataFrame) -> DataFrame:
        """The bytes around one anchor of each kind; only texts that hold one are shuffled."""
        per = some.groupBy("key").agg(F.collect_list(F.struct("h", "x", "pos", "lo", "hi", "kinds")).alias("at"))
        texts = attach(rows, keep(some.select("key").distinct()), "key", "left_semi", 500_000)
        return texts.join(per.hint("merge"), "key").select("t", "at").mapInArrow(contexts, "h long, x long, lo int, hi int, kinds long, text binary")

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rest = None
        for batch in itertools.chain(batches, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            h = table.column("h").to_numpy()
            end = len(h) if batch is None else int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0  # the last group may go on
            rest = table.slice(end) if batch is not None else None
            for a in range(0, end, 8000):  # a group's rows are together; one that is cut starts the next part
                a, b = int(np.searchsorted(h[:end], h[a])), int(np.searchsorted(h[:end], h[min(a + 8000, end - 1)])) if a + 8000 < end else end
                if a < b:
                    yield _sorted_groups(table.slice(a, b - a), length)

    few = context(one.where(F.col("kinds") <= most)).select("h", "x", "lo", "hi", "text").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(sort_groups, "h long, x long, at array<int>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                h, x, lo, hi = (part.column(c).to_numpy().astype(np.int64) for c in range(4))
                data, start, _ = _joined(part.column(5).to_pylist())
                n = lo - hi + 1
                row, back = np.repeat(np.arange(len(h)), n), ragged(hi, n)
                at = start[row] + lo[row] - back
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[row], x[row], back, _hash(_sums(data), at, at + length).view(np.int64))], ["h", "x", "back", "w"])

    window = context(one.where(F.col("kinds") > most)).mapInArrow(windows, "h long, x long, back long, w long")
    twice = window.groupBy("h", "back", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "back", "w")
    many = window.join(twice.hint("merge"), ["h", "back", "w"]).groupBy("h", "x").agg(F.array_sort(F.collect_list(F.col("back").cast("int"))).alias("b")).select("h", "x", F.flatten(F.transform("b", lambda b: F.array(b, b))).alias("at"))
    partly = keep(few.union(many).where(F.size("at") > 0))
    kind = kinds.where("n > 1").select("h", "x", F.lit(None).cast("array<int>").alias("at"))
    kind = kind.unionByName(partly.join(kind.select("h", "x"), ["h", "x"], "left_anti"))
    cover = member.join(kind.hint("merge"), ["h", "x"]).select("key", "pos", F.coalesce("at", F.array("hi", "lo")).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("at") / 2 - 1).cast("int")), lambda i: F.struct((F.col("pos") - F.get("at", 2 * i + 1)).alias("a"), (F.col("pos") - F.get("at", 2 * i) + length).alias("b")))
    spans = cover.select("key", pairs.alias("s")).groupBy("key").agg(F.flatten(F.collect_list("s")).alias("spans"))
    return spans.join(shared_bytes(found.where("short")), "key", "full")


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs (touching ones join)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes every byte that lies in a string of ``length`` bytes starting anywhere else too; a row per document.

    ``id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared`` and, if asked for, ``kept``: the remaining bytes.
    Strings are judged on the input. ``n_shared`` looks for shorter passages and removes nothing: the bytes of
    129-byte strings at content-chosen places that another row's text holds too, each once a text. Whatever string of
    SHARED bytes two texts share, both have such a place in it. A null text is empty; texts under ``length`` bytes keep all; repeated rows are repeats of each
    other; null ids are fine; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("t"))
    spans = keep(repeats(rows.select("key", "t").where(F.octet_length("t") >= min(length, SHARED)), length, length // 2))
    both = rows.join(spans.hint("merge"), "key", "left").select("id", "t", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for k, stop in by_bytes(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 4 << 20):
                part, out = batch.slice(k, stop - k), []
                for text, s in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    data = text.encode()
                    if not s.is_valid:
                        out.append((len(data), 0, 0, data))
                        continue
                    a, b = merged(*(s.values.field(c).to_numpy().astype(np.int64) for c in ("a", "b")))
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(data)]
                    out.append((len(data), int((b - a).sum()), len(a), b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))))
                n = list(zip(*out, strict=True))
                sha = [hashlib.sha256(x).hexdigest() for x in n[3]]
                cols = [part.column(0), *(pa.array(c, pa.int64()) for c in n[:3]), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, part.column(3), *([pa.array(n[3], pa.binary())] if with_text else [])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", *(["kept"] if with_text else [])])

    return both.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * with_text).withColumnRenamed("id", id_col)

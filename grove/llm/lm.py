"""LM scoring: a causal self-attention model over subword ids, mixed with the corpus's word frequencies."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm import attention
from grove.llm.attention import BRANCH, CLASSES, Learner, Prior
from grove.llm.common import by_bytes, coded, filled, keep, lean, ragged, words
from grove.storage import stored

#: The end of a text has an id that the vocabulary leaves free; START stands before a text.
END, START, IDS = 50256, 65535, 50257
_OTHER_SPACE = re.compile(r"[^\S ]")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (splitmix64), in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: The end of a text as a word: no word starts with its id.
END_KEY = _mixed(np.array([END], np.uint64))[0]


def _ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def starters(name: str) -> np.ndarray:
    """Whether an id starts a word: a blank stands before each word, and nowhere else."""
    out = np.zeros(1 << 16, bool)
    out[[n for x, n in _ranks(name).items() if x[:1] == b" "]] = True
    return out


class Subwords:
    """Ids of words, each with a blank before it; those met last are remembered."""

    def __init__(self, name: str, room: int = 400_000):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(name), special_tokens={}).encode_ordinary
        self.room, self.seen, self.starts = room, {}, starters(name)

    def of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        if len(self.seen) > self.room:
            self.seen = {}
        parts = list(map(self.seen.get, distinct))
        missing = [i for i, x in enumerate(parts) if x is None]
        for i, ids in zip(missing, self._made([distinct[i] for i in missing]), strict=True):
            parts[i] = self.seen[distinct[i]] = ids
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        pool = np.frombuffer(b"".join(parts), np.uint16).astype(np.int64)
        return pool, size

    def _made(self, words: list[str]) -> list[bytes]:
        """Ids of new words: of all at once, as a blank starts a piece, but one by one where they hold other white space."""
        if not words or _OTHER_SPACE.search(" ".join(words)):
            odd = [bool(_OTHER_SPACE.search(x)) for x in words]
            plain = iter(self._made([x for x, o in zip(words, odd, strict=True) if not o]) if not all(odd) else ())
            return [np.array(self.encode(" " + x), np.uint16).tobytes() if o else next(plain) for x, o in zip(words, odd, strict=True)]
        ids = np.array(self.encode(" " + " ".join(words)), np.uint16)
        raw, cut = ids.tobytes(), [*(2 * np.flatnonzero(self.starts[ids])).tolist(), 2 * len(ids)]
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@functools.lru_cache(maxsize=1)
def subwords(name: str) -> Subwords:
    return Subwords(name)


class Ids:
    """The ids of some texts, END after each."""

    def __init__(self, raw: np.ndarray, size: np.ndarray):
        """``raw``: the ids without ends; ``size``: how many each text has, with its end."""
        self.n, self.raw, self.size = len(size), raw, size

    @functools.cached_property
    def ids(self) -> np.ndarray:
        out = np.full(len(self.raw) + self.n, END, np.int64)
        out[np.arange(len(self.raw)) + np.repeat(np.arange(self.n), self.size - 1)] = self.raw
        return out

    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


class Batch(Ids):
    """Words and ids of some texts."""

    def __init__(self, texts: pa.Array, tokenizer: str):
        n = len(texts)
        word, owner = words(pc.ascii_lower(texts))
        code, distinct = coded(word)
        pool, size = subwords(tokenizer).of(distinct.to_numpy(zero_copy_only=False).tolist())
        self.per_word = size[code]
        raw = pool[ragged((np.cumsum(size) - size)[code], self.per_word)]
        super().__init__(raw, np.bincount(owner, self.per_word, n).astype(np.int64) + 1)


class Words:
    """The words that ids spell: where each starts, the text it is in, its code, and the distinct words' keys.

    A word's key is a sum of hashes of its ids with their places; what ids spell is unique to a word.
    """

    def __init__(self, ids: Ids, tokenizer: str):
        raw = ids.raw
        self.start = np.flatnonzero(starters(tokenizer)[raw])
        self.count = np.diff(np.searchsorted(self.start, np.r_[0, np.cumsum(ids.size - 1)]))
        self.owner = np.repeat(np.arange(ids.n), self.count)
        place = np.arange(len(raw)) - np.repeat(self.start, np.diff(np.r_[self.start, len(raw)]))
        each = _mixed((place << 16 | raw).astype(np.uint64))
        self.code, keys = coded(pa.array(np.add.reduceat(each, self.start) if len(self.start) else each))
        self.keys = keys.to_numpy()


def _parts(texts: pa.Array, batch_bytes: int):
    texts = filled(texts)
    return ((a, texts.slice(a, b - a)) for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes))


def _id_parts(column: pa.Array, most: int):
    """A column of ids as ``Ids`` of about ``most`` each, with the row of their first."""
    column = column.cast(pa.large_binary())
    for a, b in by_bytes(pc.binary_length(column).to_numpy(zero_copy_only=False), 2 * most):
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + a : column.offset + b + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u2") if ends[-1] > ends[0] else np.zeros(0, "<u2")
        yield a, Ids(raw.astype(np.int64), np.diff(ends) // 2 + 1)


def encoded(rows: DataFrame, tokenizer: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """``rows`` (texts: ``t``) with ``ids``: the ids of a text's words, two bytes each."""
    names, at = rows.columns, rows.columns.index("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for a, texts in _parts(batch.column(at), batch_bytes):
                b = Batch(texts, tokenizer)
                ends = np.r_[0, np.cumsum(2 * (b.size - 1))]
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.n, [None, pa.py_buffer(ends), pa.py_buffer(b.raw.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b.n) for c in batch.columns), ids.cast(pa.binary())], [*names, "ids"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, ids binary")


def _ids(rows: DataFrame, tokenizer: str) -> DataFrame:
    """The ids of ``rows``, made now where they weren't made before."""
    return (rows if "ids" in rows.columns else encoded(rows.select("t"), tokenizer)).select("ids")


def word_and_id_counts(rows: DataFrame, tokenizer: str, most: int = 1_500_000) -> DataFrame:
    """``kind, key, n, m`` of all texts (``t`` or ``ids``), added up: of words (kind 0) their count, of ids (1) their count
    and how many of them start a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        uses, starts, ends = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        held: list[tuple] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = map(np.concatenate, zip(*held, strict=True))
            key, at = np.unique(key, return_inverse=True)
            return key, np.bincount(at, n).astype(np.int64)

        def out(kind: int, key: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key), pa.array(n), pa.array(m)], ["kind", "key", "n", "m"])

        for batch in batches:
            for _, b in _id_parts(batch.column(0), most):
                w = Words(b, tokenizer)
                uses += np.bincount(b.raw, minlength=1 << 16)
                starts += np.bincount(b.raw[w.start], minlength=1 << 16)
                ends += b.n
                held.append((w.keys.view(np.int64), np.bincount(w.code, minlength=len(w.keys))))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        key, n = held.pop()
                        yield out(0, key, n, np.zeros(len(key), np.int64))
        uses[END] += ends
        starts[END] += ends
        held.append((np.array([END_KEY]).view(np.int64), np.array([ends])))
        key, n = merged()
        yield out(0, key[n > 0], n[n > 0], np.zeros(int((n > 0).sum()), np.int64))
        some = np.flatnonzero(uses)
        yield out(1, some, uses[some], starts[some])

    made = _ids(rows, tokenizer).mapInArrow(run, "kind int, key long, n long, m long")
    return keep(made.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def class_table(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id and the log share of each id in its class.

    The commonest ids have a class of their own, the rest share the last. Ids that start words come first, and commoner
    ones before rarer ones, so that the first choices of the tree say much. What reaches the driver is a row for each
    id of the vocabulary.
    """
    uses, starts = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in ids.collect():
        uses[r["key"]], starts[r["key"]] = r["n"], r["m"]
    rank = uses[:IDS].copy()
    rank[END] = np.inf
    top = np.argsort(-rank, kind="stable")[: CLASSES - 1]
    top = top[np.lexsort((-uses[top], 2 * starts[top] < uses[top]))]
    of = np.full(1 << 16, CLASSES - 1, np.int64)
    of[top] = np.arange(CLASSES - 1)
    of[START] = CLASSES
    rest = uses[:IDS] + 0.5
    rest[top] = 0
    return of, np.log(np.where(rest > 0, rest / rest.sum(), 1.0))


def _packed(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(raw, "<f4"), 0, {}
    like = attention.fresh_weights()
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


#: Entries of a block of a count table, as it is sent.
_BLOCK = 1 << 13


class Counts:
    """Counts of class pairs (see Prior): two tables whose size is fixed by the classes."""

    def __init__(self):
        self.tables = np.zeros((CLASSES + 1, CLASSES // BRANCH), np.int64), np.zeros((CLASSES // BRANCH + 1, CLASSES), np.int64)

    def prior(self) -> Prior:
        return Prior(*(t.astype(np.float64) for t in self.tables))

    def add(self, before: np.ndarray, classes: np.ndarray) -> None:
        for mine, more in zip(self.tables, attention.pair_counts(before, classes), strict=True):
            mine += more

    def blocks(self) -> list[tuple[int, bytes]]:
        flat = np.concatenate([t.ravel() for t in self.tables])
        parts = [(k, flat[k * _BLOCK : (k + 1) * _BLOCK]) for k in range(-(-len(flat) // _BLOCK))]
        return [(k, zlib.compress(x.astype("<i8").tobytes(), 1)) for k, x in parts if x.any()]

    def load(self, blocks: list[tuple[int, bytes]]) -> None:
        flat = np.concatenate([t.ravel() for t in self.tables])
        for k, raw in blocks:
            flat[k * _BLOCK : (k + 1) * _BLOCK] += np.frombuffer(zlib.decompress(raw), "<i8")
        cut = self.tables[0].size
        self.tables = flat[:cut].reshape(self.tables[0].shape), flat[cut:].reshape(self.tables[1].shape)


def _before(b: Ids, classes: np.ndarray) -> np.ndarray:
    out = np.r_[CLASSES, classes[:-1]]
    out[b.start()] = CLASSES
    return out


def learned(rows: DataFrame, tokenizer: str, shared, rate: float | None, most: int = 1_500_000) -> tuple[Counts, bytes | None]:
    """Counts of class pairs of all texts (``t`` or ``ids``), if the shared values ask for them, and, with a ``rate``,
    weights: each task trains on from the shared weights on all windows of its texts, and the results are averaged by
    their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        of, weights, prior, counting = shared.value
        counts, learner, seed = Counts(), Learner(_unpacked(weights), rate) if rate else None, 0
        for batch in batches:
            for _, b in _id_parts(batch.column(0), most):
                classes = of[b.ids]
                if counting:
                    counts.add(_before(b, classes), classes)
                if learner:
                    learner.learn(prior, attention.training_windows(classes, b.size), seed)
                    seed += 1
        out = [(k, 0, x) for k, x in counts.blocks()]
        if learner and learner.windows:
            out.append((-1 - TaskContext.get().partitionId(), learner.windows, _packed(learner.w)))
        k, n, x = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.binary())], ["k", "n", "x"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["x"])
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "x": [zlib.compress(total.tobytes(), 1)]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, "<f4").astype(np.float64) * m for w, m in zip(pdf["x"], pdf["n"], strict=True))
        return pd.DataFrame({"k": pdf["k"].iloc[:1] // 32 - 1, "n": [int(pdf["n"].sum())], "x": [(total / pdf["n"].sum()).astype("<f4").tobytes()]})

    made = keep(_ids(rows, tokenizer).mapInArrow(run, "k long, n long, x binary"))
    counts = Counts()
    counts.load([(r["k"], r["x"]) for r in made.where("k >= 0").groupBy("k").applyInPandas(added, "k long, x binary").collect()])  # the tables' fixed size
    if not rate:
        return counts, None
    some = made.where("k < 0")
    while some.count() > 32:
        some = keep(some.groupBy(F.floor(F.col("k") / 32)).applyInPandas(average, "k long, n long, x binary"))
    some = some.orderBy("k").toPandas()
    return counts, average(some)["x"].iloc[0] if len(some) else None


def trained(rows: DataFrame, of: np.ndarray, tokenizer: str, rates: tuple[float, float] = (0.01, 0.005)) -> tuple[Prior, dict[str, np.ndarray]]:
    """The prior and the weights, from all windows of all texts (``half``, ``t`` and, where they are made already, ``ids``).

    The texts of each half are trained on once, on top of the pair counts of the other half, so that the weights don't
    come to trust counts that hold their own text; the final prior has the counts of both.
    """
    share = rows.sparkSession.sparkContext.broadcast
    weights = _packed(attention.fresh_weights())
    halves = [rows.where(F.col("half") == i).drop("half") for i in range(2)]
    known, _ = learned(halves[0], tokenizer, share((of, weights, None, True)), None)
    other, new = learned(halves[1], tokenizer, share((of, weights, known.prior(), True)), rates[0])
    weights = new or weights
    _, new = learned(halves[0], tokenizer, share((of, weights, other.prior(), False)), rates[1])
    for mine, more in zip(known.tables, other.tables, strict=True):
        mine += more
    return known.prior(), _unpacked(new or weights)


_PARTIAL = "n_tokens long, n_known long, n_rare long, base double, mixed double, attention_score double, rest array<struct<key:bigint,att:double>>"


def lm_scores(docs: DataFrame, held_out: tuple[int, int] = (7, 2), unigram: float = 0.5, most_words: int = 1_000_000, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score, n_rare`` of whole texts.

    Texts whose crc32(id) mod ``held_out[0]`` is not ``held_out[1]`` are learned from: all of them for word counts, for
    the chances of a class of ids after another, and every window of them for the attention weights. A word's chance is
    ``unigram`` times its smoothed frequency plus the rest times the attention model's chance of its subwords; ``score``
    is the log10 of their product with the end, ``attention_score`` that of the attention model alone, and ``n_rare``
    counts tokens that the training texts hold at most once. The commonest words, ``most_words`` at most, are broadcast
    with their counts; what other words add is joined by word, a row for each of their occurrences. A null text is empty
    and scores its end; null ids are learned from; repeated rows are scored each; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    mod, rest = held_out
    kind = docs.schema[id_col].dataType.simpleString()
    code = F.crc32(F.col(id_col).cast("string"))
    half = F.shiftright(F.coalesce(code, F.crc32(F.coalesce(text_col, F.lit("")))), 8) % 2
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(code % mod == rest, F.lit(False)).alias("held"), half.alias("half"), F.col(text_col).alias("t"))
    rows = stored(encoded(rows, tokenizer))  # words are cut and looked up once, later steps read the ids
    learn = rows.where(~F.col("held")).select("half", "t", "ids")
    made = word_and_id_counts(learn, tokenizer)
    counts = made.where("kind = 0").select("key", "n")
    of, share = class_table(made.where("kind = 1"))
    prior, weights = trained(learn, of, tokenizer)
    step = F.floor(F.log2(F.col("n").cast("double")) + 1e-9)
    many = {r["k"]: r["w"] for r in counts.groupBy(step.alias("k")).agg(F.count("*").alias("w")).collect()}
    n_words, n_train = sum(many.values()), counts.agg(F.sum("n")).first()[0] or 0
    least = next((k for k in range(64) if sum(w for j, w in many.items() if j >= k) <= most_words), 64)
    common = counts.where(F.col("n") >= (1 << least)).toArrow()  # at most ``most_words`` rows
    key, n = (common.column(c).combine_chunks().to_numpy() for c in ("key", "n"))
    order = np.argsort(key.view(np.uint64))
    total, whole = n_train + n_words + 1.0, least == 0
    shared = spark.sparkContext.broadcast((key.view(np.uint64)[order], n[order].astype(np.int64), of, share, prior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        keys, times, of, share, prior, w = shared.value

        def found(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Counts of words, and whether they are known here."""
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            hit = keys[at] == k if len(keys) else np.zeros(len(k), bool)
            return np.where(hit, times[at] if len(keys) else 0, 0), hit | whole

        log10 = np.log(10)
        mix = lambda u, v: np.logaddexp((np.log(unigram) if unigram else -np.inf) + u * log10, np.log1p(-unigram) + v * log10) / log10
        for batch in batches:
            for a, b in _id_parts(batch.column(2), 800_000):
                x = Words(b, tokenizer)
                distinct = np.append(x.keys, END_KEY)
                known, here = found(distinct)
                uni = np.log10((known + 1) / total)
                each = attention.log_likelihoods(w, prior, of[b.ids], b.size) + share[b.ids]
                last = b.start() + b.size - 1
                att = np.concatenate([np.add.reduceat(np.delete(each, last), x.start) if len(x.start) else np.zeros(0), each[last]]) / log10
                word, owner = np.append(x.code, np.full(b.n, len(x.keys))), np.append(x.owner, np.arange(b.n))  # the ends last
                sure = here[word]
                sums = lambda v: np.bincount(owner, np.where(sure, v, 0), b.n)  # noqa: B023, E731
                open_, by = np.flatnonzero(~sure), np.argsort(owner[~sure], kind="stable")
                open_ = open_[by]
                pairs = pa.StructArray.from_arrays([pa.array(distinct.view(np.int64)[word[open_]]), pa.array(att[open_])], ["key", "att"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[open_], minlength=b.n))], pa.int32()), pairs)
                cols = [pa.array(x.count + 1), pa.array(sums(known[word] > 0).astype(np.int64)), pa.array(sums(known[word] < 2).astype(np.int64)), pa.array(sums(uni[word])), pa.array(sums(mix(uni[word], att))), pa.array(np.bincount(owner, att, b.n)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b.n), batch.column(1).slice(a, b.n), *cols], ["id", "held", "n_tokens", "n_known", "n_rare", "base", "mixed", "attention_score", "rest"])

    out = rows.select("id", "held", "ids").mapInArrow(run, f"id {kind}, held boolean, {_PARTIAL}")
    if not whole:
        out = keep(out).withColumn("row", F.monotonically_increasing_id())
        each = out.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.att").join(counts.hint("merge"), "key", "left")
        n = F.coalesce("n", F.lit(0))
        uni = F.log10((n + 1) / F.lit(total))
        mixed = F.log10(unigram * F.pow(F.lit(10.0), uni) + (1 - unigram) * F.pow(F.lit(10.0), F.col("att")))
        more = each.groupBy("row").agg(F.sum(uni).alias("_base"), F.sum(mixed).alias("_mixed"), F.count_if(n > 0).alias("_known"), F.count_if(n < 2).alias("_rare"))
        out = out.drop("rest").join(more.hint("merge"), "row", "left")
        out = out.withColumns({c: F.col(c) + F.coalesce(F.col(d), F.lit(0)) for c, d in (("base", "_base"), ("mixed", "_mixed"), ("n_known", "_known"), ("n_rare", "_rare"))})
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("mixed").alias("score"), "attention_score", "n_rare")

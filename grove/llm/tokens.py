"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import by_bytes, coded, filled, ragged

#: White space as the tokenizers' patterns have it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = pa.scalar("", pa.large_string())
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SAFE = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
_RUNS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


def segments(text: str, limit: int) -> list[str]:
    """Cuts a long text where white space follows something else: no token of the pattern spans such a place."""
    out, at = [], 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit - 1)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


class WordCounter:
    """Counts the tokens of a pre-token run; remembers up to ``room`` of them from batch to batch."""

    def __init__(self, name: str, room: int = 1_000_000):
        if name.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            self.whole, self.encode = True, lambda xs: [len(x) for x in piece.encode(xs, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            bpe = Tokenizer.from_file(public_tokenizers.path(name))
            bpe.no_truncation()
            bpe.no_padding()
            self.whole, self.encode = False, lambda xs: [len(x) for x in bpe.encode_batch_fast(xs, add_special_tokens=False)]
        self.seen: dict[str, int] = {}
        self.room = room

    def of(self, values: list[str]) -> np.ndarray:
        new = [x for x in values if x not in self.seen]
        if len(self.seen) + len(new) > self.room:
            self.seen, new = {}, values
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.seen.update(zip(part, self.encode(part), strict=True))
        return np.fromiter(map(self.seen.__getitem__, values), np.int64, len(values))


@functools.lru_cache(maxsize=2)
def counter(name: str) -> WordCounter:
    return WordCounter(name)


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before white space that follows something else; concatenated, the chunks are the text."""
    odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    # single white space everywhere: a line after the first starts with its line feed, a word after the first with its blank
    lines = pc.split_pattern(texts.take(pa.array(plain)), "\n")
    line, line_of = lines.flatten(), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    later = np.r_[False, line_of[1:] == line_of[:-1]] if len(line_of) else np.zeros(0, bool)
    line = pc.binary_join_element_wise(pa.array(np.where(later, "\n", ""), pa.large_string()), line.cast(pa.large_string()), _NONE)
    parts = pc.split_pattern(line, " ")
    part, part_of = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    later = np.r_[False, part_of[1:] == part_of[:-1]] if len(part_of) else np.zeros(0, bool)
    part = pc.binary_join_element_wise(pa.array(np.where(later, " ", ""), pa.large_string()), part.cast(pa.large_string()), _NONE)
    owner = plain[line_of[part_of]]
    rest = [(i, _CHUNK.findall(texts[int(i)].as_py())) for i in np.flatnonzero(odd)]
    if rest:
        part = pa.concat_arrays([part, pa.array([x for _, xs in rest for x in xs], pa.large_string())])
        owner = np.concatenate([owner, *(np.full(len(xs), i) for i, xs in rest)])
    return part, owner


def count_batch(texts: pa.Array, name: str, batch_bytes: int, segment_chars: int) -> np.ndarray:
    """The tokens of each text of an Arrow batch."""
    texts, count = filled(texts), counter(name)
    total, sizes = np.zeros(len(texts), np.int64), pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if count.whole:
        for a, b in by_bytes(sizes, batch_bytes):
            total[a:b] = count.encode(texts.slice(a, b - a).to_pylist())
        return total
    long = np.flatnonzero(sizes > segment_chars)
    owner = np.arange(len(texts))
    if len(long):
        cut = [(i, s) for i in long for s in segments(texts[int(i)].as_py(), segment_chars)]
        short = np.flatnonzero(sizes <= segment_chars)
        texts = pa.concat_arrays([texts.take(pa.array(short)), pa.array([s for _, s in cut], pa.large_string())])
        owner = np.concatenate([short, [i for i, _ in cut]]).astype(np.int64)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for a, b in by_bytes(sizes, batch_bytes):
        chunk, of = _chunks(texts.slice(a, b - a))
        code, distinct = coded(chunk)
        total += np.bincount(owner[a + of], count.of(distinct.to_pylist())[code], len(total)).astype(np.int64)
    return total


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, batch_bytes: int = 8 << 20, segment_chars: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: ``doc_id, n_bytes, n_tokens, over_limit``.

    One pass without a shuffle. Batches hold about ``batch_bytes`` bytes, texts over ``segment_chars`` are cut at
    safe boundaries, and a run that occurs often in a batch is encoded once. A null text counts as empty (0 tokens);
    repeated rows and null ids are counted row by row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_batch(batch.column(2), tokenizer, batch_bytes, segment_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


class WordIds:
    """Token ids of words; ``room`` stems are remembered from batch to batch.

    The tokenizer's pattern separates letters from what follows them, so a word of letters and common end marks is a
    stem and a tail. Stems are encoded many at a time as one text: each is one run of the pattern, whose last token ends
    a word, and if the ends don't add up (a letter that decomposes, say), they are encoded one by one like other words.
    """

    def __init__(self, name: str, room: int = 400_000):
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(public_tokenizers.path(name))
        self.bpe.no_truncation()
        self.bpe.no_padding()
        vocabulary = self.bpe.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.room = room
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _encoded(self, xs: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        if joined:
            flat = np.array(self.bpe.encode_batch_fast([" ".join(xs)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[flat])
            if len(ends) == len(xs) and ends[-1] == len(flat) - 1:
                return flat, np.diff(np.r_[-1, ends])
        ids = [x.ids for x in self.bpe.encode_batch_fast(xs, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _known(self, values: pa.Array, joined: bool) -> np.ndarray:
        """Numbers of the words in the pool; new ones are encoded."""
        values = values.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in values if x not in self.seen]
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            flat, n = self._encoded(part, joined)
            k = len(self.seen)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while k + len(part) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.pool[self.used : self.used + len(flat)] = flat
            self.starts[k : k + len(part)] = self.used + np.cumsum(n) - n
            self.lengths[k : k + len(part)] = n
            self.seen.update(zip(part, range(k, k + len(part)), strict=True))
            self.used += len(flat)
        return np.fromiter(map(self.seen.__getitem__, values), np.int64, len(values))

    def of(self, code: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        if len(self.seen) > self.room:
            self.forget()
        halves = pc.extract_regex(distinct, r"^(?P<stem>\p{L}+)(?P<tail>[.,;:!?]*)$")
        plain = pc.is_valid(halves)
        halves, plain = halves.filter(plain), plain.to_numpy(zero_copy_only=False)
        stem, tail = halves.field("stem"), halves.field("tail")
        stem = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem)  # elsewhere lower case may compose otherwise
        pieces = np.zeros((len(distinct), 2), np.int64)
        for column, values, joined in ((0, stem, True), (1, tail, False)):
            at, kinds = coded(values)
            pieces[plain, column] = self._known(kinds, joined)[at]
        pieces[~plain, 0] = self._known(distinct.filter(pa.array(~plain)), False)
        pieces[~plain, 1] = self._known(pa.array([""], distinct.type), False)
        starts, n = self.starts[pieces], self.lengths[pieces].astype(np.int64)
        pool = self.pool[ragged(starts.ravel(), n.ravel())]
        n = n.sum(axis=1)
        starts = np.cumsum(n) - n
        return pool[ragged(starts[code], n[code])], n[code]


@functools.lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    return WordIds(name)

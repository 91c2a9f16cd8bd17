"""Packing: sum-of-squares online packing of token documents into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import by_bytes, coded, filled, lean, words
from grove.llm.tokens import word_ids

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Places each piece on the fill level that leaves the smallest sum of squared counts of partly filled windows.

    ``level[h]`` counts the open windows with h tokens; placing a piece of s tokens on level h (0: a new window) moves
    one window from h to h + s, which changes the sum by 2 * level[h + s] + 1 (unless that fills it) and by
    1 - 2 * level[h] (unless h is 0). Ties go to the fullest window. A piece stays where it is placed, but for those in
    the emptiest windows at the end (or when ``most_open`` windows are open, which bounds memory): they are cut to fill
    up the fuller ones, and the last remainder becomes windows whose sizes are powers of two, so there is no padding.
    ``moved`` counts the tokens of such pieces.
    """

    def __init__(self, size: int, first_id: int, most_open: int = 8192):
        self.size, self.next_id, self.most_open, self.moved = size, first_id, most_open, 0
        self.level, self.open, self.n_open = [0] * (size + 1), {}, 0
        self.onto, self.off = np.ones(size + 1, np.int64), np.full(size + 1, 1 << 60)  # what a window more or less on a level changes
        self.onto[size] = self.off[0] = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        """``ids``: little-endian numbers of 32 bits."""
        whole = len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            self._close([(doc, a, ids[a : a + self.size], len(ids))])
        if whole < len(ids):
            self._place((doc, whole, ids[whole:].copy(), len(ids)))  # not a view, which would keep the whole batch

    def _count(self, h: int, more: int) -> None:
        self.level[h] = n = self.level[h] + more
        self.onto[h], self.off[h] = 2 * n + 1, 1 - 2 * n if n else 1 << 60

    def _place(self, piece: tuple) -> None:
        s = len(piece[2])
        top = self.size - s
        h = top - int((self.onto[s:] + self.off[: top + 1])[::-1].argmin())
        window = []
        if h:
            window = self.open[h].pop()
            self._count(h, -1)
        else:
            self.n_open += 1
        window.append(piece)
        if h + s == self.size:
            self._close(window)
            self.n_open -= 1
        else:
            self._count(h + s, 1)
            self.open.setdefault(h + s, []).append(window)
            if self.n_open >= self.most_open:
                self.finish()

    def finish(self) -> None:
        """Closes all windows: the fullest are filled up with pieces of the emptiest, the rest has powers of two as sizes."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.level, self.open, self.n_open = [0] * (self.size + 1), {}, 0
        self.onto[: self.size], self.off[1:] = 1, 1 << 60
        loose: list[tuple] = []

        def taken(room: int) -> list[tuple]:
            out = []
            while room and loose:
                doc, start, ids, total = loose.pop()
                n = min(room, len(ids))
                out.append((doc, start, ids[:n], total))
                if n < len(ids):
                    loose.append((doc, start + n, ids[n:], total))
                room -= n
                self.moved += n
            return out

        held = [sum(len(p[2]) for p in w) for w in windows]
        k, spare = 0, 0
        while k < len(windows):
            while spare < self.size - held[k] and len(windows) > k + 1:
                loose[:0] = windows.pop()[::-1]
                spare += held.pop()
            room = self.size - held[k]
            if spare < room:  # the last one, which nothing is left to fill up
                break
            self._close(windows[k] + taken(room))
            spare -= room
            k += 1
        loose[:0] = [p for w in windows[k:] for p in w][::-1]
        left = sum(len(p[2]) for p in loose)
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1 and self.size >> bit:
                self._close(taken(1 << bit))
            elif left >> bit & 1:
                for _ in range((1 << bit) // self.size):
                    self._close(taken(self.size))


def pack(docs: DataFrame, size: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, batch_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into windows of at most ``size`` tokens; a row for each piece.

    A document is its words' ids (the tokenizer drops white space, so words are encoded one by one), then ``end_id``.
    Every task packs its own rows, so nothing is shuffled; a task leaves no padding, as its last remainder goes to
    windows of 1, 2, 4, ... tokens. A null or empty text is the end id alone; repeated rows are packed each; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 40)
        kinds = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.done, strict=True)) or [[]] * 7
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kinds), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kinds = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), filled(batch.column(1))
            for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
                word, owner = words(texts.slice(a, b - a))
                ids, n = word_ids(tokenizer).of(*coded(word))
                cuts = np.cumsum(np.bincount(owner, n, b - a).astype(np.int64))
                ids = np.insert(ids, cuts, end_id).astype("<u4")
                for key, end, first in zip(keys[a:b], (cuts + np.arange(1, len(cuts) + 1)).tolist(), (np.r_[0, cuts[:-1]] + np.arange(len(cuts))).tolist(), strict=True):
                    packer.add(key, ids[first:end])
                yield out()
        packer.finish()
        if packer.done:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)

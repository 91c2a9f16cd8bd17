"""Spelling variants: words one edit apart, found by a rare-first prefix filter on positional bigrams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import attach, by_bytes, coded, filled, keep, lean, ragged, whole_groups, words

#: Letters of words: A-Z and a-z, and U+00C0 to U+00FF, which in UTF-8 are 0xC3 and another byte.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[0xC3] = 0xC3
#: Words of over WIDE code points are compared one pair at a time, others in matrices.
WIDE = 64


def _zero_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_STEP = _zero_steps()


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of letters, A-Z in lower case, and for each the row it came from."""
    texts = filled(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    out = _LETTERS[data]
    after = np.flatnonzero(data == 0xC3) + 1
    out[after] = data[after]
    return words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).copy()), pa.py_buffer(out)))


def checksums(names: list[str], owner: np.ndarray, code: np.ndarray, distinct: list[str]) -> np.ndarray:
    """crc32 of ``<name>:<run>`` for every occurrence, put together from the checksums of names and of distinct runs."""
    raw = [w.encode() for w in distinct]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    start = np.fromiter((zlib.crc32(f"{n}:".encode()) for n in names), np.uint32, len(names))
    most = int(min(size.max(initial=0), 4 * WIDE))
    moved = np.empty((most + 1, len(names)), np.uint32)  # a name's checksum followed by so many zero bytes
    moved[0] = start
    for k in range(most):
        moved[k + 1] = (moved[k] >> np.uint32(8)) ^ _STEP[moved[k] & np.uint32(255)]
    out = moved[np.minimum(size, most)[code], owner] ^ own[code]
    for at in np.flatnonzero(size[code] > most):
        out[at] = zlib.crc32(raw[code[at]], int(start[owner[at]]))
    return out


def counted(batches: Iterator[pa.RecordBatch], every: int, least: int, batch_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``word, n``: words of at least ``least`` code points in some texts, after the deletions that checksums call for."""
    lean()
    for batch in batches:
        texts = filled(batch.column(1))
        for a, b in by_bytes(pc.binary_length(texts).to_numpy(zero_copy_only=False), batch_bytes):
            flat, owner = runs(texts.slice(a, b - a))
            code, distinct = coded(flat)
            names, kinds = ["" if x is None else str(x) for x in batch.column(0).slice(a, b - a).to_pylist()], distinct.to_pylist()
            seen, odd = np.bincount(code, minlength=len(kinds)), Counter()
            if every:
                h = checksums(names, owner, code, kinds)
                hit = np.flatnonzero(h % np.uint32(every) == 0)
                seen -= np.bincount(code[hit], minlength=len(kinds))
                for c, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
                    w = kinds[c]
                    odd[w[: x % len(w)] + w[x % len(w) + 1 :]] += 1
            long = np.flatnonzero((seen > 0) & (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) >= least))
            yield pa.RecordBatch.from_arrays([distinct.take(pa.array(long)).cast(pa.string()), pa.array(seen[long].astype(np.int64))], ["word", "n"])
            more = {w: n for w, n in odd.items() if len(w) >= least}
            yield pa.RecordBatch.from_arrays([pa.array(list(more), pa.string()), pa.array(list(more.values()), pa.int64())], ["word", "n"])


def rarest(word: str, rank: dict[str, int]) -> list[int]:
    """Where the three rarest bigrams of a word are; of the third one's occurrences the first and the last.

    An edit touches two neighbouring bigrams at most, so of any three one is left. Words that are one edit apart have
    a bigram in common among these, wholly before or wholly after the edit: if the commoner of both third bigrams is
    the other word's, all occurrences of this one's are taken there; if both are the same, its first occurrence is the
    first in both words or its last one the last in both.
    """
    grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    if len(grams) < 3:
        return [i for _, i in grams]
    third = grams[2][0]
    same = [i for r, i in grams if r == third]
    return [*(i for r, i in grams[:2] if r < third), *sorted({same[0], same[-1]})]


def routes(word: str, rank: dict[str, int]) -> Iterator[tuple[int, bool]]:
    """Keys under which a word meets the words one edit away, and whether it is the longer one there.

    A common bigram before the edit leaves everything up to it equal, one after the edit everything from it on. Of the
    other side, cut in the middle of the shorter word's part, one half is equal too.
    """
    for p in rarest(word, rank):
        for side, common, free in (("a", word[: p + 2], word[p + 2 :]), ("b", word[p:], word[:p])):
            for longer in (False, True) if free else (False,):
                m = len(free) - longer
                cut = m // 2
                yield xxhash.xxh3_64_intdigest(f"{side}{m}<{common} {free[:cut]}") - (1 << 63), longer
                yield xxhash.xxh3_64_intdigest(f"{side}{m}>{common} {free[cut + longer:]}") - (1 << 63), longer


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns one text into the other."""
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def near(text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``one_edit`` for many pairs of at most WIDE + 1 code points each; the second one is as long as the first or longer by one."""
    codes = np.zeros((len(text), text.dtype.itemsize // 4 + 2), np.uint32)
    codes[:, :-2] = np.ascontiguousarray(text).view(np.uint32).reshape(len(text), -1)
    size = (codes > 0).sum(axis=1)
    x, y = codes[i], codes[j]
    differs = x != y
    first = np.argmax(differs, axis=1)
    shifted = ((x[:, :-1] == y[:, 1:]) | (np.arange(x.shape[1] - 1) < first[:, None])).all(axis=1)
    more = size[j] - size[i]
    return ((more == 0) & (differs.sum(axis=1) == 1)) | ((more == 1) & shifted)


def linked(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """``a, b, na, nb``: pairs of words one edit apart that meet under a key; a word may meet another one under several."""
    lean()
    for table in whole_groups(batches, "key"):
        key = table["key"].to_numpy()
        stop = np.searchsorted(key, key, side="right")  # the shorter words of a key come first
        ahead = np.where(table["longer"].to_numpy(zero_copy_only=False), 0, stop - np.arange(len(key)) - 1)
        if not ahead.any():
            continue
        n, names = table["n"].to_numpy(), table["word"].to_pylist()
        brief = np.fromiter((len(w) <= WIDE for w in names), bool, len(names))
        text = np.array([w if s else "" for w, s in zip(names, brief, strict=True)])
        starts = np.flatnonzero(ahead)
        for a, b in by_bytes(ahead[starts], most):
            own = starts[a:b]
            i, j = np.repeat(own, ahead[own]), ragged(own + 1, ahead[own])
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            ok = np.zeros(len(i), bool)
            easy = brief[i]
            fits = easy & brief[j]
            ok[fits] = near(text[used], at[: len(i)][fits], at[len(i) :][fits])
            for t in np.flatnonzero(~fits):
                ok[t] = one_edit(names[i[t]], names[j[t]])
            i, j = i[ok].tolist(), j[ok].tolist()
            i, j = [x if names[x] < names[y] else y for x, y in zip(i, j, strict=True)], [y if names[x] < names[y] else x for x, y in zip(i, j, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i], pa.string()), pa.array([names[x] for x in j], pa.string()), pa.array(n[i], pa.int64()), pa.array(n[j], pa.int64())], ["a", "b", "na", "nb"])


def links(vocabulary: DataFrame) -> DataFrame:
    """``a, b, na, nb``: every pair of words (``word, n``) that are one edit apart, once, with a before b."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                seen.update(w[i : i + 2] for i in range(len(w) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    # Two letters of an alphabet of 90: 8,100 bigrams at most.
    order = vocabulary.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram")
    rank = vocabulary.sparkSession.sparkContext.broadcast({r["gram"]: i for i, r in enumerate(order.collect())})

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                found = [list(routes(w, rank.value)) for w in part.column("word").to_pylist()]
                back = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat], pa.int64()), pa.array([s for _, s in flat], pa.bool_()), part.column("word").take(back), part.column("n").take(back)], ["key", "longer", "word", "n"])

    keys = vocabulary.select("word", "n").mapInArrow(routed, "key long, longer boolean, word string, n long")
    met = keys.repartition(F.col("key")).sortWithinPartitions("key", "longer")
    return met.mapInArrow(linked, "a string, b string, na long, nb long").distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, times: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each distinct word of ``least`` code points that occurs ``times`` times or more.

    Words are maximal runs of letters with A-Z lower-cased; a run loses the code point at h % length where ``every``
    divides h, the crc32 of ``<id>:<run>`` (0: never). A form is the near word (exactly one inserted, deleted or replaced
    code point) of the largest n (of equals the smallest word) if that is ``ratio`` times the word's n or more; a root is
    where forms end. A null text has no words; a null id counts as an empty one; repeated rows count again; an empty
    table gives an empty result; other columns are ignored. Long texts are read whole.

    Words, not their occurrences, are compared. Every word meets others under 8 keys for each of its at most four rarest
    bigrams, so a common affix alone brings nobody together, and only true links leave a task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = rows.mapInArrow(lambda b: counted(b, every, least), "word string, n long")
    vocabulary = keep(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times))
    each = links(vocabulary)
    both = each.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    strong = -F.col("x")["m"] >= ratio * F.col("n")
    best = keep(best.select("word", "n_near", F.when(strong, F.col("x")["other"]).alias("form"), F.when(strong, -F.col("x")["m"]).alias("form_n")))
    out = vocabulary.join(best, "word", "left").join(roots(best.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form: pointers jump, so a chain needs as many rounds as its length has binary digits."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep(attach(at, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at

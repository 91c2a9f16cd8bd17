"""Each stage of the corpus pipeline on odd rows, and the whole of it against brute-force versions of its decisions."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from grove.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def row(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text), "mine")


ROWS = [
    row(1, words(40, 1)), row(2, words(40, 2)), row(2, words(40, 3)), row(None, words(40, 4)), row(None, "a b"), row(3, "a b c"), row(3, words(40, 5)), row(4, None), row(5, ""),
    row(6, words(40, 6)), row(6, words(40, 6)), row(7, words(400, 7)), row(8, words(400, 7) + " end"), row(None, words(400, 7) + " other"), row(9, words(30, 9) + " a.b@c.org", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_quality_stage(spark, docs):
    got = corpus_pipeline.quality(spark, docs, "")
    want = [r for r in ROWS if len((r[1] or "").split()) >= 10]
    assert texts(got) == sorted((str(r[0]), r[1]) for r in want) and got.columns == docs.columns
    assert corpus_pipeline.quality(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage(spark, docs):
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    left = texts(got)
    alike = [t for t in left if t[1].startswith(words(400, 7))]
    alone = sorted({(str(r[0]), r[1] or "") for r in ROWS if not (r[1] or "").startswith(words(400, 7))})
    assert len(alike) == 1 and [t for t in left if t not in alike] == alone and got.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_private_stage(spark, docs):
    got = corpus_pipeline.private(spark, docs, "")
    assert texts(got) == sorted((str(r[0]), (r[1] or "").replace("a.b@c.org", "<EMAIL>")) for r in ROWS)
    assert {r["spans"] for r in got.collect()} == {"mine"} and got.columns == docs.columns
    assert corpus_pipeline.private(spark, docs.limit(0), "").count() == 0


def test_mixing_stage(spark, docs):
    got = corpus_pipeline.mixing(spark, docs, "")
    count = {}
    for t in texts(got):
        count[t] = count.get(t, 0) + 1
    there = {}
    for r in ROWS:
        there[str(r[0]), r[1] or ""] = there.get((str(r[0]), r[1] or ""), 0) + 1
    assert all(n <= 3 * there[t] for t, n in count.items()) and got.columns == docs.columns
    taken = sum(n * len(t[1].split()) for t, n in count.items())
    assert abs(taken - sum(len((r[1] or "").split()) for r in ROWS)) < 400
    assert corpus_pipeline.mixing(spark, docs.limit(0), "").count() == 0


def test_packing_stage(spark, docs):
    got = corpus_pipeline.packing(spark, docs, "").collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in got) == sum(len(bpe.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0


def test_the_whole_pipeline(spark, tmp_path):
    """Rules, one of each group of alike texts, masks and copies by plain loops; then every id is in one piece."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        text = words(r.randrange(12, 120), 100 + i)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 6 == 0:
            rows.append((1000 + i, text + " tail", "en", f"s{i % 3}", len(text) + 5))
        if i % 10 == 0:
            rows.append((2000 + i, "too short", "en", "s0", 9))
        if i % 12 == 0:
            text = words(60, 300 + i) + f" x{i}@mail.org"
            rows.append((3000 + i, text, "en", "s1", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {i: re.sub(r"x[0-9]+@mail\.org", "<EMAIL>", t) for i, t, *_ in rows}
    groups = {i: {i, 1000 + i} if i % 6 == 0 else {i} for i in range(60)} | {i: {i} for i in text if i >= 3000}
    ids = {i: np.array([*bpe.encode(text[i], add_special_tokens=False).ids, 1], "<u4") for i in text}
    taken = {}
    for p in got:
        whole = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(whole) and p["ids_crc32"] == zlib.crc32(whole[p["start"] : p["start"] + p["length"]].tobytes())
        taken[p["doc_id"]] = taken.get(p["doc_id"], 0) + p["length"]
    copies = {i: n / len(ids[i]) for i, n in taken.items()}
    assert all(c in (1, 2, 3) for c in copies.values())
    assert all(sum(i in copies for i in g) <= 1 for g in groups.values()) and not any(2000 <= i < 3000 for i in copies)
    stats = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(stats[i] == (not 2000 <= i < 3000) for i in text)
    size = {s: 0 for s in ("s0", "s1", "s2")}
    source = {i: s for i, _, _, s, _ in rows}
    for i, c in copies.items():
        size[source[i]] += c * len(text[i].split())
    total = sum(len(text[min(g)].split()) for g in groups.values())
    assert abs(sum(size.values()) - total) < 0.1 * total and size["s0"] > size["s1"] > size["s2"]

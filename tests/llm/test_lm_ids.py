"""What op1 makes once: ids of texts, the words that ids spell, projections of classes, exponents that need no clipping."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grove.llm import attention, lm
from grove.llm.attention import CLASSES, CONTEXT, WINDOW

NAME = "byte_bpe_50k.tiktoken"
TEXTS = ["", "Ab aB ab\n\x0bc", "a   b x　", " x 's 't it's", "<|endoftext|> é  ", "12 a1b2 ___ " * 50, None, "zq" * 300]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("texts", [TEXTS, [x for x in TEXTS if not x or not re.search(r"[  　]", x)]])
def test_words_made_at_once_have_the_ids_of_each(texts):
    coder = lm.Subwords(NAME)
    distinct = list(dict.fromkeys(x for t in texts for x in split(t)))
    for _ in range(2):  # the second time remembered
        pool, size = coder.of(distinct)
        assert pool.tolist() == [i for x in distinct for i in coder.encode(" " + x)]
        assert size.tolist() == [len(coder.encode(" " + x)) for x in distinct]


def test_ids_spell_the_words():
    b = lm.Batch(lm.filled(pa.array(TEXTS)), NAME)
    w, plain = lm.Words(b, NAME), [split(t) for t in TEXTS]
    assert w.count.tolist() == [len(x) for x in plain] and w.owner.tolist() == [i for i, x in enumerate(plain) for _ in x]
    flat = [x for t in plain for x in t]
    assert sorted(np.bincount(w.code)) == sorted(Counter(flat).values()) and len(set(w.keys.tolist())) == len(set(flat))
    assert all((w.code[i] == w.code[j]) == (x == y) for i, x in enumerate(flat) for j, y in enumerate(flat))
    assert np.diff(np.r_[w.start, len(b.raw)]).tolist() == b.per_word.tolist()


def test_stored_ids_come_back_in_parts():
    b = lm.Batch(lm.filled(pa.array(TEXTS)), NAME)
    ends = np.r_[0, np.cumsum(b.size - 1)]
    column = pa.array([b.raw[i:j].astype("<u2").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    for most in (1, 40, 10_000):
        parts = list(lm._id_parts(column.slice(1), most))
        assert [a for a, _ in parts] == np.cumsum([0, *(p.n for _, p in parts[:-1])]).tolist()
        assert np.concatenate([p.ids for _, p in parts]).tolist() == b.ids[b.size[0] :].tolist()


def test_texts_are_encoded_once(spark, monkeypatch):
    calls, original = [], lm.encoded
    monkeypatch.setattr(lm, "encoded", lambda *a: calls.append(a) or original(*a))
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    assert lm.lm_scores(df).count() == 20 and len(calls) == 1


def test_asked_positions_and_clipping():
    r = np.random.default_rng(1)
    w = {k: v + 0.3 * r.standard_normal(v.shape).astype(np.float32) for k, v in attention.fresh_weights().items()}
    seen = r.integers(0, CLASSES + 1, (5, WINDOW))
    table, place, _ = attention.projected(w)
    assert np.allclose(attention.attended(table, place, seen, CONTEXT)[-1], attention.attend(w, seen)[-1][:, CONTEXT:], atol=1e-5)
    z = np.array([[-90.0, 3.0], [50.0, 0.0]], np.float32)
    assert attention.clipped(z).tolist() == [[-40, 3], [40, 0]]

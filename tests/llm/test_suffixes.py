"""Deep-shallow sorting and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from grove.llm import suffixes


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("shallow", [0, 3, 16])
def test_deep_shallow_sorts(seed, shallow):
    r = random.Random(seed)
    stem = bytes(r.choice(b"ab") for _ in range(40))
    s = [stem[: r.randrange(41)] + bytes(r.choice(b"abc") for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 60))]
    order, shared = suffixes.deep_shallow(s, shallow)
    got = [s[i] for i in order]
    assert got == sorted(s) and sorted(order) == list(range(len(s)))
    for a, b, n in zip(got, got[1:], shared[1:], strict=False):
        assert n == len(next((a[:i] for i in range(min(len(a), len(b)), -1, -1) if a[:i] == b[:i]), b""))


def brute(texts, k):
    seen = {}
    for t in texts:
        for i in range(len(t) - k + 1):
            seen[t[i : i + k]] = seen.get(t[i : i + k], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [64, 1])
def test_removal_matches_brute_force(spark, monkeypatch, most):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(6))
    base = " ".join(word() for _ in range(400))
    texts = [None, "", "short", "a" * 900, "xy" * 700, base, base, base[:500] + "!" + base[501:1400], base[700:1101], "z" * 399, base[:399]]
    texts += [" ".join(word() for _ in range(20)) + base[300 : 300 + n] + " ".join(word() for _ in range(20)) for n in (380, 400, 402, 450, 700)]
    texts += [base[: i * 37] + "#" * (i % 3) + base[i * 37 + 5 :] for i in range(8)]
    original = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda rows, length, reach: original(rows, length, reach, most))
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = sorted(tuple(x)[1:5] for x in suffixes.suffix_dedup(df, 400).collect())
    assert got == sorted(brute([(t or "").encode() for t in texts], 400))
    assert suffixes.suffix_dedup(df.limit(0), 400).count() == 0


def covered(texts, k):
    """Bytes of each text in strings of k bytes that another text holds."""
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - k + 1):
            seen.setdefault(t[j : j + k], set()).add(i)
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for j in range(len(t) - k + 1):
            if len(seen[t[j : j + k]]) > 1:
                mark[j : j + k] = True
        out.append(int(mark.sum()))
    return out


def test_shared_passages_are_seen(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(55) for _ in range(3)]
    texts = [some(r.randrange(5, 90)) + " " + passages[i % 3] + " " + some(r.randrange(5, 90)) for i in range(12)] + [some(200) for _ in range(12)]
    texts += [None, "", some(3000) * 2, "one " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x for x in suffixes.suffix_dedup(df).collect()}
    raw = [(t or "").encode() for t in texts]
    whole, core = covered(raw, suffixes.SHARED), covered(raw, suffixes.SHARED // 2 + 1)
    for i in range(len(texts)):
        assert (got[i]["n_shared"] > 0) >= (whole[i] > 0) and got[i]["n_shared"] <= core[i]
        assert (got[i]["n_shared"] > 0) == (i < 12)


def test_a_very_long_text(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(1000))
    text = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    df = spark.createDataFrame([("p", text + passage), ("q", passage), ("q", "x")], "doc_id string, text string")
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffixes.suffix_dedup(df).collect())
    assert got == [("p", 3_001_000, 1000), ("q", 1, 0), ("q", 1000, 1000)]

"""The n-gram join against brute force, its index's bound, and components by both ways."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from grove.llm import components, ngram_join


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize("calm,members", [(200, 1024), (2, 1024), (2, 6), (200, 6)])
def test_components_match_brute_force(spark, monkeypatch, calm, members):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n", "One two", "one TWO", "one two three", "É é x y z"]
    for _ in range(6):
        base = [word() for _ in range(r.choice([8, 60, 200]))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(r.randrange(3, 9)):
            w = list(base)
            for _ in range(r.randrange(1, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            texts.append("\n".join(w))
    texts += [" ".join([*passage, *(word() for _ in range(r.choice([3, 5, 40])))]) for _ in range(25)]
    original = ngram_join.levels
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "LEAF", 80 * members)
    monkeypatch.setattr(ngram_join, "levels", lambda blocks: original(blocks, calm))
    if calm == 2:  # every token counts as common
        monkeypatch.setattr(ngram_join, "levels", lambda blocks: (np.ones(ngram_join.COUNTERS, np.uint8).tobytes(), 0))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, root int")
    assert sorted(map(tuple, ngram_join.ngram_components(df).collect())) == brute(texts)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, ngram_join.ngram_components(df).collect()))) == ["(2, 2, 2)", "(4, 2, 2)", "(4, 2, 2)", "(None, 2, None)"]
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_string_ids_and_a_long_text(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(300_000))
    df = spark.createDataFrame([("d21", "a b c d e f"), ("d0", "A b c d e f"), ("x", long), ("y", long + " end"), ("z", None), (None, "a b c d e f")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df).collect()}
    assert got == {"d21": "d0", "d0": "d0", "x": "x", "y": "x", "z": "z", None: None}


def test_tree_finds_what_the_bound_allows():
    r = np.random.default_rng(1)
    points = r.poisson(2, (200, 32))
    points[100:] = points[:100] + (r.random((100, 32)) < 0.1)
    tree = ngram_join.RTree(points, points.sum(axis=1))
    for i in range(0, 200, 7):
        n = points.sum(axis=1)
        m, s = np.minimum(points, points[i]).sum(axis=1), n + n[i]
        want = set(np.flatnonzero((m >= -(-75 * s // 175)) & (100 * np.minimum(n, n[i]) >= 75 * np.maximum(n, n[i]))))
        assert set(tree.search(points[i], n[i], 75)) == want
    for some in (200, 12):
        tree = ngram_join.RTree(points[-some:], n[-some:])
        got = {(min(a, b), max(a, b)) for a, b in tree.pairs(75).tolist() if a != b}
        m = np.minimum(points[-some:, None], points[None, -some:]).sum(axis=2)
        s = n[-some:, None] + n[None, -some:]
        fits = (m >= -(-75 * s // 175)) & (100 * np.minimum(n[-some:, None], n[None, -some:]) >= 75 * np.maximum(n[-some:, None], n[None, -some:]))
        assert got == {(a, b) for a, b in zip(*np.nonzero(np.triu(fits, 1)), strict=True)}


def test_block_pairs_span_numbers_of_groups():
    r = np.random.default_rng(2)
    sizes = np.r_[r.integers(20, 5000, 60), [1000, 1023, 1024, 1300, 1365]]
    base = np.unique(r.integers(0, 1 << 47, 6000)).astype(np.uint64)
    sets = [np.sort(r.permutation(base)[:n] if i % 2 else base[:n]) for i, n in enumerate(sizes)]
    n = np.array([len(x) for x in sets])
    raw = ngram_join.count_vectors(np.concatenate(sets), n)
    got = {(min(a, b), max(a, b)) for a, b in ngram_join.tree_pairs(raw, n, 75).tolist() if a != b}
    for a, b in itertools.combinations(range(len(sets)), 2):
        if ngram_join.alike(sets[a], sets[b], 75):
            assert (a, b) in got
    assert all(100 * min(n[a], n[b]) >= 75 * max(n[a], n[b]) for a, b in got)


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_both_ways(spark, few):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (60, 70), (99, 90)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components.components(df, few).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 60: 40, 70: 40, 99: 90}


def test_false_candidates_do_not_hide_a_link(spark, monkeypatch):
    words = ["c1", "c2", "c3", *(f"w{i}" for i in range(40_000))]
    tokens = ngram_join.token_sets(pa.array(words), 1)[0] & np.uint64((1 << ngram_join.BITS) - 1)
    token = dict(zip(words, tokens.tolist(), strict=True)).get
    words = sorted(words[3:], key=token)
    low, high = words[:600], words[10_000:]  # prefixes hold words of ``low`` only, the same in every text
    at = {}
    for w in high:
        at.setdefault((token(w) % 256, token(w) >> 8 & 1), []).append(w)
    other = {w: at[token(w) % 256, 1] for w in high}
    swapped = [w for w in high if not token(w) >> 8 & 1][:600]
    used = iter(w for w in high if token(w) >> 8 & 1 and token(w) % 256 < 64)
    same = [other[w].pop() for w in swapped]  # alike in 256 groups, not in 512
    same2 = [other[w].pop() for w in swapped[:200]] + same[200:]
    far = [w for w in used if w not in {*same, *same2}][:280]
    rest = low + [w for w in high if w not in {*swapped, *same, *same2, *far}][:800]
    texts = {
        0: [*rest, *same, "c3"], 9: [*rest, *same2],
        3: [*rest, *swapped],
        4: [*rest, *far, *swapped[280:], "c1"], 5: [*rest, *far, *same[280:560], *swapped[560:], "c1", "c2"], 6: [*rest, *same[:280], *same[280:560], *swapped[560:], "c2", "c3"],
        7: low[:100],
    }
    level = np.ones(ngram_join.COUNTERS, np.uint8)
    level[[token(w) >> ngram_join.BITS - 20 for w in ("c1", "c2", "c3")]] = 0
    monkeypatch.setattr(ngram_join, "levels", lambda blocks: (level.tobytes(), 0))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    up = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.permutations(texts, 2):
            x, y = set(texts[a]), set(texts[b])
            if 100 * len(x & y) >= 75 * len(x | y):
                up[a] = min(up[a], up[b])
    assert up == {**{i: 0 for i in texts}, 7: 7}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df, width=1).collect()} == up


def test_count_vectors_take_half_a_byte_a_group():
    r = np.random.default_rng(5)
    usual = np.sort(r.integers(0, 1 << 47, 3000)).astype(np.uint64)
    crowded = {most: np.arange(most, dtype=np.uint64) << np.uint64(32) for most in (15, 16, 300, 70_000)}  # all in one group
    sets = [usual, usual[:0], *crowded.values()]
    raw = ngram_join.count_vectors(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert len(raw[0]) == 1 + 1024 // 2 and len(raw[1]) == 1 + 256 // 2
    for x, packed in zip(sets, raw, strict=True):
        groups = ngram_join._groups(packed)
        want = np.bincount((x & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        assert groups == max(256, 1 << int(len(x) // 4).bit_length()) and (ngram_join._vector(packed) == want).all()
        assert (ngram_join._vector(packed, 256) == want.reshape(-1, 256).sum(axis=0)).all()

"""SimHash components against all pairs, and the trees against plain distances."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from grove.llm import simhash


def plain_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min((y for y in (least.get(root(i)), x) if y is not None), default=None)
    return [least[root(i)] for i in range(len(prints))]


def test_components_match_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(r.choice([1, 2, 3, 5, 300]))) for _ in range(30)]
    texts = [None, "", " \n\t", "One", "one", "É x\x1cy z"] + base
    for t in base * 3:
        w = t.split()
        w[r.randrange(len(w))] = "new"
        texts.append("\n".join(w).upper())
    ids = list(range(len(texts)))
    r.shuffle(ids)
    ids = [*ids, None, ids[3], ids[9]]
    texts += [texts[7], texts[3], texts[9]]
    prints = [plain_print(t) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int")
    want = sorted(map(str, zip(ids, (f"{p:016x}" for p in prints), plain_components(prints, ids), strict=True)))
    assert sorted(map(str, map(tuple, simhash.simhash_components(df).collect()))) == want
    assert simhash.simhash_components(df.limit(0)).count() == 0
    named = df.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert simhash.simhash_components(named).count() == len(texts)


@pytest.mark.parametrize("members,shard,trees", [(4096, 8192, 128), (3, 40, 128), (20, 16, 0)])
def test_links_join_what_the_radius_joins(spark, monkeypatch, members, shard, trees):
    r = random.Random(7)
    prints = {0}
    for _ in range(40):
        p = r.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(r.randrange(1, 5)):
                p ^= 1 << r.randrange(64)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "TREES", trees)
    original = simhash.keyed
    monkeypatch.setattr(simhash, "keyed", lambda d, radius: original(d, radius, members))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    where = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))
    links = [(where[r["a"] % (1 << 64)], where[r["b"] % (1 << 64)]) for r in simhash.near_links(df).collect()]
    for _ in range(len(prints)):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert up == plain_components(prints, list(range(len(prints))))


def test_tree_finds_all_within_the_radius():
    r = np.random.default_rng(4)
    x = np.unique(np.r_[r.integers(0, 1 << 63, 200, np.uint64), np.uint64(5) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))])
    group = np.sort(r.integers(0, 3, len(x)))
    parent, edge = simhash.bk_forest(group, x)
    assert (parent < 0).sum() == 3 and all(group[p] == g for p, g in zip(parent, group, strict=True) if p >= 0)
    assert all(edge[i] == (int(x[i]) ^ int(x[p])).bit_count() for i, p in enumerate(parent) if p >= 0)
    assert len({(p, e) for p, e in zip(parent.tolist(), edge.tolist(), strict=True) if p >= 0}) == len(x) - 3
    first = np.searchsorted(group, group)
    for radius in (0, 2, 9):
        who, node = simhash.bk_search(x, parent, edge.astype(np.int64), x, first, radius)
        near = np.bitwise_count(x[:, None] ^ x[None]) <= radius
        assert sorted(zip(who.tolist(), node.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(near & (group[:, None] == group))), strict=True))


def test_a_very_long_text():
    t = " ".join(f"w{i * i % 9973}" for i in range(120_000))
    assert simhash.fingerprints(pa.array([t, None, "a", t]), block=7000).tolist() == [plain_print(t), 0, plain_print("a"), plain_print(t)]

"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from grove.llm import spelling


def plain(rows, least=5, times=3, every=97):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= least and k >= times}
    near = {w: [o for o in n if apart(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def apart(a, b):
    """Edit distance of exactly one, by trying every edit."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def got(df, **more):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **more).collect()), key=lambda r: r[0])


def test_variants_match_brute_force(spark):
    r = random.Random(3)
    letters = "aabeÉéÿ×z"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(4, 12))) for _ in range(60)] + ["aaaaaaa", "abababab", "babababab", "aaaaa"]
    words = list(base)
    for w in base * 4:
        i = r.randrange(len(w))
        words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]]))
    weights = [1 / (1 + r.randrange(40)) for _ in words]
    rows = [(i, r.choice([" ", ", ", "\n", "-", "漢", "1"]).join(w if r.random() < 0.8 else w.upper() for w in r.choices(words, weights, k=80))) for i in range(60)]
    rows += [(7, None), (None, "aaaaaa Aaaaaa aaaaaa"), (8, ""), (9, "!"), *rows[:3]]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    want = plain(rows)
    assert sum(x[4] for x in want) > 100 and sum(x[1] is not None and x[1] != x[2] for x in want) > 3
    assert got(df) == want
    assert got(df, every=2) == plain(rows, every=2)
    assert got(df.limit(0)) == []


def test_long_words_and_texts(spark):
    long, r = "ab" * 40 + "c" * 30, random.Random(1)
    huge = "".join(r.choice("abc") for _ in range(100_000))
    words = [long, long[:50] + "x" + long[50:], long[:-1], "x" + long, "a" * 64, "a" * 65, "a" * 66, huge, huge[:500] + huge[501:], "d" * 20_000, "d" * 20_001]
    text = " ".join(words * 3 + [words[0]] * 9 + ["filler"] * 300_000)
    assert got(spark.createDataFrame([("x", text)], "doc_id string, text string"), every=0) == plain([("x", text)], every=1 << 40)


def test_checksums_are_put_together():
    texts = pa.array(["Abc déf", None, "x" * 300 + " y", "abc"])
    flat, owner = spelling.runs(texts)
    code, distinct = spelling.coded(flat)
    names = ["12", "", "-3", "d4"]
    want = [zlib.crc32(f"{names[o]}:{w}".encode()) for o, w in zip(owner, flat.to_pylist(), strict=True)]
    assert spelling.checksums(names, owner, code, distinct.to_pylist()).tolist() == want

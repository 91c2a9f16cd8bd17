"""The conversation trie against plain dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

from grove.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, said), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c - 5 * int(c / 5))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in trie.conversation_trie(df).select(COLUMNS).collect()), key=str)


def test_trie_matches_plain_prefixes(spark):
    r = random.Random(4)
    rows = []
    for c in [*range(40), 97, 98, -3, -5, 1 << 40]:
        for t in range(r.choice([1, 2, 7, 9, 12, 20])):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "bot", None]), r.choice(["", "hey", "é漢", None]) if r.random() < 0.7 else f"t{c}"))
    rows += [(3, 1, "user", "same")] * 3 + [(None, 1, "user", "lost"), (52, None, None, None), (57, 0, "", "")]
    for copy in range(100, 160):  # one conversation many times
        rows += [(copy, t, "user", f"copy {t}") for t in range(15)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, depth int")
    want = plain(rows)
    assert len({x[1] for x in want}) > 15 and any(x[3] > 40 for x in want)
    assert got(df) == want
    assert got(df.limit(0)) == []


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(10, t, "user" if t % 2 else "bot", f"say {t % 7}") for t in range(700)] + [(11, t, "user", "x") for t in range(3)] + [(12, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(df) == plain(rows)


def test_ends_are_joined_over_chunks(spark):
    df = spark.range(10_000).selectExpr("cast('k' as binary) as key", "id as conv").union(spark.sql("select cast('l' as binary), 7L"))
    got = {bytes(r["key"]): r["ends_sha256"] for r in trie.ends_digests(df.repartition(5)).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest(), b"l": hashlib.sha256(b"7").hexdigest()}

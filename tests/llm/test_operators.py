"""Token counts, packing, quality, personal data, mixing, fingerprints and URL filters on small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grove.llm import fingerprints, mixing, packing, pii, quality, tokens, urls

TEXTS = [
    None, "", " ", "\n\n  a  b\n", "don't stop 12 345!!", "a" * 3000, "word " * 3000, "x  y z\x1c\x1dq", "<|endoftext|> a<|endoftext|>b",
    "Ünïcödé ßtraße 漢字 かな 👍🏽 é ́x", "tab\tsep\r\nline\x0bv\x0cf", "It's 'S we'LL I'm", "  lead and trail  ", "a b 　c", "don't stop 12 345!!",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i else None, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_tokens int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_librarys(spark, docs, name):
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        want = [len(p.encode(t or "")) for t in TEXTS]
    else:
        want = [len(x.ids) for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    for chars in (1 << 20, 50):
        got = tokens.token_counts(docs, name, segment_chars=chars).orderBy("doc_id").collect()
        assert [r["n_tokens"] for r in got] == want
    assert [r["over_limit"] for r in got] == [n > 512 for n in want] and [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in TEXTS]
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_packing_is_gapless_and_whole(spark, docs):
    ids = [np.array([*x.ids, 1], "<u4") for x in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    rows = packing.pack(docs.repartition(3)).collect()
    for i, want in enumerate(ids):
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert sum(n for _, n, _ in own) == len(want) and all(zlib.crc32(want[s : s + n].tobytes()) == c for s, n, c in own)
        assert [s for s, _, _ in own] == list(np.cumsum([0, *(n for _, n, _ in own)])[:-1])
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(docs.limit(0)).count() == 0


def plain_sum_of_squares(sizes, size):
    """The rule by a plain loop: for each piece the level that leaves the smallest sum of squared counts, fullest first."""
    level, placed = [0] * (size + 1), []
    for s in sizes:
        def change(h):
            out = 0 if h + s == size else 2 * level[h + s] + 1
            return out + (1 - 2 * level[h] if h else 0)

        h = min((h for h in range(size - s + 1) if h == 0 or level[h]), key=lambda h: (change(h), -h))
        level[h] -= bool(h)
        level[h + s] += h + s < size
        placed.append(h)
    return level, placed


def test_sum_of_squares_prefers_the_best_level():
    p = packing.SumOfSquares(10, 0)
    for n in (6, 6, 4):
        p.add(n, np.arange(n, dtype="<u4"))
    assert p.level[6] == 1 and len(p.done) == 2 and p.n_open == 1
    q = packing.SumOfSquares(16, 0, most_open=3)
    for i in range(50):
        q.add(i, np.arange(9, dtype="<u4"))
    q.finish()
    assert sum(d[2] for d in q.done) == 450 and q.n_open == 0


def test_whole_tables_are_placed_by_the_rule_and_little_is_moved():
    r = np.random.default_rng(3)
    sizes = np.maximum(1, r.lognormal(5, 1, 4000)).astype(int)
    p = packing.SumOfSquares(2048, 0)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype="<u4"))
    level, _ = plain_sum_of_squares([n % 2048 for n in sizes if n % 2048], 2048)
    assert p.level == level  # equal ones at every step, ties included
    p.finish()
    assert sum(d[2] for d in p.done) == sizes.sum() and p.moved < 0.05 * sizes.sum()
    fill = {}
    for d in p.done:
        fill[d[5]] = fill.get(d[5], 0) + d[2]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def test_quality_statistics(spark, docs):
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), dup, len(again))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_bad_hosts_lose_doubtful_documents_only(spark):
    clean = "the quick brown fox jumps over a lazy dog near some river bank today"
    doubtful = clean + "\n\n" + "same line\n" * 3 + "a b"
    rows = [(i, "a b", "bad") for i in range(60)] + [(100, clean, "bad"), (101, doubtful, "bad"), (102, doubtful, "good")] + [(200 + i, clean + str(i), "good") for i in range(60)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept[100] and kept[102] and not kept[101] and not kept[0] and all(kept[200 + i] for i in range(60))


def test_host_verdicts_follow_the_corpus(spark):
    clean = "the quick brown fox jumps over a lazy dog near some river bank today"
    doubtful = clean + "\n\n" + "same line\n" * 3 + "a b"
    for bad_share, gone in ((30, True), (6, False)):  # per 100 documents; the other hosts have 5
        rows = [(1000 * h + i, "a b" if i < (bad_share if h == 0 else 5) else doubtful if i == 99 else clean + str(i), f"h{h}") for h in range(12) for i in range(100)]
        got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got[99]["bad_host"] == gone == (not got[99]["kept"]) and got[1099]["kept"] and not got[1099]["bad_host"]
        assert all(got[1000 * h + i]["kept"] for h in range(12) for i in range(40, 99))  # clean ones stay on any host


def test_base_spans_match_the_patterns(spark):
    texts = ["a@b.c_d@e.f x@y mail: q.w+e@sub.dom-a.org.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 1" + "0" * 40, "+1 (377) 555-0271, +12 +1234567890123456", "é@b.c 👍+49 30 1234567", None, "1 " * 5000]
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(df).select("doc_id", pii.joined(F.filter("spans", lambda s: s["kind"] != "secret")).alias("s")).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(pats.items()) for m in re.finditer(p, t or "") if ok(kind, m[0])]
        assert got[i] == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_spans_of_many_matches(spark):
    make = lambda n: " ".join(f"\U0001f44d{'x' * (i % 5)} a{i}@b.org" for i in range(n)) + " end"
    counts = [0, 1, 63, 64, 65, 128, 129, 20_000]
    df = spark.createDataFrame([(n, make(n)) for n in counts], "n int, text string")
    got = {r["n"]: r["s"] for r in df.select("n", pii.joined(pii.base_spans(F.col("text"))).alias("s")).collect()}
    for n in counts:
        assert got[n] == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a[0-9]+@b\.org", make(n)))


def test_secrets_are_found_and_masked_and_clean_text_stays(spark):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [(i, f'so token = "{hashlib.sha1(str(i).encode()).hexdigest()}" it is') for i in range(20)] + [(100 + i, f"plain words and averyverylongword{i}ofletters only") for i in range(30)]
    df = spark.createDataFrame([*rows, (500, f'mail a@b.org, password: "{key}" end')], "doc_id int, text string")
    found = pii.personal_data(df).select("doc_id", "spans", pii.masked(F.col("text"), F.col("spans")).alias("text")).collect()
    got = {r["doc_id"]: r["text"] for r in found}
    assert got[3] == 'so token = "<SECRET>" it is' and got[500] == 'mail <EMAIL>, password: "<SECRET>" end'
    assert all(got[i] == t for i, t in rows if i >= 100)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_planted_personal_data_is_found_and_little_else(spark):
    r = np.random.default_rng(7)
    pick = lambda xs: str(r.choice(xs))
    syllable = lambda: pick(["ta", "re", "mi", "lo", "ka", "nu", "sho", "ber"])
    word = lambda: syllable() + syllable() + syllable()
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    makers = {
        "secret": lambda: ('api key = "', hashlib.sha1(digits(9).encode()).hexdigest(), '" so'),
        "account": lambda: (pick(["passport no ", "account number ", "IBAN: ", "ssn "]), pick([f"DE{digits(20)}", f"C{digits(8)}", f"{digits(3)}-{digits(2)}-{digits(4)}"]), " was"),
        "name": lambda: (pick(["by mr ", "dear ", "contact: ", "signed "]), pick(pii.FIRST_NAMES[:15]).title() + " " + word().title(), " about"),
        "address": lambda: (pick(["address: ", "lives at ", "resides at "]), f"{r.integers(1, 900)} {word().title()} {pick(['Street', 'Road', 'Avenue', 'Lane'])}", ", 1"),
    }
    rows, want = [], set()
    for i in range(400):
        text = " ".join(word() for _ in range(12)).capitalize() + ". "
        if i % 2:
            kind = list(makers)[i // 2 % 4]
            before, value, after = makers[kind]()
            text += word() + " " + before
            want.add((i, kind, len(text), len(text) + len(value)))
            text += value + after
        text += " " + " ".join(word() for _ in range(3)) + f". {word().title()} {word()} {word().title()} {r.integers(1, 99)} {word()} order {digits(4)}"
        rows.append((i, text))
    got = {(x["doc_id"], s["kind"], s["start"], s["end"]) for x in pii.personal_data(spark.createDataFrame(rows, "doc_id int, text string")).collect() for s in x["spans"]}
    right = len(got & want)
    assert right > 0.9 * len(want) and right > 0.9 * len(got), (right, len(want), len(got), sorted(want - got)[:5], sorted(got - want)[:5])


def test_mix_meets_targets(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), " ".join(["w"] * int(r.integers(1, 300))), s) for i, s in enumerate(r.choice(["a", "b", "c", None], 3000, p=[0.7, 0.02, 0.2, 0.08]).tolist())]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=300).collect()
    size = {}
    for g in got:
        size[g["source"]] = size.get(g["source"], 0) + g["size"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight, total, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(size.values()), {}
    while True:
        free = [s for s in order if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
    for s in order:
        own = [g for g in got if g["source"] == s]
        assert abs(own[0]["target"] - target[s]) < 1e-6 and abs(sum(g["taken"] for g in own) - target[s]) < 0.005 * target[s] + 5
        assert all(g["taken"] <= 3 * g["size"] for g in own)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), group_rows=300).collect()
    assert {g["doc_id"]: g["taken"] for g in got} == {g["doc_id"]: g["taken"] for g in again}


def test_small_sources_meet_targets_where_some_choice_does(spark):
    """Against all sums that copies of 0 to 3 can have: sources of a few documents, one of them most of its source."""
    r = np.random.default_rng(5)
    sizes = {s: [*r.integers(40, 400, 9).tolist(), big] for s, big in zip("abcdefghi", r.integers(100, 3000, 9).tolist(), strict=True)}
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate((n, s) for s, own in sizes.items() for n in own)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, own in sizes.items():
        sums = 1
        for n in own:
            sums |= sums << n | sums << 2 * n | sums << 3 * n
        target = next(g["target"] for g in got if g["source"] == s)
        best = min(abs(k - target) for k in range(sums.bit_length()) if sums >> k & 1)
        off = abs(sum(g["taken"] for g in got if g["source"] == s) - target)
        assert off <= max(best, 0.005 * target), (s, target, off, best)


def test_a_source_of_many_groups_makes_up_for_its_largest_document(spark):
    rows = [(i, "w " * (60_000 if i == 7 else 20 + i * 37 % 150), "a" if i < 900 else "b") for i in range(1800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=50).collect()
    for s in "ab":
        own = [g for g in got if g["source"] == s]
        assert abs(sum(g["taken"] for g in own) - own[0]["target"]) <= 1e-3 * own[0]["target"] + 1 and all(g["copies"] in range(4) for g in own)


def test_rates_are_the_duals(spark):
    """Against a plain solver over all documents: bisection on the trait's number, and on each source's inside it."""
    r = np.random.default_rng(1)
    source = r.choice(["a", "b", "c"], 900, p=[0.6, 0.3, 0.1])
    n = np.maximum(1, r.lognormal(np.where(source == "a", 3.0, 4.0), 1.0)).astype(int)
    df = spark.createDataFrame([(i, "w " * int(k), s) for i, (k, s) in enumerate(zip(n, source, strict=True))], "doc_id long, text string, source string")
    got = {g["doc_id"]: g for g in mixing.mix(df).collect()}
    rate = np.array([got[i]["rate"] for i in range(900)])
    target = {s: next(g["target"] for g in got.values() if g["source"] == s) for s in "abc"}
    x = np.log1p(n)
    x = (x - np.average(x, weights=n)) / np.sqrt(np.cov(x, aweights=n, ddof=0))

    def rates(mu):
        out = np.zeros(900)
        for s in "abc":
            own = source == s
            if target[s] >= 3 * n[own].sum() * (1 - 1e-12):
                out[own] = 3
                continue
            low, top = -20.0, 20.0
            for _ in range(80):
                mid = (low + top) / 2
                low, top = (mid, top) if (n[own] * np.minimum(3, np.exp(mid + mu * x[own]))).sum() < target[s] else (low, mid)
            out[own] = np.minimum(3, np.exp(low + mu * x[own]))
        return out

    low, top = -5.0, 5.0
    for _ in range(60):
        mid = (low + top) / 2
        low, top = (mid, top) if (n * rates(mid) * x).sum() + 1e-4 * sum(target.values()) * mid < 0 else (low, mid)
    assert np.abs(rate - rates(low)).max() < 1e-3 and len(set(rate.round(6))) > 20 and abs(low) > 0.01


def test_mix_edge_cases(spark):
    rows = [(None, "a b c", None), (None, "a b c d", None), (1, None, "s"), (1, "", "s"), (2, "x", "t"), (2, "x", "t"), (3, "w " * 200_000, "t")]
    df = spark.createDataFrame([(*x, 5, 6.0) for x in rows], "doc_id long, text string, source string, size int, rate double")
    got = mixing.mix(df).collect()
    assert len(got) == 7 and all(g["taken"] <= 3 * g["size"] for g in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = ["a b c\nd e f", "d e f\na b c", "a b c\nd e f", "x y z w " * 20, None, "é👍" * 7, "long text " * 40]
    df = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, vec int")
    rows = fingerprints.edited_likeness(df).orderBy("doc_id").collect()
    full = [t or "" for t in texts]
    for i, (r, t) in enumerate(zip(rows, full, strict=True)):
        after, n = full[(i + 1) % len(full)], len(t)
        edit = t[: n - n // 2] + after[: n // 2]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i * 3, n, hashlib.sha256(edit.encode()).hexdigest())
        assert (r["near_edited"] == 1) == (edit == t) or r["fingerprint"] == r["edited_fingerprint"]
        assert 0 <= r["near_next"] <= 1
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == rows[2]["fingerprint"] != rows[3]["fingerprint"]
    one = fingerprints.edited_likeness(df.limit(1)).first()
    assert one["near_next"] == 1 and fingerprints.edited_likeness(df.limit(0)).count() == 0
    v = {r["doc_id"]: r["vec"] for r in fingerprints.fingerprints(spark.createDataFrame([(1, "p q"), (2, "r s"), (3, "p q\nr s")], "doc_id long, text string")).collect()}
    pair = spark.createDataFrame([(v[1], v[2], v[3])], "a array<long>, b array<long>, c array<long>")
    assert pair.select(fingerprints.combined(F.col("a"), F.col("b")) == F.col("c"), fingerprints.combined(F.col("c"), F.col("b"), -1) == F.col("a")).first()[:] == (True, True)


def test_url_rules_and_models(spark):
    rows = [(1, "http://EXAMPLE.org/es/x"), (2, "https://a.example.org/en/12?q"), (3, "http://b.org"), (4, "ftp://x.com/fr/"), (5, "x.com/fr/"), (6, None), (7, "http://notexample.org/es/1#f"), (8, "http://u.com/de/9")]
    rows += [(100 + i, f"http://site{i}.com/fr/news{i}") for i in range(40)] + [(200 + i, f"http://spam{i}.com/de/pills{i}") for i in range(40)] + [(300, "http://site3.net/fr/news4"), (301, "http://spam4.net/de/pills5"), (300, "http://site3.net/fr/news4")]
    got = urls.url_filter(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, llr int"))
    by = {r["page_id"]: r for r in got.collect()}
    want = {1: ("example.org", "/es/x", "example.org/es/", "block"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"), 3: ("b.org", "", None, None), 4: ("x.com", "/fr/", "com/fr/", "allow"), 5: ("", "", None, None), 6: ("", "", None, None), 7: ("notexample.org", "/es/1", "org/", "allow"), 8: ("u.com", "/de/9", "com/de/", "block")}
    for i, (host, path, rule, verdict) in want.items():
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule) and (verdict is None or by[i]["verdict"] == verdict)
    assert by[300]["verdict"] == "allow" and by[301]["verdict"] == "block" and got.count() == len(rows)
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_ratio(labelled, text):
    """The log-likelihood difference of a text by plain loops over exact contexts."""
    def model(want):
        seen = {}
        for t, ok in labelled:
            if ok == want:
                full = "^^^^" + re.sub(r"[^a-z0-9\-._~/%:=&+]", "?", t) + "$"
                for i in range(4, len(full)):
                    for k in range(5):
                        at = seen.setdefault(full[i - k : i], {})
                        at[full[i]] = at.get(full[i], 0) + 1
        return seen

    def chance(seen, full, i):
        p = 1 / len(urls.SYMBOLS)
        for k in range(5):
            if at := seen.get(full[i - k : i]):
                p = (at.get(full[i], 0) + len(at) * p) / (sum(at.values()) + len(at))
        return p

    yes, no, full = model(True), model(False), "^^^^" + re.sub(r"[^a-z0-9\-._~/%:=&+]", "?", text) + "$"
    each = [np.log(chance(yes, full, i) / chance(no, full, i)) for i in range(4, len(full))]
    return sum(each) / len(each)


@pytest.mark.parametrize("contexts", [20_000, 3])
def test_url_ratios_match_a_plain_loop(spark, monkeypatch, contexts):
    """URLs without a rule by all labels, those with one by the labels of other hosts' folds; null ids and repeated rows."""
    monkeypatch.setattr(urls, "CONTEXTS", contexts)
    r = np.random.default_rng(0)
    word = lambda n: "".join(r.choice(list("abcde-é"), n))
    host = [word(5) for _ in range(25)]
    rows = [(i, f"http://{host[i % 25]}.com/{('fr', 'de')[i % 2]}/{word(6)}") for i in range(60)] + [(100 + i, f"http://{word(5)}.net/{word(600 * (i == 0) + 5)}") for i in range(6)]
    rows += [(3, rows[3][1]), (None, rows[63][1]), (None, rows[63][1])]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    seen = [re.sub("[A-Z]", lambda m: m[0].lower(), u.split("://")[1]) for _, u in rows]
    labelled = [(t, "/fr/" in t, zlib.crc32(t.split("/")[0].encode()) % 5) for t in seen if ".com/" in t]
    assert len(got) == len(rows) and sum(g["page_id"] is None for g in got) == 2
    for g in got:
        text = g["host"] + g["path"]
        fold = zlib.crc32(g["host"].encode()) % 5 if g["rule"] else None
        assert abs(g["llr"] - plain_ratio([(t, ok) for t, ok, f in labelled if f != fold], text)) < 1e-9
    twin = next(g["llr"] for g in got if g["page_id"] == 103)
    assert all(abs(g["llr"] - twin) < 1e-9 for g in got if g["page_id"] is None)


def test_url_threshold(spark):
    rows = lambda yes, no: spark.createDataFrame([(True, float(x)) for x in yes] + [(False, float(x)) for x in no], "accepted boolean, llr double")
    assert urls.threshold(rows([], [])) == 0 and urls.threshold(rows([1], [])) == -np.inf and urls.threshold(rows([], [1])) == np.inf
    assert urls.threshold(rows([0.1, 0.2], [0.3, 0.4])) == 0
    r = np.random.default_rng(2)
    yes, no = r.normal(1.0, 0.1, 400), r.normal(0.2, 0.3, 100)
    middle = (yes.mean() * no.std() + no.mean() * yes.std()) / (yes.std() + no.std())
    assert abs(urls.threshold(rows(yes, no), 0) - middle) < 1e-9 and abs(urls.threshold(rows(yes, no), 50) - middle * 100 / 150) < 1e-9
    assert abs(urls.threshold(rows([*yes, 1.5], no), 0) - middle) < 0.05  # one score moves it little
    assert urls.threshold(rows([1, 1], [0, 0]), 0) == 0.5 and urls.held_out_accuracy(rows([1, 1, 0], [0, 0]), 0.5) == pytest.approx(5 / 6)


def test_url_models_judge_hosts_they_have_not_seen(spark):
    """A small table alone, and beside ten times as many URLs."""
    pages = lambda sf: spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url")
    small = pages("sf0.01")
    both = small.unionAll(pages("sf0.1").withColumn("page_id", F.col("page_id") + 1_000_000))
    for rows, least in ((small, 0.8), (both, 0.93)):
        _, labelled = urls.prepared(rows, urls.RULES, "page_id", "url")
        scores = urls.keep(urls.cross_fitted(labelled, urls.keep(urls.train(labelled))))
        assert urls.held_out_accuracy(scores, urls.threshold(scores)) > least


def test_fingerprints_of_long_lines_and_string_ids(spark):
    texts = {"b": " ".join(f"w{i * i % 9973}" for i in range(700_000)), "a": "x y\nz", "c": None}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(df).collect()}
    order = sorted(texts)
    for i, k in enumerate(order):
        t, after = texts[k] or "", texts[order[(i + 1) % 3]] or ""
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_clashing_columns_and_null_ids(spark):
    rows = [(None, "mail a@b.org", "s", "u", 1.0), (None, "mail a@b.org", "s", "u", 1.0), (1, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, start double")
    assert packing.pack(df).where("start = 0").count() == 3 and tokens.token_counts(df).count() == 3 and quality.quality_rules(df).count() == 3
    found = pii.personal_data(df)
    assert found.columns[:5] == df.columns and [len(r["spans_"]) for r in found.orderBy("start").collect()] == [0, 1, 1]
    assert {r["spans"] for r in found.collect()} == {"u", None}
    assert fingerprints.edited_likeness(df).count() == 3


def test_very_long_texts(spark):
    text = " ".join(f"Ab Cd{'e' * (i % 7)} a{i}@b.org" if i % 3 else "word" for i in range(3_000))
    df = spark.createDataFrame([(1, text, f"http://a.net/{'x' * 200_000}")], "doc_id long, text string, url string").withColumn("source", F.lit("s"))
    r = quality.quality_rules(df).first()
    assert r["n_words"] == len(text.split()) and r["word_chars"] == sum(map(len, text.split()))
    spans = pii.personal_data(df).select(F.explode("spans").alias("s")).where("s.kind = 'email'").select("s.*").collect()
    want = [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+@b\.org", text)]
    assert [(x["start"], x["end"]) for x in spans] == want and len(want) == 2_000
    assert len(urls.url_filter(df, id_col="doc_id").first()["path"]) == 200_001

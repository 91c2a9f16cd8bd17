"""The attention model's gradients and windows, and scores end to end against plain loops."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from grove.llm import attention, lm
from grove.llm.attention import BRANCH, CLASSES


def weights(seed=1):
    r = np.random.default_rng(seed)
    return {k: v + 0.1 * r.standard_normal(v.shape).astype(np.float32) for k, v in attention.fresh_weights().items()}


def some_prior(seed=2):
    r = np.random.default_rng(seed)
    c = r.zipf(1.2, 5000) % CLASSES
    return attention.Prior(*(t.astype(float) for t in attention.pair_counts(np.r_[CLASSES, c[:-1]], c)))


def plain_log_likelihood(w, prior, h, before, c):
    """One class's log-likelihood from a hidden state, choice by choice."""
    out = 0.0
    for matrix, start, pick in (
        (w["out1"][0], prior.one[before], c // BRANCH**2),
        (w["out2"][c // BRANCH**2], prior.two[before * BRANCH + c // BRANCH**2], c // BRANCH % BRANCH),
        (w["out3"][c // BRANCH], prior.three[before // BRANCH * BRANCH**2 + c // BRANCH], c % BRANCH),
    ):
        z = h.astype(float) @ matrix + start
        out += z[pick] - np.log(np.exp(z).sum())
    return out


def test_prior_shares_add_up():
    p = some_prior()
    assert all(np.allclose(np.exp(t).sum(axis=1), 1, atol=1e-5) for t in (p.one, p.two, p.three))


def test_gradients_match_differences():
    w, r, prior = weights(), np.random.default_rng(2), some_prior()
    seen, target = r.integers(0, CLASSES + 1, (3, attention.WINDOW)), r.integers(0, CLASSES, (3, attention.WINDOW))
    target[1, 20:] = -1

    def loss(w):
        h = attention.attend(w, seen)[-1]
        return -np.mean([plain_log_likelihood(w, prior, h[i, j], seen[i, j], target[i, j]) for i, j in zip(*np.nonzero(target >= 0), strict=True)])

    for k, g in attention.gradients(w, prior, seen, target).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[at]) < 2e-3 * max(1, abs(g[at])) and g[at], k


def test_each_class_is_scored_once_with_its_context():
    w, prior, r = weights(), some_prior(), np.random.default_rng(3)
    n = np.array([1, 5, 32, 33, 100])
    classes = r.integers(0, CLASSES, n.sum())
    for batch in (2, 256):
        got, at = attention.log_likelihoods(w, prior, classes, n, batch), 0
        for size in n:
            c, step = classes[at : at + size], attention.WINDOW - attention.CONTEXT
            before = np.r_[CLASSES, c[:-1]]
            for i in range(size):
                first = 0 if i < attention.WINDOW else (i - attention.CONTEXT) // step * step
                seen = np.zeros((1, attention.WINDOW), int)
                seen[0, : i - first + 1] = before[first : i + 1]
                assert abs(got[at + i] - plain_log_likelihood(w, prior, attention.attend(w, seen)[-1][0, i - first], before[i], c[i])) < 1e-3
            at += size


def test_all_tokens_are_trained_on_once():
    n = np.array([1, 31, 32, 33, 200])
    classes = np.arange(n.sum())
    got = attention.training_windows(classes, n)
    assert sorted(got[:, 1:][got[:, 1:] >= 0]) == list(range(n.sum()))
    starts = set((np.cumsum(n) - n).tolist())
    for row in got:
        real = row[1:][row[1:] >= 0]
        assert row[0] == (CLASSES if real[0] in starts else real[0] - 1) and (np.diff(real) == 1).all()


def test_training_beats_the_pair_counts():
    r, after, names = np.random.default_rng(5), np.random.default_rng(6).permutation(30), np.arange(30) * 131

    def make() -> np.ndarray:
        """Texts in which a class depends on the one before the last, which pair counts don't see."""
        c = np.zeros((400, 64), int)
        c[:, :2] = r.integers(0, 30, (400, 2))
        for i in range(2, 64):
            c[:, i] = after[c[:, i - 2]]
        return names[c].ravel()

    learn, held, n = make(), make()[:6400], np.full(400, 64)
    prior = attention.Prior(*(t.astype(float) for t in attention.pair_counts(np.r_[CLASSES, learn[:-1]], learn)))
    learner = attention.Learner(attention.fresh_weights(), 0.01)
    score = lambda w: attention.log_likelihoods(w, prior, held, n[:100]).mean()
    before = score(learner.w)
    for i in range(6):
        learner.learn(prior, attention.training_windows(learn, n), i)
    assert score(learner.w) > before + 0.5


@pytest.mark.parametrize("most", [1_000_000, 20, 0])
def test_scores_match_a_plain_loop(spark, monkeypatch, most):
    r = np.random.default_rng(4)
    long = " ".join(f"w{i * i % 41}" for i in range(60_000))
    texts = [None, "", "Ab aB ab\n\x0bc", "<|endoftext|> é", long, *(" ".join(f"w{int(x)}" for x in r.zipf(1.6, 40) % 50) for _ in range(60))]
    df = spark.createDataFrame([(i, t, 0.0, 1) for i, t in enumerate(texts)], "doc_id long, text string, score double, held int")
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = {}
    for s, h in zip(split, held, strict=True):
        for x in s:
            count[x] = count.get(x, 0) + (not h)
    count = {k: c for k, c in count.items() if c}
    n, v = sum(count.values()), len(count)
    kept, original = [], lm.trained
    tables, classed = [], lm.class_table
    monkeypatch.setattr(lm, "trained", lambda *a: kept.append(original(*a)) or kept[0])
    monkeypatch.setattr(lm, "class_table", lambda ids: tables.append(classed(ids)) or tables[0])
    rows = lm.lm_scores(df, most_words=most).collect()
    (prior, w), (of, share) = kept[0], tables[0]
    assert len(rows) == len(texts)
    for g in rows:
        s = split[g["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[g["doc_id"]], len(s), sum(x in count for x in s), n)
        assert g["n_rare"] == sum(count.get(x, 0) < 2 for x in s)
        uni = [math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in s]
        assert abs(g["base_score"] - sum(uni)) < 1e-9 * max(1, len(s))
        b = lm.Batch(lm.filled(pa.array([texts[g["doc_id"]]])), "byte_bpe_50k.tiktoken")
        each = attention.log_likelihoods(w, prior, of[b.ids], b.size) + share[b.ids]
        ends = np.r_[np.cumsum(b.per_word), b.size[0]]
        att = [each[i:j].sum() / math.log(10) for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        assert abs(g["attention_score"] - sum(att)) < 1e-6 * max(1, len(s))
        assert abs(g["score"] - sum(math.log10(0.5 * 10**u + 0.5 * 10**a) for u, a in zip(uni, att, strict=True))) < 1e-6 * max(1, len(s))


def test_every_half_is_trained_on_with_the_others_counts(spark, monkeypatch):
    calls, original = [], lm.learned

    def spy(rows, tokenizer, shared, rate):
        calls.append((sorted(r["t"] for r in rows.collect()), rate, shared.value[2]))
        return original(rows, tokenizer, shared, rate)

    monkeypatch.setattr(lm, "learned", spy)
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    lm.lm_scores(df).collect()
    kept = sorted(f"text number {i}" for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2)
    (a, none, _), (b, _, over_a), (c, _, over_b) = calls
    assert none is None and a == c and sorted(a + b) == kept and over_a is not None and over_b is not None


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    rows = lm.lm_scores(df).collect()
    assert len(rows) == 3 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert lm.lm_scores(df.limit(0)).count() == 0


def test_steps_depend_on_the_windows_met_only(monkeypatch):
    sizes = []
    monkeypatch.setattr(attention, "gradients", lambda w, prior, seen, target: sizes.append(target[:, 0].tolist()) or {})
    windows = np.arange(9000)[:, None] + np.zeros((1, attention.WINDOW + 1), int)
    for cuts in ([], [10, 5000], [4999]):
        sizes.clear()
        learner = attention.Learner(attention.fresh_weights(), 0.01)
        for part in np.split(windows, cuts):
            learner.learn(None, part)
        assert sorted(x for s in sizes for x in s) == list(range(9000)) and learner.windows == 9000
        met, parts = 0, {0, *cuts, 9000}
        for s in sizes:
            assert len(s) == max(met // 50, 32) or met + len(s) in parts
            met += len(s)

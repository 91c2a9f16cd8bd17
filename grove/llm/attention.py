"""A causal self-attention model over token classes in numpy: training by back-propagation, masked batches, scoring.

Classes are leaves of a tree of depth 3 with BRANCH branches a node, so a class costs 3 * BRANCH outputs, not one for
each class: the first choice, the second given the first, and the third given both.
"""

from __future__ import annotations

import numpy as np

WIDTH, WINDOW, CONTEXT, BRANCH = 16, 32, 6, 16
CLASSES = BRANCH**3
_ONES = {n: np.ones(n, np.float32) for n in (BRANCH, WINDOW)}
_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    """Starting weights; index CLASSES of the embedding stands for the start of a text."""
    r, d = np.random.default_rng(seed), WIDTH
    draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": draw(CLASSES + 1, d, scale=0.3), "place": draw(WINDOW, d, scale=0.3), "qkv": draw(d, 3 * d, scale=d**-0.5), "mix": draw(d, d, scale=d**-0.5),
        "out1": np.zeros((1, d, BRANCH), np.float32), "out2": np.zeros((BRANCH, d, BRANCH), np.float32), "out3": np.zeros((BRANCH**2, d, BRANCH), np.float32),
    }


class Prior:
    """Log chances of each choice from counts of class pairs: the first two given the class before, the third given the
    first two choices of the class before. They are what the model's outputs start from."""

    def __init__(self, first: np.ndarray, last: np.ndarray):
        """``first[a, b // BRANCH]`` and ``last[a // BRANCH, b]`` count class b after class a (or the start, CLASSES)."""
        n = first.reshape(CLASSES + 1, BRANCH, BRANCH)
        self.one = self._smoothed(n.sum(axis=2)[:, None, :])[:, 0]
        self.two = self._smoothed(n).reshape(-1, BRANCH)
        self.three = self._smoothed(last.reshape(-1, BRANCH**2, BRANCH)).reshape(-1, BRANCH)

    @staticmethod
    def _smoothed(n: np.ndarray) -> np.ndarray:
        """Log shares over the last axis, falling back on the counts of all rows in proportion to the kinds seen."""
        alone = n.sum(axis=0) + 0.5
        alone /= alone.sum(axis=1, keepdims=True)
        kinds = (n > 0).sum(axis=2, keepdims=True) + 1.0
        return np.log((n + kinds * alone) / (n.sum(axis=2, keepdims=True) + kinds)).astype(np.float32)


def pair_counts(before: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables that a Prior is made from."""
    top = CLASSES // BRANCH
    first = np.bincount(before * top + classes // BRANCH, minlength=(CLASSES + 1) * top)
    last = np.bincount(before // BRANCH * CLASSES + classes, minlength=(top + 1) * CLASSES)
    return first.reshape(CLASSES + 1, top), last.reshape(top + 1, CLASSES)


def projected(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that attention needs of a class and of a place, made once for all positions that hold them: side by side the
    vector itself, its query (scaled), its key, its value as it is mixed in, and a one for classes. Also the matrix behind."""
    d = WIDTH
    m = np.concatenate([np.eye(d, dtype=np.float32), w["qkv"][:, :d] * np.float32(d**-0.5), w["qkv"][:, d : 2 * d], w["qkv"][:, 2 * d :] @ w["mix"], np.zeros((d, 1), np.float32)], axis=1)
    table, place = w["embed"] @ m, w["place"] @ m
    table[:, -1] = 1
    return table, place, m


def clipped(z: np.ndarray) -> np.ndarray:
    """Keeps exponents within 40 of 0. They hardly ever lie beyond, and looking costs less than writing them anew."""
    return np.clip(z, -40, 40, out=z) if z.size and (z.max() > 40 or z.min() < -40) else z


def attended(table: np.ndarray, place: np.ndarray, seen: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
    """Projections of ``seen`` (windows x WINDOW classes), exponentials of the likenesses of positions from ``skip`` on with
    those up to them, their sums, what is mixed in, and the hidden states."""
    d = WIDTH
    y = table.take(seen, axis=0, mode="clip")
    y += place
    a = y[:, skip:, d : 2 * d] @ y[:, :, 2 * d : 3 * d].transpose(0, 2, 1)
    np.exp(clipped(a), out=a)
    a *= _PAST[skip:]
    s = (a.reshape(-1, WINDOW) @ _ONES[WINDOW]).reshape(*a.shape[:2], 1)
    o = a @ y[:, :, 3 * d : 4 * d]
    o /= s
    return y, a, s, o, y[:, skip:, :d] + o


def attend(w: dict[str, np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hidden states of ``seen`` (the last result); each position attends to itself and those before it."""
    return attended(*projected(w)[:2], seen)


def _segments(key: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """Of a sorted key: each value that occurs, and where it starts and ends."""
    at = np.searchsorted(key, np.arange(top + 1)).tolist()
    return [(g, a, b) for g, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]


def choices(w: dict[str, np.ndarray], prior: Prior, h: np.ndarray, before: np.ndarray, classes: np.ndarray):
    """For hidden states sorted by the first two choices of their targets, one level of the tree after another:
    exponentials of all outputs, their sums, the outputs of the targets, where these lie, and the segments of equal nodes."""
    one, two = classes // BRANCH**2, classes // BRANCH
    row = np.arange(0, len(h) * BRANCH, BRANCH)
    levels = (prior.one, before, one, [(0, 0, len(h))]), (prior.two, before * BRANCH + one, two % BRANCH, _segments(one, BRANCH)), (prior.three, before // BRANCH * BRANCH**2 + two, classes % BRANCH, _segments(two, BRANCH**2))
    for level, (table, at, pick, segments) in enumerate(levels, 1):
        m, z = w[f"out{level}"], np.empty((len(h), BRANCH), np.float32)
        for g, a, b in segments:
            np.matmul(h[a:b], m[g], out=z[a:b])
        z += table.take(at, axis=0, mode="clip")
        pick += row
        got = clipped(z).ravel().take(pick)
        np.exp(z, out=z)
        yield z, z @ _ONES[BRANCH], got, pick, segments


#: Windows that are attended to at once: what is made of them stays in a core's cache.
_CHUNK = 128


def gradients(w: dict[str, np.ndarray], prior: Prior, seen: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-likelihood; targets below 0 are padding."""
    d = WIDTH
    table, place, m = projected(w)
    chunks = [slice(i, i + _CHUNK) for i in range(0, len(seen), _CHUNK)]
    made = [attended(table, place, seen[c]) for c in chunks]
    t = target.ravel()
    real = np.flatnonzero(t >= 0)
    real = real[np.argsort((t[real] // BRANCH).astype(np.uint8), kind="stable")]
    hs = np.concatenate([x[-1].reshape(-1, d) for x in made]).take(real, axis=0)
    share = np.float32(1 / max(1, len(real)))
    grad, ds, back = {}, np.zeros_like(hs), np.empty_like(hs)
    for level, (z, s, _, pick, segments) in enumerate(choices(w, prior, hs, seen.ravel()[real], t[real]), 1):
        z *= (share / s)[:, None]
        z.ravel()[pick] -= share
        mine = w[f"out{level}"]
        change, turned = np.zeros_like(mine), mine.transpose(0, 2, 1)
        for g, i, j in segments:
            np.matmul(hs[i:j].T, z[i:j], out=change[g])
            np.matmul(z[i:j], turned[g], out=back[i:j])
        ds += back
        grad[f"out{level}"] = change
    dx = np.zeros((seen.size, d), np.float32)
    dx[real] = ds
    dx, dm = dx.reshape(*seen.shape, d), np.zeros((d, 3 * d), np.float32)
    for c, (y, a, s, o, _) in zip(chunks, made, strict=True):
        dh = np.empty((*s.shape[:2], d + 1), np.float32)
        np.divide(dx[c], s, out=dh[:, :, :d])
        dh[:, :, d] = -np.einsum("bij,bij->bi", dh[:, :, :d], o)
        da = dh @ y[:, :, 3 * d :].transpose(0, 2, 1)
        da *= a
        part = np.empty((*s.shape[:2], 3 * d), np.float32)  # of queries, keys and values
        np.matmul(da, y[:, :, 2 * d : 3 * d], out=part[:, :, :d])
        np.matmul(da.transpose(0, 2, 1), y[:, :, d : 2 * d], out=part[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dh[:, :, :d], out=part[:, :, 2 * d :])
        part = part.reshape(-1, 3 * d)
        dm += y.reshape(-1, y.shape[2])[:, :d].T @ part
        dx[c] += (part @ m[:, d : 4 * d].T).reshape(-1, WINDOW, d)
    order = np.argsort(seen.ravel().astype(np.uint16), kind="stable")
    key = seen.ravel()[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    embed = np.zeros_like(w["embed"])
    embed[key[edge]] = np.add.reduceat(dx.reshape(-1, d).take(order, axis=0), edge, axis=0)
    value = dm[:, 2 * d :]
    qkv = np.concatenate([dm[:, :d] * np.float32(d**-0.5), dm[:, d : 2 * d], value @ w["mix"].T], axis=1)
    return grad | {"embed": embed, "place": dx.sum(axis=0), "qkv": qkv, "mix": w["qkv"][:, 2 * d :].T @ value}


class Learner:
    """Adam over batches of windows; its weights are copies."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.steps, self.windows = {k: v.copy() for k, v in w.items()}, rate, 0, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def learn(self, prior: Prior, windows: np.ndarray, seed: int = 0) -> None:
        """Goes over ``windows`` (each WINDOW + 1 classes, padded with -1) once, in an order drawn from ``seed``.

        A step takes a fiftieth of the windows that this learner has met, 32 at least and 512 at most, so first steps are
        small and many whatever the input, and how windows come in batches doesn't matter.
        """
        order, i = np.random.default_rng(seed).permutation(len(windows)), 0
        while i < len(order):
            part = windows[order[i : i + min(max(self.windows // 50, 32), 512)]]
            i += len(part)
            self.windows += len(part)
            self.steps += 1
            step = np.float32(self.rate * min(1.0, self.steps / 20) / (1 + self.steps / 400) ** 0.5)
            for k, g in gradients(self.w, prior, np.maximum(part[:, :-1], 0), part[:, 1:]).items():
                m, s, square = self.m[k], self.s[k], g * g
                square -= s
                square *= np.float32(0.01)
                s += square
                g -= m
                g *= np.float32(0.1)
                m += g
                np.sqrt(s, out=square)
                square *= np.float32((1 - 0.99**self.steps) ** -0.5)
                square += np.float32(1e-8)
                np.divide(m, square, out=square)
                square *= step / np.float32(1 - 0.9**self.steps)
                self.w[k] -= square


def training_windows(classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All windows of texts of ``n`` classes: WINDOW targets with the class before the first, each target in one window."""
    start, many = np.cumsum(n) - n, -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), many)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
    at = first[:, None] + np.arange(-1, WINDOW)
    out = classes[np.clip(start[text][:, None] + at, 0, max(len(classes) - 1, 0))]
    out[at >= n[text][:, None]] = -1
    out[at < 0] = CLASSES
    return out


def cut_windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``n`` targets: the text and the first target of each window; windows after the first repeat CONTEXT."""
    step = WINDOW - CONTEXT
    many = 1 + np.maximum(0, -(-(n - WINDOW) // step))
    text = np.repeat(np.arange(len(n)), many)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * step


def log_likelihoods(w: dict[str, np.ndarray], prior: Prior, classes: np.ndarray, n: np.ndarray, batch: int = 1024) -> np.ndarray:
    """The log-likelihood of every class of the texts (one after another, ``n`` each) given those before it.

    Each class is scored once, in the window where it has the longest context; padding is masked by position, as
    windows are padded at their end only. Of windows after a text's first, only positions that are scored are asked for.
    """
    start = np.cumsum(n) - n
    text, first = cut_windows(n)
    table, place, _ = projected(w)
    shifted = np.r_[CLASSES, classes, np.zeros(WINDOW, np.int64)]  # the class before each class; beyond the end, padding
    shifted[start] = CLASSES
    begin, left = start[text] + first, n[text] - first
    out, span = np.zeros(len(classes), np.float32), np.arange(WINDOW)
    for skip, rows in ((0, np.flatnonzero(first == 0)), (CONTEXT, np.flatnonzero(first))):
        for b in range(0, len(rows), batch):
            r = rows[b : b + batch]
            at = begin[r, None] + span
            h = np.concatenate([attended(table, place, shifted[at[i : i + _CHUNK]], skip)[-1] for i in range(0, len(r), _CHUNK)])
            asked = np.flatnonzero(span[skip:] < left[r, None])
            where = at[:, skip:].ravel()[asked]
            order = np.argsort((classes[where] // BRANCH).astype(np.uint8), kind="stable")
            asked, where = asked[order], where[order]
            out[where] = sum(got - np.log(s) for _, s, got, _, _ in choices(w, prior, h.reshape(-1, WIDTH).take(asked, axis=0), shifted[where], classes[where]))
    return out.astype(np.float64)

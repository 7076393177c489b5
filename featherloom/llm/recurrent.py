"""A gated recurrent language model in numpy: forward, truncated backpropagation, Adam.

A state of HIDDEN numbers is carried along a text by a gated recurrent unit.
The next symbol's probability is that of its class times that of the symbol in
its class. Symbols are numbered by falling frequency and classes are runs of
them, so a class of frequent symbols is small. Texts of a batch lie back to back
in lanes that are worked off side by side, window by window; a text's state
goes on from window to window and starts anew with the text. Biases start at the
logarithms of frequencies and the other output weights at 0: an untrained model
is the unigram model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, CLASSES = 16, 32
#: Lanes at most, and steps of a window: gradients reach back so far.
LANES, WINDOW = 512, 24
#: A pass over a few texts takes fewer lanes, so that it has about so many windows all the same.
STEPS = 64
#: Fixed constants of Adam.
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
#: Weights of the output are held to HELD, so that no exponential of a sum over HIDDEN of them overflows.
BOUND, HELD = 60.0, 3.0


def class_starts(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First symbol of each class, and the number of symbols: classes have alike
    shares of the square roots of the counts, which are falling."""
    share = np.cumsum(np.sqrt(counts))
    of = np.minimum((np.r_[0.0, share[:-1]] / share[-1] * classes).astype(int), classes - 1)
    return np.r_[np.flatnonzero(np.r_[True, np.diff(of) != 0]), len(counts)]


def new_model(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights for symbols with these positive, falling counts."""
    starts, rng = class_starts(counts, classes), np.random.default_rng(seed)
    mass = np.add.reduceat(counts, starts[:-1])
    w = {
        "table": rng.normal(0, 0.3, (len(counts), 3 * hidden)), "back": rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)), "bias": np.repeat([1.0, 0.0, 0.0], hidden),
        "class_w": np.zeros((len(mass), hidden)), "class_b": np.log(mass / mass.sum()), "word_w": np.zeros((len(counts), hidden)), "word_b": np.log(counts / np.repeat(mass, np.diff(starts))),
    }
    return {k: v.astype(np.float32) for k, v in w.items()} | {"starts": starts}


WEIGHTS = ("table", "back", "bias", "class_w", "class_b", "word_w", "word_b")


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in WEIGHTS])


def shaped(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """The weights ``x`` in the shapes of ``w``."""
    ends = np.cumsum([w[k].size for k in WEIGHTS])
    return {k: x[e - w[k].size : e].reshape(w[k].shape) for k, e in zip(WEIGHTS, ends, strict=True)} | {"starts": w["starts"]}


def lanes(lengths: np.ndarray, most: int = LANES) -> list[np.ndarray]:
    """Texts dealt over lanes of alike length, longest lane first. There are as
    many lanes as leave none much longer than the longest text."""
    n = int(np.clip(lengths.sum() // max(1, lengths.max(initial=1)), min(32, len(lengths)), most))
    n = max(1, min(n, len(lengths)))
    order = np.argsort(-lengths, kind="stable")
    total, own = np.zeros(n, np.int64), [[] for _ in range(n)]
    for i in range(0, len(order), n):  # the longest of the next n texts goes to the shortest lane
        some = order[i : i + n]
        to = np.argsort(total, kind="stable")[: len(some)]
        total[to] += lengths[some]
        for k, t in zip(to.tolist(), some.tolist(), strict=True):
            own[k].append(t)
    return [np.array(own[k]) for k in np.argsort(-total, kind="stable")]


def windows(texts: list[np.ndarray], steps: int = WINDOW, most: int = LANES) -> Iterator[tuple[np.ndarray, ...]]:
    """(previous symbol, symbol, is first of its text, text's number, is there),
    each steps x lanes. Texts have a symbol at least; before the first is symbol 0."""
    if not texts:
        return
    own = lanes(np.array([len(t) for t in texts]), most)
    length = np.array([sum(len(texts[i]) for i in lane) for lane in own])
    ends = np.cumsum(length)
    y = np.concatenate([texts[i] for lane in own for i in lane]).astype(np.int32)
    sizes = np.array([len(texts[i]) for lane in own for i in lane])
    of = np.repeat(np.concatenate(own), sizes).astype(np.int32)
    first = np.zeros(len(y), bool)
    first[np.cumsum(sizes) - sizes] = True
    x = np.where(first, 0, np.r_[np.int32(0), y[:-1]]).astype(np.int32)
    t = 0
    while t < length[0]:
        n = int((length > t).sum())
        k = int(min(length[0] - t, max(steps, min(16 * steps, steps * most // (2 * n)))))  # a few lanes take longer windows
        at = (ends - length)[None, :n] + np.arange(t, t + k)[:, None]
        there = at < ends[None, :n]
        at = np.minimum(at, len(y) - 1)
        yield x[at], y[at], first[at], of[at], there
        t += k


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, BOUND, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each step, and with ``keep`` what the way back needs: gates, and states before each step."""
    k, n, m = len(x), x.shape[1], w["back"].shape[0]
    kind = w["back"].dtype
    out = np.empty((k, n, m), kind)
    gates, before = (np.empty((k, n, 4 * m), kind), np.empty((k, n, m), kind)) if keep else (None, None)
    for t in range(k):
        if first[t].any():
            h = np.where(first[t][:, None], kind.type(0), h)
        if keep:
            before[t] = h
        a = w["table"].take(x[t], 0)
        a += w["bias"]
        g = h @ w["back"]
        a[:, : 2 * m] += g[:, : 2 * m]
        zr = _sigmoid(a[:, : 2 * m].copy())
        z, r = zr[:, :m], zr[:, m:]
        c = r * g[:, 2 * m :]
        c += a[:, 2 * m :]
        np.tanh(c, out=c)
        s = h - c
        s *= z
        s += c
        out[t] = h = s
        if keep:
            gates[t, :, :m], gates[t, :, m : 2 * m], gates[t, :, 2 * m : 3 * m], gates[t, :, 3 * m :] = z, r, c, g[:, 2 * m :]
    return out, gates, before


def _runs_of_classes(starts: np.ndarray, y: np.ndarray):
    of = np.searchsorted(starts, y, "right") - 1
    order = np.argsort(of.astype(np.int16), kind="stable")
    edge = np.searchsorted(of[order], np.arange(len(starts)))
    return of, order, edge


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithms of the probabilities of symbols ``y`` after states
    ``h``; adds to ``grad`` the sums of their losses' gradients and gives those by state."""
    starts = w["starts"]
    of, order, edge = _runs_of_classes(starts, y)
    rows = np.arange(len(y))
    e = h @ w["class_w"].T
    e += w["class_b"]
    own = e[rows, of]
    np.exp(e, out=e)
    total = e.sum(1)
    out = own - np.log(total)
    back = None
    if grad is not None:
        e /= total[:, None]
        e[rows, of] -= 1
        grad["class_w"] += e.T @ h
        grad["class_b"] += e.sum(0)
        back = e @ w["class_w"]
    hs, ys = h[order], y[order]
    for c in range(len(starts) - 1):
        i, j, lo, hi = edge[c], edge[c + 1], starts[c], starts[c + 1]
        if i == j or hi - lo == 1:
            continue
        x, at = hs[i:j], ys[i:j] - lo
        e = x @ w["word_w"][lo:hi].T
        e += w["word_b"][lo:hi]
        some = np.arange(j - i)
        own = e[some, at]
        np.exp(e, out=e)
        total = e.sum(1)
        out[order[i:j]] += own - np.log(total)
        if grad is not None:
            e /= total[:, None]
            e[some, at] -= 1
            grad["word_w"][lo:hi] += e.T @ x
            grad["word_b"][lo:hi] += e.sum(0)
            back[order[i:j]] += e @ w["word_w"][lo:hi]
    return out, back


def score(w: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each whole text's probability."""
    total = np.zeros(len(texts))
    h = None
    for x, y, first, of, there in windows(texts):
        h = np.zeros((x.shape[1], w["back"].shape[0]), np.float32) if h is None else h[: x.shape[1]]
        s, *_ = states(w, x, first, h)
        h = s[-1]
        got, _ = log_probabilities(w, s[there], y[there])
        total += np.bincount(of[there], weights=got, minlength=len(texts))
    return total


def _way_back(w, x, first, before, gates, dh_out, grad) -> None:
    """Adds the gradients of a window's recurrent weights, from those by state."""
    k, n, m = len(x), x.shape[1], w["back"].shape[0]
    da, dg = np.empty((k, n, 3 * m), before.dtype), np.empty((k, n, 3 * m), before.dtype)
    dh = np.zeros((n, m), before.dtype)
    for t in range(k - 1, -1, -1):
        dh += dh_out[t]
        z, r, c, g = (gates[t, :, i * m : (i + 1) * m] for i in range(4))
        one = 1 - z
        dc = dh * one
        dc *= 1 - c * c
        dz = dh * (before[t] - c)
        dz *= z * one
        da[t, :, :m] = dz
        np.multiply(dc * g, r * (1 - r), out=da[t, :, m : 2 * m])
        da[t, :, 2 * m :] = dc
        dg[t, :, : 2 * m] = da[t, :, : 2 * m]
        np.multiply(dc, r, out=dg[t, :, 2 * m :])
        dh = dh * z + dg[t] @ w["back"].T
        dh[first[t]] = 0
    flat_a, flat_x = da.reshape(-1, 3 * m), x.ravel()
    grad["back"] += before.reshape(-1, m).T @ dg.reshape(-1, 3 * m)
    grad["bias"] += flat_a.sum(0)
    order = np.argsort(flat_x.astype(np.int16) if len(w["table"]) < 1 << 15 else flat_x, kind="stable")
    where = np.flatnonzero(np.r_[True, np.diff(flat_x[order]) != 0])
    grad["table"][flat_x[order][where]] += np.add.reduceat(flat_a[order], where, 0)


def train(w: dict[str, np.ndarray], texts: list[np.ndarray], rate: float, adam: dict | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """One pass of truncated backpropagation, a step of Adam a window. A window
    that is not full takes a step shorter in proportion."""
    v = flat(w)
    adam = adam or {"m": np.zeros_like(v), "v": np.zeros_like(v), "t": 0}
    w = shaped(w, v)
    grads = np.zeros_like(v)
    grad = {}
    at = 0
    for k in WEIGHTS:  # parts of one array
        grad[k] = grads[at : at + w[k].size].reshape(w[k].shape)
        at += w[k].size
    h, full = None, None
    most = int(np.clip(sum(map(len, texts)) // (WINDOW * STEPS), 16, LANES))
    for x, y, first, _, there in windows(texts, most=most):
        h = np.zeros((x.shape[1], w["back"].shape[0]), np.float32) if h is None else h[: x.shape[1]]
        s, gates, before = states(w, x, first, h, keep=True)
        h = s[-1]
        grads[:] = 0
        _, by_state = log_probabilities(w, s[there], y[there], grad)
        dh = np.zeros(s.shape, np.float32)
        dh[there] = by_state
        _way_back(w, x, first, before, gates, dh, grad)
        n = int(there.sum())
        full = max(full or 1, n)
        grads /= n
        adam["t"] += 1
        adam["m"] += (1 - BETA1) * (grads - adam["m"])
        adam["v"] += (1 - BETA2) * (grads * grads - adam["v"])
        step = rate * n / full * np.sqrt(1 - BETA2 ** adam["t"]) / (1 - BETA1 ** adam["t"])
        v -= np.float32(step) * adam["m"] / (np.sqrt(adam["v"]) + TINY)
        w = shaped(w, v)
        for k in ("class_w", "word_w"):
            np.clip(w[k], -HELD, HELD, out=w[k])
    return w, adam

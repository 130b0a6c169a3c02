"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

The vocabulary is WORDS frequent tokens, the end of a text among them, in classes of PER_CLASS by falling frequency;
id 0 stands for every other token and is a class by itself. The probability of a token is that of its class times,
within the class, that of the token. Texts run side by side in slots; a slot's state is carried from
window to window until its text ends, so a whole text is scored whatever its length.

Arrays are flat, time by time and, within a time, slot by slot; slots are ordered so that those in use come first.
"""

from __future__ import annotations

import heapq

import numpy as np

WORDS, PER_CLASS, HIDDEN = 2048, 64, 24
CLASSES = WORDS // PER_CLASS
BLOCK = 4096  # parameters per row where models are averaged
#: x and u hold the update gate, the reset gate and the candidate state.
SHAPES = {"x": (3, WORDS + 1, HIDDEN), "u": (3, HIDDEN, HIDDEN), "wc": (HIDDEN, CLASSES + 1), "bc": (CLASSES + 1,), "ww": (CLASSES, HIDDEN, PER_CLASS), "bw": (CLASSES, PER_CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
STEPS = 64  # steps that a pass over few tokens makes at least, by using fewer slots
PIECE = 1024  # tokens of a text that training takes as one run; scoring takes the whole text as one
_TOP = 80.0  # exp of a logit stays finite in 32 bits


def initial(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights, and output biases that make the untrained model the unigram model of counts (WORDS + 1)."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    logs = np.log(np.maximum(counts, 0.5))
    by_class = logs[1:].reshape(CLASSES, PER_CLASS)
    p["bw"] = (by_class - by_class.max(1, keepdims=True)).astype(np.float32)
    p["bc"] = np.concatenate((logs[:1], np.log(np.exp(by_class - by_class.max()).sum(1)) + by_class.max())).astype(np.float32)
    p["bc"] -= p["bc"].max()
    p["ww"] *= 0.1
    p["wc"] *= 0.1
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def views(v: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one flat array."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    return views(np.array(v, np.float32))


class Slots:
    """Texts (arrays of ids, each ending with the end token) laid side by side, longest first, in up to n slots.

    y, x: token and token before; new: whether a text starts; text: its index; time t is at[t]:at[t + 1].
    """

    def __init__(self, texts: list[np.ndarray], n: int, end: int):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        n = max(1, min(n, len(texts)))
        heap, rows = [(0, s) for s in range(n)], [[] for _ in range(n)]
        for i in np.argsort(-lens, kind="stable").tolist():
            used, s = heapq.heappop(heap)
            rows[s].append(i)
            heapq.heappush(heap, (used + len(texts[i]), s))
        rows.sort(key=lambda r: -sum(len(texts[i]) for i in r))
        used = np.array([sum(len(texts[i]) for i in r) for r in rows], np.int64)
        self.n, self.size, total = n, int(used[0]), int(used.sum())
        self.active = n - np.searchsorted(used[::-1], np.arange(self.size), "right")
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        self.y, self.x = np.empty(total, np.int16), np.empty(total, np.int16)
        self.new, self.text = np.zeros(total, bool), np.empty(total, np.int32)
        for k, row in enumerate(rows):
            if not row:
                continue
            place, y = self.at[: used[k]] + k, np.concatenate([texts[i] for i in row])
            starts = np.concatenate(([0], np.cumsum(lens[row])[:-1]))
            x = np.concatenate(([end], y[:-1]))
            x[starts] = end
            self.y[place], self.x[place], self.text[place] = y, x, np.repeat(row, lens[row])
            self.new[place[starts]] = True


def _sigmoid(a: np.ndarray) -> None:
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


class Run:
    """States of one window, and what the way back needs: state before, gates z and r, the candidate's recurrent part g, candidate c, state after h."""

    def __init__(self, n: int, dtype=np.float32):
        self.prev, self.z, self.r, self.g, self.c, self.h, self._a = (np.empty((n, HIDDEN), dtype) for _ in range(7))

    def forward(self, p, x: np.ndarray, new: np.ndarray, actives: list[int], h: np.ndarray) -> np.ndarray:
        """The state after the last time, for the slots then in use. h: the state before the first."""
        (xz, xr, xc), (uz, ur, uc) = p["x"], p["u"]
        i, starts = 0, new.any()
        for n in actives:
            j = i + n
            prev, z, r, g, c, out, a, ids = (*(v[i:j] for v in (self.prev, self.z, self.r, self.g, self.c, self.h, self._a)), x[i:j])
            prev[...] = h[:n]
            if starts and new[i:j].any():
                prev[new[i:j]] = 0
            for w, u, to in ((xz, uz, z), (xr, ur, r)):
                np.matmul(prev, u, out=to)
                to += np.take(w, ids, 0, out=a, mode="clip")
                _sigmoid(to)
            np.matmul(prev, uc, out=g)
            np.multiply(r, g, out=c)
            c += np.take(xc, ids, 0, out=a, mode="clip")
            np.tanh(c, out=c)
            np.subtract(prev, c, out=out)
            out *= z
            out += c
            i, h = j, out
        return h


def _softmax(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised probabilities (in the place of the logits), their sums, and the log-probability of column ``at`` of each row."""
    np.minimum(logits, _TOP, out=logits)
    picked = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    np.maximum(sums, 1e-30, out=sums)
    return sums, picked - np.log(sums)


def _classes(y: np.ndarray) -> np.ndarray:
    return np.where(y == 0, 0, (y - 1) // PER_CLASS + 1)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that gathers tokens by class, those of class 0 left out, and (class, from, to) of each class in it."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")  # a radix sort
    cuts = np.searchsorted(cls[order], np.arange(1, CLASSES + 2))
    return order[cuts[0] :], [(k, cuts[k] - cuts[0], cuts[k + 1] - cuts[0]) for k in range(CLASSES) if cuts[k + 1] > cuts[k]]


def log_probs(p, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of each y after state h."""
    cls = _classes(y)
    logits = h @ p["wc"]
    logits += p["bc"]
    out = _softmax(logits, cls)[1].astype(np.float64)
    order, spans = _by_class(cls)
    hs, at = h[order], (y[order] - 1) % PER_CLASS
    inner = np.empty(len(order))
    for k, i, j in spans:
        w = hs[i:j] @ p["ww"][k]
        w += p["bw"][k]
        inner[i:j] = _softmax(w, at[i:j])[1]
    out[order] += inner
    return out


def score(p, texts: list[np.ndarray], end: int, slots: int = 512, window: int = 32) -> np.ndarray:
    """log10 probability of each text, ids with the end token last."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    s = Slots(texts, slots, end)
    run, h = Run(int(s.active[0]) * min(window, s.size), p["u"].dtype), np.zeros((s.n, HIDDEN), p["u"].dtype)
    for t in range(0, s.size, window):
        actives = s.active[t : t + window].tolist()
        i, j = int(s.at[t]), int(s.at[min(t + window, s.size)])
        h = run.forward(p, s.x[i:j], s.new[i:j], actives, h).copy()
        total += np.bincount(s.text[i:j], log_probs(p, run.h[: j - i], s.y[i:j]), len(texts))
    return total / np.log(10)


def gradients(p, x, y, new, actives: list[int], h0, g: dict[str, np.ndarray] | None = None, run: Run | None = None):
    """Loss sum, gradients of it, and the last state, over one window; nothing flows back before its start."""
    dtype, m = p["u"].dtype, len(y)
    g = {k: np.empty(s, dtype) for k, s in SHAPES.items()} if g is None else g
    run = Run(m, dtype) if run is None else run
    last = run.forward(p, x, new, actives, h0)
    hs, cls = run.h[:m], _classes(y)
    # output: the gradient of a softmax's logits is its probabilities, less one at the token
    pc = hs @ p["wc"]
    pc += p["bc"]
    sums, logs = _softmax(pc, cls)
    loss = -float(logs.sum())
    pc *= (1 / sums)[:, None]
    pc[np.arange(m), cls] -= 1
    np.matmul(hs.T, pc, out=g["wc"])
    np.matmul(np.ones(m, dtype), pc, out=g["bc"])
    dh_out = pc @ p["wc"].T
    g["ww"][...], g["bw"][...] = 0, 0
    order, spans = _by_class(cls)
    inner, at = hs[order], (y[order] - 1) % PER_CLASS
    back = np.empty_like(inner)
    for k, i, j in spans:
        pw = inner[i:j] @ p["ww"][k]
        pw += p["bw"][k]
        sums, logs = _softmax(pw, at[i:j])
        loss -= float(logs.sum())
        pw *= (1 / sums)[:, None]
        pw[np.arange(j - i), at[i:j]] -= 1
        np.matmul(inner[i:j].T, pw, out=g["ww"][k])
        np.matmul(np.ones(j - i, dtype), pw, out=g["bw"][k])
        np.matmul(pw, p["ww"][k].T, out=back[i:j])
    dh_out[order] += back
    # recurrence: what doesn't depend on the gradient of the state, for all times at once
    prev, z, r, c = run.prev[:m], run.z[:m], run.r[:m], run.c[:m]
    to_c = (1 - z) * (1 - c * c)
    to_z = (prev - c) * z * (1 - z)
    to_r = run.g[:m] * r * (1 - r)
    dz, dr, dc, dg = (np.empty((m, HIDDEN), dtype) for _ in range(4))
    dh = np.zeros((actives[0], HIDDEN), dtype)
    uz, ur, uc = (np.ascontiguousarray(u.T) for u in p["u"])
    j, starts = m, new.any()
    for n in reversed(actives):
        i = j - n
        d = dh_out[i:j]
        d += dh[:n]
        np.multiply(d, to_z[i:j], out=dz[i:j])
        np.multiply(d, to_c[i:j], out=dc[i:j])
        np.multiply(dc[i:j], to_r[i:j], out=dr[i:j])
        np.multiply(dc[i:j], r[i:j], out=dg[i:j])
        d *= z[i:j]
        d += dz[i:j] @ uz
        d += dr[i:j] @ ur
        d += dg[i:j] @ uc
        if starts and new[i:j].any():
            d[new[i:j]] = 0
        dh[:n] = d
        j = i
    for k, d in enumerate((dz, dr, dg)):
        np.matmul(prev.T, d, out=g["u"][k])
    order = np.argsort(x.astype(np.uint16), kind="stable")
    ids = x[order]
    cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    g["x"][...] = 0
    for k, d in enumerate((dz, dr, dc)):
        g["x"][k][ids[cuts]] = np.add.reduceat(d[order], cuts, 0)
    return loss, g, last


def train(p, texts: list[np.ndarray], end: int, rate: float, slots: int = 512, window: int = 24) -> dict[str, np.ndarray]:
    """One pass of Adam over the texts, with backpropagation cut at each window's start."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    total = sum(map(len, pieces))
    w = flat(p).astype(np.float32)
    if not total:
        return unflat(w)
    s = Slots(pieces, max(8, min(slots, total // (window * STEPS))), end)
    g, m, v, tmp = (np.zeros(SIZE, np.float32) for _ in range(4))
    now, grads = views(w), views(g)
    run, h = Run(int(s.active[0]) * min(window, s.size)), np.zeros((s.n, HIDDEN), np.float32)
    for step, t in enumerate(range(0, s.size, window), 1):
        i, j = int(s.at[t]), int(s.at[min(t + window, s.size)])
        h = gradients(now, s.x[i:j], s.y[i:j], s.new[i:j], s.active[t : t + window].tolist(), h, grads, run)[2].copy()
        g *= 1 / (j - i)
        np.clip(g, -0.05, 0.05, out=g)
        m *= 0.9
        m += np.multiply(g, 0.1, out=tmp)
        v *= 0.99
        g *= g
        v += np.multiply(g, 0.01, out=tmp)
        np.sqrt(v, out=tmp)
        tmp *= 1 / np.sqrt(1 - 0.99**step)
        tmp += 1e-6
        np.divide(m, tmp, out=tmp)
        tmp *= rate / (1 - 0.9**step)
        w -= tmp
    return unflat(w)

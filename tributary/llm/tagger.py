"""A character tagger in numpy: bidirectional LSTM with CRF transitions.

Windows of characters get one tag each (outside, or begin / inside of a kind).
``train`` fits the weights to labelled spans by Adam on the CRF's likelihood;
``decode`` returns the best-scoring tags of each window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begin, 2 + 2k inside
HIDDEN = 16
_NEVER = np.float32(-1e4)

#: Symbols: small letters in four groups, capitals, digits, marks of personal data one by one, other marks, blanks, the rest, padding.
_MARKS = "@.-+()[]_ /,:"
SYMBOLS = 12 + len(_MARKS)
SYMBOL = np.full(128, 6, np.uint8)
for _c in range(128):
    _s = chr(_c)
    if _s in _MARKS:
        SYMBOL[_c] = 12 + _MARKS.index(_s)
    elif _s.isdigit():
        SYMBOL[_c] = 5
    elif _s.isspace():
        SYMBOL[_c] = 7
    elif _s in "at":
        SYMBOL[_c] = 1
    elif _s in "do":
        SYMBOL[_c] = 2
    elif _s.islower():
        SYMBOL[_c] = 3
    elif _s.isupper():
        SYMBOL[_c] = 4
PADDING, OTHER = 0, 8


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of code points."""
    return np.where(codes < 128, SYMBOL[np.minimum(codes, 127)], OTHER).astype(np.int64)


def _allowed() -> np.ndarray:
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = _NEVER
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


ALLOWED = _allowed()
_ONE = np.eye(SYMBOLS, dtype=np.float32)
_FIRST = np.array([0] + [0, _NEVER] * len(KINDS), np.float32)


@dataclass
class Weights:
    into: np.ndarray  # 2 x SYMBOLS x 4 HIDDEN: what a symbol adds to the gates, bias included
    again: np.ndarray  # 2 x HIDDEN x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN x TAGS
    bias: np.ndarray
    move: np.ndarray  # TAGS x TAGS

    def all(self) -> list[np.ndarray]:
        return [self.into, self.again, self.out, self.bias, self.move]


def initial(seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *n, s: (rng.standard_normal(n) * s).astype(np.float32)
    w = Weights(draw(2, SYMBOLS, 4 * HIDDEN, s=0.5), draw(2, HIDDEN, 4 * HIDDEN, s=HIDDEN**-0.5), draw(2 * HIDDEN, TAGS, s=0.2), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    w.into[:, :, HIDDEN : 2 * HIDDEN] += 1  # begin by remembering
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _run(into, again, x, keep: bool):
    """Hidden states (time, batch, HIDDEN) of one direction, and what the way back needs."""
    steps, n = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    hs, saved = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = into[x[t]] + h @ again
        ifo = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        y = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, y))
        h = o * y
        hs[t] = h
    return hs, saved


def emissions(w: Weights, x: np.ndarray, keep: bool = False):
    """Scores (time, batch, TAGS) for windows x (time, batch)."""
    ahead, s1 = _run(w.into[0], w.again[0], x, keep)
    back, s2 = _run(w.into[1], w.again[1], x[::-1], keep)
    both = np.concatenate((ahead, back[::-1]), axis=2)
    return both @ w.out + w.bias, (both, s1, s2)


def _back(again, x, saved, grad, into_grad):
    """Gradient of one direction: fills into_grad, returns that of the recurrent weights."""
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(dh)
    d_again = np.zeros_like(again)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, y = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - y * y)
        dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * y * o * (1 - o), dc * i * (1 - g * g)), axis=1)
        into_grad += _ONE[x[t]].T @ dz
        d_again += h.T @ dz
        dh = dz @ again.T
        dc = dc * f
    return d_again


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def _step(w: Weights, x: np.ndarray, y: np.ndarray):
    """Mean loss of windows x with tags y (time, batch), and the gradients."""
    e, (both, s1, s2) = emissions(w, x, keep=True)
    steps, n = x.shape
    move = w.move + ALLOWED
    left = np.empty_like(e)
    left[0] = e[0] + _FIRST
    for t in range(1, steps):
        left[t] = e[t] + _logsum(left[t - 1][:, :, None] + move, 1)
    right = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        right[t] = _logsum(move + (e[t + 1] + right[t + 1])[:, None, :], 2)
    total = _logsum(left[-1], 1)
    rows = np.arange(n)
    de = np.exp(left + right - total[:, None])
    d_move = np.zeros_like(w.move)
    loss = total.sum() - _FIRST[y[0]].sum()
    for t in range(steps):
        loss -= e[t, rows, y[t]].sum()
        de[t, rows, y[t]] -= 1
        if t:
            p = np.exp(left[t - 1][:, :, None] + move + (e[t] + right[t])[:, None, :] - total[:, None, None])
            d_move += p.sum(0)
            np.add.at(d_move, (y[t - 1], y[t]), -1)
            loss -= move[y[t - 1], y[t]].sum()
    d_out = np.tensordot(both, de, axes=((0, 1), (0, 1)))
    d_both = de @ w.out.T
    d_into = np.zeros_like(w.into)
    d_again = np.stack([_back(w.again[0], x, s1, d_both[:, :, :HIDDEN], d_into[0]), _back(w.again[1], x[::-1], s2, d_both[::-1, :, HIDDEN:], d_into[1])])
    return loss / n, [g / n for g in (d_into, d_again, d_out, de.sum((0, 1)), d_move)]


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 5, batch: int = 192, rate: float = 0.03, seed: int = 3) -> Weights:
    """Weights fitted to windows x with tags y (each window a row)."""
    w = initial(seed)
    rng = np.random.default_rng(seed)
    mean = [np.zeros_like(p) for p in w.all()]
    square = [np.zeros_like(p) for p in w.all()]
    steps = rounds * (len(x) // batch)
    t = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x) - batch + 1, batch):
            at = order[a : a + batch]
            _, grads = _step(w, x[at].T, y[at].T)
            t += 1
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            pace = rate * (1 - 0.9 * t / max(1, steps))
            for p, g, m, v in zip(w.all(), grads, mean, square, strict=True):
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def decode(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags of windows x (each a row), and each character's score over being outside."""
    e, _ = emissions(w, x.T)
    steps, n = x.shape[1], x.shape[0]
    move = w.move + ALLOWED
    best = e[0] + _FIRST
    came = np.zeros((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        ways = best[:, :, None] + move
        came[t] = ways.argmax(1)
        best = ways.max(1) + e[t]
    tags = np.zeros((steps, n), np.int64)
    tags[-1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t, rows, tags[t]]
    gain = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
    return tags.T, gain.T

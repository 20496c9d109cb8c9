"""A linear-chain conditional random field over numpy arrays, many chains at a time."""

from __future__ import annotations

import numpy as np

#: Chains are worked on in pieces of this length, side by side. What one piece hands to the next is carried over exactly.
PIECE = 2048


def chains(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of chains that cover sequences of ``lengths`` laid end to end, none over ``most`` items."""
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // most)
    which = np.repeat(np.arange(len(lengths)), n)
    at = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * most
    return starts[which] + at, np.minimum(most, lengths[which] - at)


def _normed(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _carried(e: np.ndarray, m: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each piece gets from the pieces before it (alpha of the item ahead) and after it (beta of its last item).

    A piece acts on either by a product of one matrix for each of its items, made for all pieces at once; the pieces of a
    chain are then passed through one by one.
    """
    k = e.shape[1]
    before, after = np.ones((len(starts), k), e.dtype), np.ones((len(starts), k), e.dtype)
    long = np.flatnonzero(~(first & last))
    if not len(long):
        return before, after
    order = long[np.argsort(-lengths[long], kind="stable")]
    acts = np.tile(np.eye(k, dtype=e.dtype), (len(order), 1, 1))
    for t in range(int(lengths[order[0]])):
        n = int(np.searchsorted(-lengths[order], -t, side="left"))
        rows = starts[order[:n]] + t
        into = np.where((first[order[:n]] & (t == 0))[:, None, None], np.eye(k, dtype=e.dtype), m)
        a = (acts[:n] @ into) * e[rows][:, None, :]
        acts[:n] = a / a.max(axis=(1, 2), keepdims=True)
    act = dict(zip(order.tolist(), acts, strict=True))
    for p in long.tolist():
        if not last[p]:
            before[p + 1] = _normed((before[p] if not first[p] else np.ones(k, e.dtype)) @ act[p])
    for p in long[::-1].tolist():
        if not first[p]:
            after[p - 1] = _normed(act[p] @ after[p])
    return before, after


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, counts: bool = False, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each item, and (with ``counts``) the expected number of each transition.

    ``scores``: items by labels, in logs, of chains of ``lengths`` laid end to end. Pieces of all chains run side by side
    from the longest to the shortest, each step scaled.
    """
    starts, sizes = chains(lengths, piece)
    first = np.isin(starts, (np.cumsum(lengths) - lengths)[lengths > 0])
    last = np.append(first[1:], True)[: len(first)]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    m = np.exp(trans).astype(e.dtype)
    before, after = _carried(e, m, starts, sizes, first, last)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, first, last, before, after = starts[order], sizes[order], first[order], last[order], before[order], after[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # pieces longer than t
    alpha = np.empty_like(e)
    prev = before
    for t, k in enumerate(active.tolist()):
        rows = starts[:k] + t
        ahead = prev[:k] @ m
        if t == 0:
            ahead[first] = 1
        alpha[rows] = prev = _normed(ahead * e[rows])
    gamma = np.empty_like(e)
    expected = np.zeros_like(m)
    beta = after.copy()
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        rows = starts[:k] + t
        nxt = active[t + 1] if t + 1 < len(active) else 0
        if nxt:
            ahead = e[rows[:nxt] + 1] * beta[:nxt]
            if counts:
                expected += _pairs(alpha[rows[:nxt]], m, ahead)
            beta[:nxt] = _normed(ahead @ m.T)
        gamma[rows] = _normed(alpha[rows] * beta[:k])
    if counts and not last.all():  # transitions between pieces: beta is now that of each piece's first item
        at = np.flatnonzero(~first)
        expected += _pairs(alpha[starts[at] - 1], m, e[starts[at]] * beta[at])
    return gamma, expected


def _pairs(left: np.ndarray, m: np.ndarray, right: np.ndarray) -> np.ndarray:
    pair = left[:, :, None] * m[None] * right[:, None, :]
    return (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)

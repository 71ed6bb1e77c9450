"""Scaled forward and backward recursions over many sequences at once.

Sequences are given longest first by their start in ``e`` and their size (at least 1), so that step t works on the
leading sequences only, those that have a place t. Places are dealt out by step before the recursions (``by_step``),
so that a step reads and writes one slice; memory is that of ``e`` and no padding is made.
"""

from __future__ import annotations

import numpy as np


def longest_first(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(-sizes, kind="stable")


def by_step(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of step, the sequence of each, and how many sequences have each step."""
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    step = np.repeat(np.arange(len(active)), active)
    sequence = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
    return starts[sequence] + step, sequence, active


def forward_steps(e: np.ndarray, active: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward weights and scales of places in order of step; first: start weights, shared or a row for each sequence."""
    alpha, scale, ones = np.empty_like(e), np.empty(len(e), e.dtype), np.ones(e.shape[1], e.dtype)
    trans, first = trans.astype(e.dtype, copy=False), first.astype(e.dtype, copy=False)
    lo, before = 0, None
    for n in active.tolist():
        now = alpha[lo : lo + n]
        np.multiply(first if before is None else before[:n] @ trans, e[lo : lo + n], out=now)
        s = scale[lo : lo + n] = now @ ones
        now /= s[:, None]
        lo, before = lo + n, now
    return alpha, scale


def backward_steps(e: np.ndarray, active: np.ndarray, trans: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Turns ``alpha`` into marginals, and returns the expected transitions."""
    expected, hi = np.zeros(trans.shape), len(e)
    trans = trans.astype(e.dtype, copy=False)
    b = np.ones((0, e.shape[1]), e.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        lo = hi - n
        if len(b) < n:
            b = np.concatenate([b, np.ones((n - len(b), e.shape[1]), e.dtype)])
        alpha[lo:hi] *= b
        if t:
            m = e[lo:hi] * b
            m /= scale[lo:hi, None]
            expected += trans * (alpha[lo - int(active[t - 1]) :][:n].T @ m)
            b = m @ trans.T
        hi = lo
    alpha /= alpha.sum(axis=1, keepdims=True)
    return expected


def forward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence; first: start weights, shared or a row for each sequence."""
    place, sequence, active = by_step(starts, sizes)
    return np.bincount(sequence, np.log(forward_steps(e[place], active, trans, first)[1]), len(starts))


def forward_backward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each place, expected transitions, natural log-likelihood of each sequence."""
    place, sequence, active = by_step(starts, sizes)
    dealt = e[place]
    alpha, scale = forward_steps(dealt, active, trans, first)
    expected = backward_steps(dealt, active, trans, alpha, scale)
    gamma = np.empty_like(alpha)
    gamma[place] = alpha
    return gamma, expected, np.bincount(sequence, np.log(scale), len(starts))

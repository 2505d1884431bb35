"""Reverse-mode gradients of the few array operations that the networks use.

A ``Var`` remembers how its value was made; ``backward`` walks that graph once.  Values
are NumPy arrays of the rows that one task has at hand, so everything here is a helper
of ``training.gradient_step``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Var:
    """A value, its gradient, and (input, function of the gradient) for each input."""

    __slots__ = ("value", "grad", "inputs")

    def __init__(self, value, inputs: Sequence[tuple[Var, Callable]] = ()):
        self.value, self.grad, self.inputs = np.asarray(value, np.float64), None, inputs

    @property
    def shape(self):
        return self.value.shape


def backward(out: Var) -> None:
    """Gradients of the sum of ``out`` in all that it was made of."""
    order, seen, stack = [], set(), [(out, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(x, False) for x, _ in v.inputs]
    out.grad = np.ones_like(out.value)
    for v in reversed(order):
        for x, pull in v.inputs:
            g = pull(v.grad)
            x.grad = g if x.grad is None else x.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which its input was repeated."""
    if g.shape == shape:
        return g
    if len(shape) == 1 and g.shape[-1:] == shape:
        return np.ones(g.size // shape[0]) @ g.reshape(-1, shape[0])  # faster than a sum over the rows
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and g.shape[i] > 1), keepdims=True).reshape(shape)


def add(a: Var, b: Var) -> Var:
    return Var(a.value + b.value, [(a, lambda g: _fit(g, a.shape)), (b, lambda g: _fit(g, b.shape))])


def multiply(a: Var, b: Var) -> Var:
    return Var(a.value * b.value, [(a, lambda g: _fit(g * b.value, a.shape)), (b, lambda g: _fit(g * a.value, b.shape))])


def matmul(a: Var, b: Var) -> Var:
    """Matrix product over the last two axes; earlier axes of ``b`` may be missing."""
    if a.value.ndim > 2 and b.value.ndim == 2:  # one product of all rows, not one a row
        rows = lambda x: x.reshape(-1, x.shape[-1])
        out = (rows(a.value) @ b.value).reshape(*a.shape[:-1], b.shape[-1])
        return Var(out, [(a, lambda g: (rows(g) @ b.value.T).reshape(a.shape)), (b, lambda g: rows(a.value).T @ rows(g))])
    turn = lambda x: np.swapaxes(x, -1, -2)
    return Var(a.value @ b.value, [(a, lambda g: _fit(g @ turn(b.value), a.shape)), (b, lambda g: _fit(turn(a.value) @ g, b.shape))])


def transpose(a: Var, axes: Sequence[int]) -> Var:
    back = np.argsort(axes)
    return Var(a.value.transpose(axes), [(a, lambda g: g.transpose(back))])


def reshape(a: Var, shape: Sequence[int]) -> Var:
    return Var(a.value.reshape(shape), [(a, lambda g: g.reshape(a.shape))])


def concat(parts: Sequence[Var]) -> Var:
    """Along the last axis."""
    ends = np.cumsum([0, *[p.shape[-1] for p in parts]])
    return Var(np.concatenate([p.value for p in parts], -1), [(p, lambda g, i=i: g[..., ends[i] : ends[i + 1]]) for i, p in enumerate(parts)])


def stack(parts: Sequence[Var]) -> Var:
    """Along a new second axis."""
    return Var(np.stack([p.value for p in parts], 1), [(p, lambda g, i=i: g[:, i]) for i, p in enumerate(parts)])


def pick(a: Var, i: int) -> Var:
    """Element ``i`` of the second axis."""

    def pull(g):
        out = np.zeros_like(a.value)
        out[:, i] = g
        return out

    return Var(a.value[:, i], [(a, pull)])


def tanh(a: Var) -> Var:
    out = np.tanh(a.value)
    return Var(out, [(a, lambda g: g * (1 - out * out))])


def relu(a: Var) -> Var:
    return Var(np.maximum(a.value, 0), [(a, lambda g: g * (a.value > 0))])


def softmax(a: Var) -> Var:
    """Over the last axis."""
    e = np.exp(a.value - a.value.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return Var(p, [(a, lambda g: p * (g - (g * p).sum(-1, keepdims=True)))])


def layer_norm(a: Var, scale: Var, shift: Var, eps: float = 1e-5) -> Var:
    """Rows brought to mean 0 and variance 1, scaled and shifted."""
    mean = a.value.mean(-1, keepdims=True)
    spread = 1 / np.sqrt(a.value.var(-1, keepdims=True) + eps)
    z = (a.value - mean) * spread

    def pull(g):
        return spread * (g - g.mean(-1, keepdims=True) - z * (g * z).mean(-1, keepdims=True))

    return add(multiply(Var(z, [(a, pull)]), scale), shift)


def segments(a: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; ``ptr`` are the first rows of the segments and the end, empty ones give 0."""
    out = np.zeros((len(ptr) - 1, *a.shape[1:]))
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(a, ptr[:-1][full], axis=0)
    return out


def segment_softmax(a: Var, ptr: np.ndarray) -> Var:
    """Softmax of a column over consecutive rows."""
    own = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    top = np.full((len(ptr) - 1, *a.shape[1:]), -np.inf)
    np.maximum.at(top, own, a.value)
    e = np.exp(a.value - top[own])
    p = e / segments(e, ptr)[own]
    return Var(p, [(a, lambda g: p * (g - segments(g * p, ptr)[own]))])


def segment_sum(a: Var, ptr: np.ndarray) -> Var:
    own = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    return Var(segments(a.value, ptr), [(a, lambda g: g[own])])


def log_loss(logit: Var, label: np.ndarray, weight: np.ndarray) -> Var:
    """Weighted sum of the negative log-likelihoods of 0/1 labels."""
    z = logit.value
    loss = np.maximum(z, 0) - z * label + np.log1p(np.exp(-np.abs(z)))
    return Var((loss * weight).sum(), [(logit, lambda g: g * weight * (sigmoid(z) - label))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))

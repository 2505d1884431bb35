"""The networks: a scorer of pairs by their paths, one of nodes by their metapaths, and a residual head.

A network names its parameters with their shapes and maps a batch to a logit per row.
A batch holds arrays: ``x`` by input name (rows by width) and ``paths`` by schema name
((pointers, rows by summed width)).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from . import gradients as G
from .gradients import Var

Batch = dict
Params = Mapping[str, Var]
Shapes = dict[str, tuple[int, ...]]


def linear_shapes(name: str, width: int, out: int) -> Shapes:
    return {f"{name}.w": (width, out), f"{name}.b": (out,)}


def norm_shapes(name: str, width: int) -> Shapes:
    return {f"{name}.scale": (width,), f"{name}.shift": (width,)}


def linear(p: Params, name: str, x: Var) -> Var:
    return G.add(G.matmul(x, p[f"{name}.w"]), p[f"{name}.b"])


def norm(p: Params, name: str, x: Var) -> Var:
    return G.layer_norm(x, p[f"{name}.scale"], p[f"{name}.shift"])


def encoder_shapes(name: str, width: int) -> Shapes:
    out: Shapes = {}
    for part in ("query", "key", "value", "out", "in2", "out2"):
        out |= linear_shapes(f"{name}.{part}", width, width)
    return out | norm_shapes(f"{name}.norm1", width) | norm_shapes(f"{name}.norm2", width)


def encoder(p: Params, name: str, x: Var, heads: int = 1) -> Var:
    """A transformer layer over the second axis of (rows, places, width).

    Places attend to each other by learned queries, keys and values in several heads;
    sum and norm; two dense layers; sum and norm.
    """
    rows, places, width = x.shape
    split = lambda part: G.transpose(G.reshape(linear(p, f"{name}.{part}", x), (rows, places, heads, width // heads)), (0, 2, 1, 3))
    q, k, v = split("query"), split("key"), split("value")
    scores = G.multiply(G.matmul(q, G.transpose(k, (0, 1, 3, 2))), Var((width // heads) ** -0.5))
    mixed = G.reshape(G.transpose(G.matmul(G.softmax(scores), v), (0, 2, 1, 3)), (rows, places, width))
    x = norm(p, f"{name}.norm1", G.add(x, linear(p, f"{name}.out", mixed)))
    dense = linear(p, f"{name}.out2", G.relu(linear(p, f"{name}.in2", x)))
    return norm(p, f"{name}.norm2", G.add(x, dense))


def residual_shapes(name: str, width: int, hidden: int, out: int, blocks: int, depth: int) -> Shapes:
    shapes = linear_shapes(f"{name}.prepare", width, hidden)
    for b in range(blocks):
        for d in range(depth):
            shapes |= linear_shapes(f"{name}.{b}.{d}", hidden, hidden) | norm_shapes(f"{name}.{b}.{d}", hidden)
        shapes |= norm_shapes(f"{name}.{b}", hidden)
    return shapes | linear_shapes(f"{name}.last", hidden, out)


def residual(p: Params, name: str, x: Var, blocks: int, depth: int) -> Var:
    """Dense layers with a way around each block: tanh(x + dense...dense(x)), normed."""
    x = linear(p, f"{name}.prepare", x)
    for b in range(blocks):
        y = x
        for d in range(depth):
            y = norm(p, f"{name}.{b}.{d}", G.tanh(linear(p, f"{name}.{b}.{d}", y)))
        x = norm(p, f"{name}.{b}", G.tanh(G.add(x, y)))
    return linear(p, f"{name}.last", x)


@dataclass(frozen=True)
class PathScorer:
    """Pairs by their end nodes and all their paths.

    ``widths``: features of each node or edge type; ``start``, ``end``: types of the pair's
    nodes; ``schemas``: the types along each path.  Nodes are projected by type; a
    path is its encoded places, projected; a pair's paths of a schema are weighed by a
    softmax of attention from (first place, path, last place); the schemas influence each other in one
    encoder; ends and schemas give the logit.
    """

    widths: Mapping[str, int]
    start: str
    end: str
    schemas: Mapping[str, Sequence[str]]
    hidden: int = 16
    heads: int = 1

    def shapes(self) -> Shapes:
        h = self.hidden
        out: Shapes = norm_shapes("norm", h)
        for t, n in self.widths.items():
            out |= linear_shapes(f"project.{t}", n, h)
        for s, types in self.schemas.items():
            out |= encoder_shapes(f"path.{s}", h) | linear_shapes(f"path.{s}.project", len(types) * h, h) | linear_shapes(f"path.{s}.attention", 3 * h, 1)
        return out | encoder_shapes("mutual", h) | linear_shapes("predict", h * (2 + len(self.schemas)), 1)

    def logit(self, p: Params, batch: Batch) -> Var:
        embed = lambda x: G.tanh(norm(p, "norm", x))
        project = lambda t, x: embed(linear(p, f"project.{t}", x if isinstance(x, Var) else Var(x)))
        first, last = project(self.start, batch["x"]["start"]), project(self.end, batch["x"]["end"])
        schemas = []
        for s, types in self.schemas.items():
            ptr, flat = batch["paths"][s]
            if not len(flat):
                schemas.append(Var(np.zeros((len(ptr) - 1, self.hidden))))
                continue
            ends = np.cumsum([0, *[self.widths[t] for t in types]])
            places = [project(t, flat[:, a:b]) for t, a, b in zip(types, ends[:-1], ends[1:])]
            coded = encoder(p, f"path.{s}", G.stack(places), self.heads)
            path = embed(linear(p, f"path.{s}.project", G.reshape(coded, (len(flat), len(types) * self.hidden))))
            weight = G.segment_softmax(G.tanh(linear(p, f"path.{s}.attention", G.concat([places[0], path, places[-1]]))), ptr)
            schemas.append(G.segment_sum(G.multiply(weight, path), ptr))
        mixed = embed(encoder(p, "mutual", G.stack(schemas), self.heads))
        rows = mixed.shape[0]
        every = G.concat([first, last, G.reshape(mixed, (rows, len(self.schemas) * self.hidden))])
        return G.reshape(linear(p, "predict", every), (rows,))


@dataclass(frozen=True)
class MetapathScorer:
    """Nodes by the mean features of their metapaths.

    Features are transformed by type in a residual net, attend to each other over
    the metapaths in an encoder of several heads, and give the logit through another residual net.
    """

    widths: Mapping[str, int]
    metapaths: Mapping[str, str]  # name: type of its features
    hidden: int = 16
    heads: int = 1
    layers: int = 1
    blocks: int = 1
    depth: int = 2

    def shapes(self) -> Shapes:
        h, out = self.hidden, {}
        for t, n in self.widths.items():
            out |= residual_shapes(f"transform.{t}", n, h, h, self.blocks, self.depth)
        out |= linear_shapes("enter", h, h)
        for k in range(self.layers):
            out |= encoder_shapes(f"layer.{k}", h)
        return out | linear_shapes("leave", h * len(self.metapaths), h) | residual_shapes("head", h, h, 1, self.blocks, self.depth)

    def logit(self, p: Params, batch: Batch) -> Var:
        x = G.stack([residual(p, f"transform.{t}", Var(batch["x"][m]), self.blocks, self.depth) for m, t in self.metapaths.items()])
        x = linear(p, "enter", x)
        for k in range(self.layers):
            x = encoder(p, f"layer.{k}", x, self.heads)
        rows = x.shape[0]
        x = linear(p, "leave", G.reshape(x, (rows, len(self.metapaths) * self.hidden)))
        return G.reshape(residual(p, "head", x, self.blocks, self.depth), (rows,))


@dataclass(frozen=True)
class ResidualScorer:
    """Rows of features by a residual net."""

    inputs: Mapping[str, int] = field(default_factory=dict)  # name: width
    hidden: int = 16
    blocks: int = 1
    depth: int = 2

    def shapes(self) -> Shapes:
        return residual_shapes("net", sum(self.inputs.values()), self.hidden, 1, self.blocks, self.depth)

    def logit(self, p: Params, batch: Batch) -> Var:
        x = np.concatenate([batch["x"][i] for i in self.inputs], -1)
        return G.reshape(residual(p, "net", Var(x), self.blocks, self.depth), (len(x),))


def unpack(shapes: Shapes, flat: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters by name from one row of numbers, in the order of ``shapes``."""
    ends = np.cumsum([0, *[int(np.prod(s)) for s in shapes.values()]])
    return {n: flat[a:b].reshape(s) for (n, s), a, b in zip(shapes.items(), ends[:-1], ends[1:])}


def first_weights(net, seed: int = 0) -> np.ndarray:
    """Random matrices by the widths they join, zero shifts, unit scales; as one row of numbers."""
    rng, parts = np.random.default_rng(seed), []
    for name, shape in net.shapes().items():
        if len(shape) == 2:
            parts.append(rng.uniform(-1, 1, shape).ravel() * (6 / sum(shape)) ** 0.5)
        else:
            parts.append(np.full(shape, 1.0 if name.endswith(".scale") else 0.0))
    return np.concatenate(parts)


def loss_and_gradient(net, flat: np.ndarray, batch: Batch, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The batch's summed loss and its gradient in all parameters."""
    p = {n: Var(v) for n, v in unpack(net.shapes(), flat).items()}
    loss = G.log_loss(net.logit(p, batch), label, weight)
    G.backward(loss)
    return float(loss.value), np.concatenate([(v.grad if v.grad is not None else np.zeros_like(v.value)).ravel() for v in p.values()])

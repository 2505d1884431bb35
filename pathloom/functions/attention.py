"""Segment softmax and weighted neighbour sums: the aggregations of attention models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import TIME
from ..sources.io import stored

_STEP = 16.0


def segment_softmax(df: DataFrame, segment: Sequence[str], score: str, name: str = "attention") -> DataFrame:
    """exp(s - max) / sum within each segment.

    Sums are partial aggregates joined back, so that a large segment is not one
    task's window.  They are taken per segment and step of the score, relative to the
    step, and then brought to the highest step: one pass over the rows, and no overflow.
    """
    step = F.floor(F.col(score) / _STEP)
    parts = df.groupBy(*segment, step.alias("__k")).agg(F.sum(F.exp(F.col(score) - step * _STEP)).alias("__z"))
    tops = parts.groupBy(*segment).agg(F.max("__k").alias("__m"), F.collect_list(F.struct("__k", "__z")).alias("__l"))  # a few steps a segment
    total = F.aggregate("__l", F.lit(0.0), lambda a, x: a + x["__z"] * F.exp((x["__k"] - F.col("__m")) * _STEP))
    sums = tops.withColumn("__t", total).drop("__l")
    return df.join(sums, list(segment)).withColumn(name, F.exp(F.col(score) - F.col("__m") * _STEP) / F.col("__t")).select(*df.columns, name)


def weighted_sum(df: DataFrame, segment: Sequence[str], weight: str, features: Sequence[str]) -> DataFrame:
    """Sum of weight times feature within each segment."""
    return df.groupBy(*segment).agg(*[F.sum(F.col(weight) * F.col(f)).alias(f) for f in features])


def attend(df: DataFrame, segment: Sequence[str], score: str, features: Sequence[str]) -> DataFrame:
    """Softmax-weighted means within each segment."""
    return weighted_sum(segment_softmax(df, segment, score, "__a"), segment, "__a", features)


def path_mean(columns: Sequence[Sequence[str]], names: Sequence[str]):
    """Mean, feature by feature, over the nodes of a path (null nodes are skipped)."""
    out = []
    for cols, name in zip(columns, names):
        n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        out.append(F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)), n).alias(name))
    return out


def heads(df: DataFrame, segment: Sequence[str], scores: Sequence[str], features: Sequence[Sequence[str]]) -> DataFrame:
    """Multi-head attention by destination: head k weighs its own features by its own scores."""
    out = None
    for score, own in zip(scores, features, strict=True):
        one = attend(df, segment, score, own)
        out = one if out is None else out.join(one, list(segment))
    return out


def residual(df: DataFrame, before: str, now: str, beta: float = 0.05):
    """Attention of a layer mixed with that of the layer before: (1 - beta) * now + beta * before; missing ones count as 0."""
    mixed = F.lit(1 - beta) * F.coalesce(F.col(now), F.lit(0.0)) + F.lit(beta) * F.coalesce(F.col(before), F.lit(0.0))
    return df.withColumn(now, mixed)


def semantic(df: DataFrame, node: Sequence[str], metapath: str, features: Sequence[str], score) -> DataFrame:
    """One embedding per node from those of its metapaths.

    The weight of a metapath is the softmax, over metapaths, of the mean over nodes of
    ``score`` (a Column over the features): one weight per metapath for all nodes.
    """
    means = df.groupBy(metapath).agg(F.avg(score).alias("__w"))
    weights = segment_softmax(means.withColumn("__all", F.lit(1)), ["__all"], "__w", "__a").select(metapath, "__a")
    return df.join(weights, metapath).groupBy(*node).agg(*[F.sum(F.col("__a") * F.col(f)).alias(f) for f in features])


def self_attention(df: DataFrame, node: Sequence[str], metapath: str, features: Sequence[str]) -> DataFrame:
    """Each node's metapath embeddings attend to each other: x_i + sum over j of softmax(x_i . x_j / sqrt(width)) x_j.

    A node has a row per metapath, so its pairs are as few as metapaths squared.
    """
    other = df.select(*node, F.col(metapath).alias("__j"), *[F.col(f).alias(f"__o_{f}") for f in features])
    pairs = df.join(other, list(node))
    dot = sum((F.col(f) * F.col(f"__o_{f}") for f in features), F.lit(0.0)) / (len(features) ** 0.5)
    weighed = segment_softmax(pairs.withColumn("__s", dot), [*node, metapath], "__s", "__a")
    return weighed.groupBy(*node, metapath).agg(*[(F.first(f) + F.sum(F.col("__a") * F.col(f"__o_{f}"))).alias(f) for f in features])


def relation_mean(df: DataFrame, node: Sequence[str], relation: str, score: str, features: Sequence[str]) -> DataFrame:
    """Attention within each (node, relation), then the mean over relations."""
    own = attend(df, [*node, relation], score, features)
    return own.groupBy(*node).agg(*[F.avg(f).alias(f) for f in features])


def l2_normalized(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows scaled to length 1 (zero rows stay)."""
    norm = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    return df.withColumns({f: F.coalesce(F.try_divide(F.col(f), norm), F.lit(0.0)) for f in features})


def top_attention(df: DataFrame, segment: Sequence[str], weight: str, n: int) -> DataFrame:
    """The n rows of largest weight in each segment."""
    w = Window.partitionBy(*segment).orderBy(F.col(weight).desc())
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


@dataclass(frozen=True)
class Gat:
    """Weights of one relation's attention: a linear map, what scores (near, far), and a shift of the result."""

    linear: Sequence[Sequence[float]]  # a row per output
    shift: Sequence[float]
    near: Sequence[float]
    far: Sequence[float]
    score_shift: float = 0.0
    bias: Sequence[float] | None = None

    def map(self, columns: Sequence[str]) -> list[Column]:
        return [sum((F.lit(float(w)) * F.col(c) for w, c in zip(row, columns, strict=True)), F.lit(float(b))) for row, b in zip(self.linear, self.shift, strict=True)]


def hop_edges(edges: DataFrame, relations: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Edges of ``paths.subgraph`` that were followed from their heads, as (hop, relation, near_type, near, far_type, far, month)."""
    kind = lambda k: F.coalesce(*[F.when(F.col("relation") == n, F.lit(t[k])) for n, t in relations.items()])
    return edges.select("hop", "relation", kind(0).alias("near_type"), F.col("Head").alias("near"), kind(1).alias("far_type"), F.col("Tail").alias("far"), TIME)


def layered(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, features: Sequence[str], layers: Sequence[Mapping[str, tuple[str, Gat]]]) -> DataFrame:
    """Embeddings of the seeds, from the last hop to the first: (node_type, node, month, features).

    ``edges``: the rows of ``hop_edges``; ``nodes``: (node_type, node, month, features) of all
    nodes; ``seeds``: (node_type, node, month); ``layers``: by hop, each relation's near
    type and weights.  What a hop gives for a node is the mean of the node's own features and, for each
    relation of its type, the attention over the embeddings that the hop after it gave to the
    node's neighbours; a relation without neighbours counts as 0 plus its bias.

    A hop is one join on either side of its edges and partial sums; the nodes' features, a hop's nodes and its
    scored edges are stored, so none is computed again for another join or for the hop before.
    """
    key = ["node_type", "node", TIME]
    nodes = stored(nodes.select(*key, *features))
    own = lambda level: level.join(nodes, key, "left").select(*key, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    level = lambda h: seeds.select(*key).distinct() if h == 0 else edges.where(F.col("hop") == h - 1).select(F.col("far_type").alias("node_type"), F.col("far").alias("node"), TIME).distinct()
    below = own(level(len(layers)))
    for h in range(len(layers) - 1, -1, -1):
        here = stored(own(level(h)))
        near, far = [f"__near_{f}" for f in features], [f"__far_{f}" for f in features]
        joined = edges.where(F.col("hop") == h).drop("hop")
        joined = joined.join(here.withColumnsRenamed({"node_type": "near_type", "node": "near"} | dict(zip(features, near))), ["near_type", "near", TIME])
        joined = joined.join(below.withColumnsRenamed({"node_type": "far_type", "node": "far"} | dict(zip(features, far))), ["far_type", "far", TIME])
        parts = []
        for relation, (_, gat) in layers[h].items():
            a, b = gat.map(near), gat.map(far)
            score = F.tanh(sum((F.lit(float(w)) * c for w, c in zip((*gat.near, *gat.far), (*a, *b), strict=True)), F.lit(float(gat.score_shift))))
            parts.append(joined.where(F.col("relation") == relation).select("relation", F.col("near_type").alias("node_type"), F.col("near").alias("node"), TIME, score.alias("__s"), *[c.alias(f) for c, f in zip(b, features)]))
        scored = parts[0]
        for part in parts[1:]:
            scored = scored.unionAll(part)
        sums = attend(stored(scored), ["relation", *key], "__s", features).groupBy(*key).agg(*[F.sum(f).alias(f"__r_{f}") for f in features])
        kinds = {t for t, _ in layers[h].values()}
        mine = {t: [g for k, g in layers[h].values() if k == t] for t in kinds}
        count = F.coalesce(*[F.when(F.col("node_type") == t, F.lit(1.0 + len(g))) for t, g in mine.items()], F.lit(1.0))
        bias = lambda i: F.coalesce(*[F.when(F.col("node_type") == t, F.lit(float(sum((g.bias or [0.0] * len(features))[i] for g in gs)))) for t, gs in mine.items()], F.lit(0.0))
        below = here.join(sums, key, "left").select(*key, *[((F.col(f) + F.coalesce(F.col(f"__r_{f}"), F.lit(0.0)) + bias(i)) / count).alias(f) for i, f in enumerate(features)])
    return below

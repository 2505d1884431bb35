"""Examples, steps and the training loop.

Examples are rows: ``label``, an array of numbers per input, an array of arrays per path
schema.  A step reads one slice of the stored examples, computes the loss and its
gradient in every task with the weights that travel with it as one row of numbers, and
sums them: by task first, over groups of tasks next, and over the groups last.  What
reaches the driver is a row of the weights' size per 64 tasks.  Floating-point sums depend
on the order of tasks in the last digits only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics
from ..plans.schema import TIME, PathSchema
from ..sources.io import stored
from . import networks
from .gradients import Var, sigmoid

PAIR = ("start", "end", TIME)
GROUP = 64


def node_array(nodes: DataFrame, key: str, features: Sequence[str], name: str) -> DataFrame:
    """(key, month where there is one, array of the features), missing ones 0."""
    keys = [key, *([TIME] if TIME in nodes.columns else [])]
    return nodes.select(*keys, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias(name))


def _with_features(df: DataFrame, column: str, nodes: DataFrame, name: str, width: int) -> DataFrame:
    """``df`` with the feature array of the node in ``column``; zeros where it has none."""
    key = nodes.columns[0]
    on = [TIME] if TIME in nodes.columns else []
    own = nodes.withColumnsRenamed({key: "__n", nodes.columns[-1]: name}).withColumnRenamed("__n", column)
    return df.join(own, [column, *on], "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), width)))


def pair_examples(
    samples: DataFrame, paths: Mapping[str, tuple[PathSchema, DataFrame]], features: Mapping[str, tuple[DataFrame, int]], start: str, end: str, between: bool = False
) -> DataFrame:
    """(start, end, month, label, x_start, x_end, p_0, p_1, ...): a row per sample with all its paths' features.

    ``samples``: (start, end, month, Label); ``features``: by node type the result of
    ``node_array`` and its width.  A pair's paths meet in one row, so their number is
    bounded by the neighbour limits of the enumeration.  Paths are in the order of their nodes.
    ``between``: the paths connect samples only.

    All paths of a pair share its ends, whose features come from the pair's row; paths bring those of the nodes between.
    """
    out = samples.select(*PAIR, (F.col("Label") > 0).cast("double").alias("label"))
    out = _with_features(out, "start", features[start][0], "x_start", features[start][1])
    out = _with_features(out, "end", features[end][0], "x_end", features[end][1])
    for i, (schema, path) in enumerate(paths.values()):
        if (schema.node_types[0], schema.node_types[-1]) != (start, end):
            raise ValueError(f"pairs of {start}-{end} don't fit the path {schema.name}")
        nodes = [f"Node_{k}" for k in range(len(schema.node_types))]
        own = path.select(*nodes, TIME)
        if not between:
            keys = samples.select(*PAIR).distinct()
            own = own.join(keys.withColumnsRenamed({"start": "Node_0", "end": nodes[-1]}), ["Node_0", nodes[-1], TIME], "left_semi")
        inner = list(enumerate(schema.node_types))[1:-1]
        for k, t in inner:
            own = _with_features(own, nodes[k], features[t][0], f"__x{k}", features[t][1])
        x = F.concat(*[F.col(f"__x{k}") for k, _ in inner]) if inner else F.array().cast("array<double>")
        row = F.struct(*nodes[1:-1], x.alias("x"))
        packed = own.groupBy(F.col("Node_0").alias("start"), F.col(nodes[-1]).alias("end"), TIME).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"]).alias(f"p_{i}"))
        out = out.join(packed, list(PAIR), "left")
    whole = lambda p: F.transform(p, lambda x: F.concat("x_start", x, "x_end"))
    return out.select(*PAIR, "label", "x_start", "x_end", *[whole(f"p_{i}").alias(f"p_{i}") for i in range(len(paths))])


def slice_of(examples: DataFrame, n: int, seed: int = 0) -> Column:
    """The slice, of ``n``, that a hash of an example's keys gives."""
    keys = [c for c in examples.columns if not isinstance(examples.schema[c].dataType, T.ArrayType)]
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))


def folders(examples: DataFrame, part: Column, n: int) -> list[DataFrame]:
    """The examples, stored once, by their part (0 to n - 1); each is a folder of its own."""
    from ..sources.io import shared_folder

    at = shared_folder(examples.sparkSession)
    examples.withColumn("__slice", part.cast("long")).write.partitionBy("__slice").parquet(at)
    read = examples.sparkSession.read.schema(T.StructType([*examples.schema.fields, T.StructField("__slice", T.LongType())])).parquet(at)
    return [read.where(F.col("__slice") == k).drop("__slice") for k in range(n)]


def slices(examples: DataFrame, n: int, seed: int = 0) -> list[DataFrame]:
    """The examples, stored, in ``n`` slices by a hash of their keys."""
    return folders(examples, slice_of(examples, n, seed), n)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def batch_of(table: pa.RecordBatch, inputs: Mapping[str, int], paths: Mapping[str, int]) -> dict:
    """Arrays of a record batch: ``inputs`` and ``paths`` give the width of each by column name."""
    x = {n.removeprefix("x_"): _matrix(table.column(n), w) for n, w in inputs.items()}
    out = {"x": x, "paths": {}}
    for n, w in paths.items():
        column = table.column(n)
        sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        out["paths"][n] = ptr, _matrix(column.flatten(), w)
    return out


@dataclass(frozen=True)
class Layout:
    """Which columns of the examples feed a network: input columns and path columns with their widths, paths by schema."""

    inputs: Mapping[str, int]
    paths: Mapping[str, int]
    schemas: Mapping[str, str]  # schema: column

    @classmethod
    def of_pairs(cls, net: networks.PathScorer) -> Layout:
        names = {s: f"p_{i}" for i, s in enumerate(net.schemas)}
        widths = {names[s]: sum(net.widths[t] for t in types) for s, types in net.schemas.items()}
        return cls({"x_start": net.widths[net.start], "x_end": net.widths[net.end]}, widths, names)

    @classmethod
    def of_columns(cls, widths: Mapping[str, int]) -> Layout:
        return cls(dict(widths), {}, {})

    def batch(self, table: pa.RecordBatch) -> dict:
        out = batch_of(table, self.inputs, self.paths)
        out["paths"] = {s: out["paths"][c] for s, c in self.schemas.items()}
        return out


SUMS = "part long, rows double, loss double, gradient array<double>"


def _sums(part: int, rows: float, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(rows)]), pa.array([float(loss)]), pa.array([gradient.tolist()], pa.list_(pa.float64()))], names=["part", "rows", "loss", "gradient"])


def gradient_step(examples: DataFrame, net, layout: Layout, weights: np.ndarray, class_weight: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float, np.ndarray]:
    """(weight of the rows, summed loss, summed gradient) of all examples."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        rows, loss, total = 0.0, 0.0, np.zeros(len(weights))
        for table in batches:
            label = table.column("label").to_numpy()
            weight = np.where(label > 0, class_weight[1], class_weight[0])
            if len(label):
                own, gradient = networks.loss_and_gradient(net, weights, layout.batch(table), label, weight)
                rows, loss, total = rows + float(weight.sum()), loss + own, total + gradient
        yield _sums(TaskContext.get().partitionId(), rows, loss, total)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        gradient = table.column("gradient").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
        return pa.Table.from_batches([_sums(table.column("part")[0].as_py(), sum(table.column("rows").to_pylist()), sum(table.column("loss").to_pylist()), gradient)])

    per_task = examples.select("label", *layout.inputs, *layout.paths).mapInArrow(run, SUMS)
    groups = per_task.groupBy(F.expr(f"part div {GROUP}")).applyInArrow(merge, SUMS).collect()  # a row per 64 tasks
    groups.sort(key=lambda r: r.part)
    return sum(r.rows for r in groups), sum(r.loss for r in groups), np.sum([r.gradient for r in groups], axis=0) if groups else np.zeros(len(weights))


def scored(examples: DataFrame, net, layout: Layout, weights: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of the examples with ``score``, the probability of a link."""
    schema = T.StructType([*[examples.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches):
        for table in batches:
            p = {n: Var(v) for n, v in networks.unpack(net.shapes(), weights).items()}
            score = sigmoid(net.logit(p, layout.batch(table)).value) if table.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[table.column(c) for c in keep], pa.array(score)], names=[*keep, "score"])

    return examples.select(*dict.fromkeys([*keep, *layout.inputs, *layout.paths])).mapInArrow(run, schema)


@dataclass
class Adam:
    """Steps by running means of the gradient and of its square."""

    rate: float = 1e-2
    decay: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        a, b = self.decay
        self.steps += 1
        self.first, self.second = a * self.first + (1 - a) * gradient, b * self.second + (1 - b) * gradient**2
        up = self.first / (1 - a**self.steps)
        return weights - self.rate * up / (np.sqrt(self.second / (1 - b**self.steps)) + 1e-8)


@dataclass(frozen=True)
class Fitted:
    """A network with the weights of its best epoch, and (epoch, mean loss, validation AUC) of every epoch."""

    net: object
    layout: Layout
    weights: np.ndarray
    best_epoch: int
    history: tuple[tuple[int, float, float], ...]

    def score(self, examples: DataFrame, keep: Sequence[str]) -> DataFrame:
        return scored(examples, self.net, self.layout, self.weights, keep)


def class_weights(examples: DataFrame, positive_share: float | None) -> tuple[float, float]:
    """Weights of negatives and positives with which positives count for a share of the loss."""
    if positive_share is None:
        return 1.0, 1.0
    n, pos = examples.agg(F.count("*").alias("n"), F.sum("label").alias("p")).select("n", "p").first()
    if not pos or pos == n:
        return 1.0, 1.0
    return (1 - positive_share) * n / (n - pos), positive_share * n / pos


def fit(
    net, layout: Layout, train: DataFrame | Sequence[DataFrame], valid: DataFrame, epochs: int = 20, rounds: int = 5, patience: int = 3, rate: float = 1e-2, decay: float = 0.0,
    positive_share: float | None = None, seed: int = 0, start: np.ndarray | None = None,
) -> Fitted:
    """Train until the validation AUC has not risen for ``patience`` epochs; the best epoch's weights are kept.

    An epoch is ``rounds`` steps, each over one slice of the training examples, so a pass over all
    of them; ``decay`` is the weight decay, ``start`` the weights to go on from.  Where ``train`` is a
    list of slices, these and ``valid`` are stored already.
    """
    if isinstance(train, DataFrame):
        parts, valid = slices(train, rounds, seed), stored(valid)
    else:
        parts = list(train)
        train = reduce(DataFrame.unionByName, parts)
    balance = class_weights(train, positive_share)
    weights, adam = (networks.first_weights(net, seed) if start is None else start.copy()), Adam(rate)
    best, best_auc, best_epoch, history = weights, -1.0, -1, []
    for epoch in range(epochs):
        rows = loss = 0.0
        for part in parts:
            n, own, gradient = gradient_step(part, net, layout, weights, balance)
            if n:
                weights = adam.step(weights, gradient / n + decay * weights)
            rows, loss = rows + n, loss + own
        auc = metrics.auc(scored(valid, net, layout, weights, ["label"]), "label", "score").first().auc
        auc = 0.0 if auc is None else auc  # one class only
        history.append((epoch, loss / rows if rows else 0.0, auc))
        if auc > best_auc:
            best, best_auc, best_epoch = weights, auc, epoch
        elif epoch - best_epoch >= patience:
            break
    return Fitted(net, layout, best, best_epoch, tuple(history))

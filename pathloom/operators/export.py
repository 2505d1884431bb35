"""Index and matrix builders: dense ids, index edges, pair datasets, wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import TIME, PathSchema
from .aggregate import aggregate
from .limits import with_ordinal


def dense_index(nodes: DataFrame, keys: Sequence[str], name: str = "index") -> DataFrame:
    """Distinct keys with gapless 0-based indices in key order."""
    return with_ordinal(nodes.select(*keys).distinct(), list(keys), name)


def index_columns(df: DataFrame, columns: Mapping[str, DataFrame], suffix: str = "_index", time: str | None = TIME) -> DataFrame:
    """Each named column's index beside it; ``columns`` gives its (node[, month], index) table."""
    for c, index in columns.items():
        keys = [c, *([time] if time and time in index.columns else [])]
        node = next(x for x in index.columns if x not in ("index", time))
        df = df.join(index.withColumnsRenamed({node: c, "index": f"{c}{suffix}"}), keys)
    return df


def path_matrix(path: DataFrame, schema: PathSchema, indices: Mapping[str, DataFrame], ends_only: bool = False) -> DataFrame:
    """Paths as index columns: of both ends, distinct, or of every node of every complete path."""
    nodes = [f"Node_{i}" for i in range(len(schema.node_types))]
    if ends_only:
        nodes = [nodes[0], nodes[-1]]
    full = path.select(*nodes, TIME).dropna(subset=nodes)
    full = full.distinct() if ends_only else full
    types = dict(zip([f"Node_{i}" for i in range(len(schema.node_types))], schema.node_types))
    out = index_columns(full, {n: indices[types[n]] for n in nodes})
    return out.select(*[F.col(f"{n}_index").cast("long").alias(f"{n}_index") for n in nodes])


def mean_features(path: DataFrame, start: str, node: str, features: DataFrame, key: str, columns: Sequence[str], functions: Sequence[str] = ("AVG", "MIN", "MAX")) -> DataFrame:
    """Per start: aggregates of the features of the nodes at one place; missing values are skipped."""
    joined = path.join(features.withColumnRenamed(key, node), [node, *([TIME] if TIME in features.columns else [])], "left")
    return aggregate(joined, [start, TIME], columns, functions, fill=None)


def wide_table(targets: DataFrame, parts: Mapping[str, DataFrame], keys: Sequence[str], separator: str = "^", fill: float = 0) -> DataFrame:
    """Targets with the columns of several tables, named ``{part}{separator}{column}``."""
    out = targets
    for name, df in parts.items():
        cols = {c: f"{name}{separator}{c}" for c in df.columns if c not in keys}
        out = out.join(df.withColumnsRenamed(cols), list(keys), "left").fillna(fill, list(cols.values()))
    return out


def pair_dataset(samples: DataFrame, paths: Mapping[str, tuple[PathSchema, DataFrame]], keep_positive_starts: bool = True) -> dict[str, DataFrame]:
    """Pairs with dense ids, and for every schema its complete paths with their ``pair_id`` and ``path_id``."""
    pairs = samples.dropna(subset=["start", "end"])
    if keep_positive_starts:
        good = pairs.where("Label > 0").select("start", TIME).distinct()
        pairs = pairs.join(good, ["start", TIME], "left_semi")
    pairs = with_ordinal(pairs, ["start", "end", TIME], "pair_id")
    out = {"pairs": pairs}
    for name, (schema, df) in paths.items():
        nodes = [f"Node_{i}" for i in range(len(schema.node_types))]
        ids = pairs.select(F.col("start").alias("Node_0"), F.col("end").alias(schema.end), TIME, "pair_id")
        own = df.dropna(subset=nodes).join(ids, ["Node_0", schema.end, TIME])
        out[name] = with_ordinal(own, ["pair_id", *nodes], "path_id")
    return out


def slice_pairs(data: Mapping[str, DataFrame], start: int, end: int) -> dict[str, DataFrame]:
    """A batch of a pair dataset: pairs with ids in [start, end) and their paths, ids from 0."""
    inside = (F.col("pair_id") >= start) & (F.col("pair_id") < end)
    return {name: df.where(inside).withColumn("pair_id", F.col("pair_id") - start) for name, df in data.items()}


def subgraph_index(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Subgraph edges with the indices of both ends; ``index``: (node, month, index)."""
    head, tail = (index.select(F.col("node").alias(c), TIME, F.col("index").alias(f"{c}_index")) for c in ("Head", "Tail"))
    return edges.join(head, ["Head", TIME]).join(tail, ["Tail", TIME]).select("hop", "relation", "Head_index", "Tail_index", "Weight")


def label_or_missing(nodes: DataFrame, labels: DataFrame, keys: Sequence[str], label: str = "Label") -> DataFrame:
    """All nodes with their label, -1 where there is none."""
    return nodes.join(labels, list(keys), "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)

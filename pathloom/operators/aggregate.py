"""Aggregates along paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import TIME, EdgeSpec, NodeSpec
from .nodes import combine_nodes
from .paths import sample_path

#: Functions by the words that configurations use.
FUNCTIONS = {"AVG": F.avg, "SUM": F.sum, "MAX": F.max, "MIN": F.min}
NODE_FUNCTIONS, EDGE_FUNCTIONS = ("AVG", "MAX", "MIN"), ("AVG", "SUM", "MAX", "MIN", "COUNT")


def aggregate(df: DataFrame, keys: Sequence[str], features: Sequence[str], functions: Sequence[str] = EDGE_FUNCTIONS, fill: float | None = 0, count: str = "COUNT_All") -> DataFrame:
    """``{FN}_{feature}`` per key; missing values count as ``fill`` (None: are skipped)."""
    if unknown := set(functions) - {*FUNCTIONS, "COUNT"}:
        raise ValueError(f"unknown functions {sorted(unknown)}")
    filled = df if fill is None else df.fillna(fill, list(features))
    aggs = [FUNCTIONS[fn](f).alias(f"{fn}_{f}") for fn in functions if fn != "COUNT" for f in features]
    if "COUNT" in functions:
        aggs.append(F.count("*").alias(count))
    return filled.groupBy(*keys).agg(*aggs)


def chunks(features: Sequence[str], functions: Sequence[str], most: int = 300) -> list[list[str]]:
    """Features in runs whose aggregate columns are at most ``most``."""
    per = max(1, most // max(1, len([f for f in functions if f != "COUNT"])))
    return [list(features[i : i + per]) for i in range(0, len(features), per)]


def node_aggregate(
    spark: SparkSession, path: DataFrame, start: str, node: str, specs: Sequence[NodeSpec], functions: Sequence[str] = NODE_FUNCTIONS, times=None, fill: float | None = 0
) -> DataFrame:
    """Features of the nodes at one place of the paths, aggregated per start and month: a row per path instance counts."""
    target = path.select(F.col(start).alias("__start"), F.col(node).alias("__node"), TIME)
    nodes, features = combine_nodes(spark, specs, "__node", times, fill=None)
    joined = target.join(nodes, ["__node", *([TIME] if TIME in nodes.columns else [])], "left")
    return aggregate(joined, ["__start", TIME], features, functions, fill).withColumnRenamed("__start", start)


def edge_aggregate(path: DataFrame, start: str, features: Sequence[str] | None = None, functions: Sequence[str] = EDGE_FUNCTIONS) -> DataFrame:
    """Edge features along the paths, aggregated per start and month."""
    own = list(features) if features is not None else [c for c in path.columns if c.startswith(("Hop_", "Edge_Feat_"))]
    return aggregate(path, [start, TIME], own, functions)


def weight_stats(path: DataFrame, start: str, node: str, weight: str, functions: Sequence[str] = EDGE_FUNCTIONS, time: str | None = TIME) -> DataFrame:
    """Statistics per start of weights that are first summed per (start, node)."""
    keys = [start, *([time] if time and time in path.columns else [])]
    summed = path.groupBy(*keys, node).agg(F.sum(weight).alias(weight))
    return aggregate(summed, keys, [weight], functions)


def path_features(
    spark: SparkSession, edges: Sequence[EdgeSpec], nodes: dict[str, Sequence[NodeSpec]], functions: Sequence[str] = NODE_FUNCTIONS, times: Iterable[str] | None = None, target: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Sample a fixed path and aggregate each named node's features to its start."""
    path = sample_path(spark, edges, times, target)
    return {n: node_aggregate(spark, path, edges[0].head_name, n, specs, functions, times) for n, specs in nodes.items()}


def publish(df: DataFrame, keys: Sequence[str], features: Sequence[str], table: str, at: str, functions: Sequence[str] = EDGE_FUNCTIONS, summary: str | None = None, most: int = 300, root: str | None = None) -> list[str]:
    """Aggregate to one partition of an ORC table (several, ``_{first}_{last}``, beyond ``most`` columns) and its profile.

    Returns the names of the tables written; only the first has the row count.  ``root``: the
    folder below which new tables lie, as external ones.
    """
    from ..sources.io import create_orc_table, insert_partition
    from .nodes import profile

    spark, written = df.sparkSession, []
    where = lambda name: f"{root}/{name}" if root else None
    parts = chunks(features, functions, most)
    for i, own in enumerate(parts):
        fns = functions if i == 0 else [f for f in functions if f != "COUNT"]
        out = aggregate(df, keys, own, fns)
        first = sum(len(p) for p in parts[:i])
        name = table if len(parts) == 1 else f"{table}_{first}_{first + len(own) - 1}"
        create_orc_table(spark, name, dict(out.dtypes), at=where(name))
        insert_partition(out, name, at)
        written.append(name)
        if summary:
            made = profile(spark.table(name).where(F.col("dt") == at), [c for c in out.columns if c not in keys])
            create_orc_table(spark, f"{summary}_{i}", dict(made.dtypes), at=where(f"{summary}_{i}"))
            insert_partition(made, f"{summary}_{i}", at)
            written.append(f"{summary}_{i}")
    return written

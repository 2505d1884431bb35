"""Node feature tables: reading, combining, profiles and checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import numeric_columns
from ..plans.schema import TIME, NodeSpec
from ..sources.io import scan


def dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: the one with the smallest other values."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def read_nodes(spark: SparkSession, spec: NodeSpec, name: str, times: Iterable[str] | None = None, target: DataFrame | None = None, fill: float | None = 0) -> tuple[DataFrame, list[str]]:
    """(rows of (name, month, features), feature names), one row a node and month.

    With ``target`` (node and month rows) its rows are kept, all of them, and missing features are filled.
    """
    df = scan(spark, spec.table, spec.source, spec.time, times)
    df = df.withColumnsRenamed({spec.key: name} | ({spec.time: TIME} if spec.time and spec.time != TIME else {}))
    keys = [name, *([TIME] if spec.time else [])]
    features = list(spec.features) if spec.features is not None else numeric_columns(df, keys)
    df = dedup(df.select(*keys, *features), keys)
    if target is not None:
        df = target.join(df, [k for k in keys if k in target.columns], "left")
    return (df if fill is None else df.fillna(fill, features)), features


def combine_nodes(
    spark: SparkSession, specs: Sequence[NodeSpec], name: str, times: Iterable[str] | None = None, target: DataFrame | None = None, prefix: bool = True, fill: float | None = 0
) -> tuple[DataFrame, list[str]]:
    """Several node tables side by side: beside ``target`` by left joins, else by full outer joins."""
    tables, features = [], []
    for i, spec in enumerate(specs):
        df, own = read_nodes(spark, spec, name, times, fill=None)
        names = {f: f"Node_Table_{i}_{f}" if prefix else f for f in own}
        tables.append(df.withColumnsRenamed(names))
        features += names.values()
    keys = [c for c in (name, TIME) if c in tables[0].columns]
    if target is None:
        out = reduce(lambda a, b: a.join(b, keys, "outer"), tables)
    else:
        out = reduce(lambda a, b: a.join(b, keys, "left"), tables, target)
    return (out if fill is None else out.fillna(fill, features)), features


def profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n, min, max, mean, stddev) of each feature, in one pass."""
    aggs = [a for f in features for a in (F.count(f).alias(f"n|{f}"), F.min(f).cast("double").alias(f"lo|{f}"), F.max(f).cast("double").alias(f"hi|{f}"), F.avg(f).alias(f"mean|{f}"), F.stddev_samp(f).alias(f"sd|{f}"))]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), *[F.col(f"`{p}|{f}`").alias(n) for p, n in (("n", "n"), ("lo", "min"), ("hi", "max"), ("mean", "mean"), ("sd", "stddev"))]) for f in features]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def constant_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) of the features with one value only."""
    return profile(df, features).where("min = max").select("feature", F.col("min").alias("value"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have several rows, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def keep_latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")

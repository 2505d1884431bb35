"""Label tables: selection by time ranges, remapping, deduplication, negative budgets, months."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of, months_back
from ..plans.schema import TIME, LabelSpec
from ..sources.io import scan
from .edges import present
from .limits import random_key


def read_labels(spark: SparkSession, spec: LabelSpec, ranges: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(endpoints, Label, Source_Time, month, split): one row per endpoints, month and split, the largest label kept.

    Ranges are [from, to) of the event time; a row in several of them counts for each.
    """
    df = scan(spark, spec.table, spec.source, "dt", [spec.dt] if spec.dt else None)
    for c in spec.columns:
        df = df.where(present(df, c))
    if spec.limits:
        df = df.where(F.expr(spec.limits))
    time = F.col(spec.time)
    parts = []
    for name, (start, end) in ranges.items():
        own = df.where((time >= F.lit(start)) & (time < F.lit(end)))
        if name in spec.split_limits:
            own = own.where(F.expr(spec.split_limits[name]))
        parts.append(own.withColumn("split", F.lit(name)))
    df = reduce(lambda a, b: a.unionByName(b), parts)
    label = F.col(spec.label)
    if spec.label_map:
        label = reduce(lambda c, kv: c.when(F.col(spec.label) == kv[0], kv[1]), spec.label_map.items(), F).otherwise(label)
    df = df.select(*[F.col(c).alias(n) for c, n in zip(spec.columns, spec.names)], label.alias("Label"), time.cast("string").alias("Source_Time"), month_of(time).alias(TIME), "split")
    if spec.label_range is not None:
        df = df.where(F.col("Label").isin(list(spec.label_range)))
    best = df.groupBy(*spec.names, TIME, "split").agg(F.max(F.struct("Label", "Source_Time")).alias("__x"))
    df = best.select(*spec.names, F.col("__x.Label").alias("Label"), F.col("__x.Source_Time").alias("Source_Time"), TIME, "split")
    budgets = {s: spec.split_max_rows.get(s, spec.max_rows) for s in ranges}
    return downsample_negatives(df, budgets, list(spec.names)) if any(budgets.values()) else df


def label_targets(spec: LabelSpec, labels: DataFrame, name: str) -> DataFrame:
    """(node, month) that one endpoint of the labels needs features of: ``spec.months`` months that end with the label's."""
    own = labels.select(F.col(name), F.col(TIME).alias("__t")).distinct()
    return months_back(own, "__t", spec.months, TIME, "__back").select(name, TIME).distinct()


def downsample_negatives(df: DataFrame, budgets: Mapping[str, int | None], by: list[str], seed: int = 0) -> DataFrame:
    """All positives of each split, and its negatives thinned to the budget left by hash threshold."""
    counts = df.groupBy("split").agg(F.count_if(F.col("Label") > 0).alias("__p"), F.count_if(F.col("Label") <= 0).alias("__n"))
    budget = reduce(lambda c, kv: c.when(F.col("split") == kv[0], F.lit(kv[1])), budgets.items(), F).cast("long")
    share = F.when(budget.isNull(), 1.0).otherwise(F.least(F.greatest(F.coalesce(F.try_divide(budget - F.col("__p"), "__n"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    part = F.conv(F.substring(random_key(seed, [*by, TIME, "split"]), 1, 8), 16, 10).cast("long")
    out = df.join(F.broadcast(counts.select("split", share.alias("__f"))), "split")  # a row per split; dealt by split, its rows would meet in one task
    return out.where((F.col("Label") > 0) | (part < F.col("__f") * F.lit(1 << 32))).select(*df.columns)

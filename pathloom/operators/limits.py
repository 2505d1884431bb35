"""Samplers: neighbour limits, ordinals, Bernoulli and stratified samples.

Random orders are the md5 of a seed and the row's key columns, so a sample is
the same in every run and for every partitioning.  Top and random limits keep
``row_number() <= n``, which Spark turns into a group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import TIME, NeighborLimit
from ..sources.io import stored


def random_key(seed: int, columns: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def threshold_n(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of the keys that have at most ``n`` rows: hubs go whole.

    Counted by a partial aggregate and joined back, so that a hub's rows are
    never sorted in one task.
    """
    small = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") <= n).drop("__n")
    return df.join(small, list(keys), "left_semi").select(*df.columns)


def _first(df: DataFrame, keys: Sequence[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def random_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows a key; ``by`` are the columns that tell rows apart (all by default)."""
    by = list(by or df.columns)
    return _first(df, keys, [random_key(seed, by), *[F.col(c) for c in by]], n)


def top_n(df: DataFrame, keys: Sequence[str], n: int, features: Sequence[str], seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows a key with the largest features; ties in random order."""
    by = list(by or df.columns)
    return _first(df, keys, [*[F.col(c).desc() for c in features], random_key(seed, by), *[F.col(c) for c in by]], n)


def rank_n(df: DataFrame, keys: Sequence[str], n: int, weight: str) -> DataFrame:
    """Rows of rank ``n`` at most by descending weight: ties are all kept."""
    w = Window.partitionBy(*keys).orderBy(F.col(weight).desc())
    return df.withColumn("__k", F.rank().over(w)).where(F.col("__k") <= n).drop("__k")


def apply_limit(df: DataFrame, keys: Sequence[str], limit: NeighborLimit | None, by: Sequence[str] | None = None) -> DataFrame:
    """A neighbour limit over ``keys`` (and the month, unless the limit spans months)."""
    if limit is None:
        return df
    keys = [*keys, TIME] if limit.by_time and TIME in df.columns and TIME not in keys else list(keys)
    if limit.kind == "threshold":
        return threshold_n(df, keys, limit.n)
    if limit.kind == "random":
        return random_n(df, keys, limit.n, limit.seed, by)
    return top_n(df, keys, limit.n, limit.features, limit.seed, by)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in the order of ``order``, stored, with ``__part`` (number of the range) and ``__place`` (in the range).

    Both are values of the stored rows, so every later plan sees the same ones.  A
    hash of the row settles ties and spreads them over ranges.
    """
    keys = [*[F.col(c) if isinstance(c, str) else c for c in order], F.xxhash64(*df.columns)]
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at)
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)})
    return stored(rows.drop("__at"))


def with_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Gapless 0-based places in the order of ``order``, without a one-task sort.

    A place is the number of rows in the lower ranges (a row per range) and the place in the own one.
    """
    rows = ranged(df, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__place")).select(*df.columns, name)


def with_running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Running sums in the order of ``order``: new column name to summed column, the row itself included."""
    rows = ranged(df, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__z_{new}") for new, c in sums.items()])
    starts = per.select("__part", *[F.coalesce(F.sum(f"__z_{new}").over(before), F.lit(0)).alias(f"__s_{new}") for new in sums])
    within = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    new = {n: F.col(f"__s_{n}") + F.sum(c).over(within) for n, c in sums.items()}
    return rows.join(starts, "__part").withColumns(new).select(*df.columns, *sums)


def row_range(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows with places in [start, end)."""
    return with_ordinal(df, order, "__o").where((F.col("__o") >= start) & (F.col("__o") < end)).drop("__o")


def rows_at(df: DataFrame, order: Sequence[str], ordinals: DataFrame, column: str = "ordinal") -> DataFrame:
    """Rows whose places are in a table of places."""
    return with_ordinal(df, order, column).join(ordinals.select(column).distinct(), column, "left_semi").drop(column)


def random_rows(df: DataFrame, n: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows of the whole table, by hash order."""
    return df.withColumn("__h", random_key(seed, by)).orderBy("__h", *by).limit(n).drop("__h")


def bernoulli(df: DataFrame, fraction: float, by: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows whose hash falls below ``fraction``."""
    part = F.conv(F.substring(random_key(seed, by), 1, 8), 16, 10).cast("long")
    return df.where(part < int(min(max(fraction, 0.0), 1.0) * (1 << 32)))


def stratified_pairs(df: DataFrame, label: str, n: int, positive_share: float, by: Sequence[str], seed: int = 0) -> DataFrame:
    """``ceil(n * positive_share)`` positives and the rest negatives, without replacement; share 0: ``n`` of all."""
    if positive_share == 0:
        return random_rows(df, n, by, seed)
    most = int(-(-n * positive_share // 1))
    own = df.withColumn("__p", (F.col(label) > 0).cast("int"))
    parts = [random_rows(own.where(F.col("__p") == k), m, by, seed) for k, m in ((1, most), (0, n - most))]
    return parts[0].unionByName(parts[1]).drop("__p")

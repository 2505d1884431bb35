"""Scaling of features, as SQL expressions over one aggregate row and as ML pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _beside(df: DataFrame, features: Sequence[str], **stats) -> DataFrame:
    """``df`` with statistics of its columns on every row (a one-row broadcast)."""
    one = df.agg(*[fn(f).alias(f"__{s}_{f}") for s, fn in stats.items() for f in features])
    return df.join(F.broadcast(one))


def min_max(df: DataFrame, features: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """(x - min) / (max - min); missing values and constant columns give 0."""
    x = _beside(df, features, lo=F.min, hi=F.max)
    new = {f"{f}{suffix}": F.coalesce(F.try_divide(F.col(f) - F.col(f"__lo_{f}"), F.col(f"__hi_{f}") - F.col(f"__lo_{f}")), F.lit(0.0)) for f in features}
    return x.withColumns(new).select(*df.columns, *new)


def z_score(df: DataFrame, features: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / sample deviation; missing values and constant columns give 0."""
    x = _beside(df, features, mean=F.avg, sd=F.stddev_samp)
    new = {f"{f}{suffix}": F.coalesce(F.try_divide(F.col(f) - F.col(f"__mean_{f}"), F.col(f"__sd_{f}")), F.lit(0.0)) for f in features}
    return x.withColumns(new).select(*df.columns, *new)


def unit_variance(df: DataFrame, features: Sequence[str], suffix: str = "_unit") -> DataFrame:
    """x / sample deviation without centring, 0 for a constant column; missing values count as 0."""
    df = df.fillna(0, list(features))
    x = _beside(df, features, sd=F.stddev_samp)
    new = {f"{f}{suffix}": F.coalesce(F.try_divide(F.col(f).cast("double"), F.col(f"__sd_{f}")), F.lit(0.0)) for f in features}
    return x.withColumns(new).select(*df.columns, *new)


def eps_scaled(df: DataFrame, features: Sequence[str], stats: DataFrame | None = None, eps: float = 1e-5) -> DataFrame:
    """``_norm`` = (x - min) / (max - min + eps) and ``_std`` = (x - mean) / (deviation + eps).

    ``stats``: a stored profile (feature, min, max, mean, stddev) that saves the pass over ``df``.
    """
    if stats is None:
        x = _beside(df, features, lo=F.min, hi=F.max, mean=F.avg, sd=F.stddev_samp)
    else:
        pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
        x = df.join(F.broadcast(stats.agg(*[pick(f, c).alias(f"__{s}_{f}") for f in features for s, c in (("lo", "min"), ("hi", "max"), ("mean", "mean"), ("sd", "stddev"))])))
    new = {}
    for f in features:
        new[f"{f}_norm"] = F.coalesce((F.col(f) - F.col(f"__lo_{f}")) / (F.col(f"__hi_{f}") - F.col(f"__lo_{f}") + eps), F.lit(0.0))
        new[f"{f}_std"] = F.coalesce((F.col(f) - F.col(f"__mean_{f}")) / (F.col(f"__sd_{f}") + eps), F.lit(0.0))
    return x.withColumns(new).select(*df.columns, *new)


def vectors(df: DataFrame, features: Sequence[str], normalized: bool = True, standard: bool = True) -> DataFrame:
    """``Feature_Raw`` and, as asked, ``Feature_Normalized`` and ``Feature_Standard`` ML vectors; missing values count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=list(features), outputCol="Feature_Raw")]
    if normalized:
        stages.append(MinMaxScaler(inputCol="Feature_Raw", outputCol="Feature_Normalized"))
    if standard:
        stages.append(StandardScaler(inputCol="Feature_Raw", outputCol="Feature_Standard"))
    df = df.fillna(0, list(features))
    return Pipeline(stages=stages).fit(df).transform(df)

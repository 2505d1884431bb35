"""Ranking and regression metrics, exact under ties.

Curves are computed over distinct scores: rows are counted per score first, then
running sums go over ranges of scores, each range in a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, descending: positives and negatives at it (p, n) and down to it (cp, cn)."""
    from ..operators.limits import with_running

    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) > 0).alias("p"), F.count_if(F.col(label) <= 0).alias("n"))
    return with_running(per, [F.col("s").desc()], {"cp": "p", "cn": "n"})


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: P(positive above negative), ties half."""
    c = _curve(df, label, score)
    # negatives strictly above a score count against its positives
    agg = c.agg(F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2)).alias("x"), F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return agg.select((1 - F.try_divide("x", F.col("tp") * F.col("tn"))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the step in recall over distinct scores."""
    c = _curve(df, label, score)
    agg = c.agg(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("x"), F.sum("p").alias("tp"))
    return agg.select(F.try_divide("x", "tp").alias("average_precision"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 at precision 1."""
    c = _curve(df, label, score)
    prec = F.col("cp") / (F.col("cp") + F.col("cn"))
    above = F.col("cp") - F.col("p"), F.col("cn") - F.col("n")
    before = F.coalesce(F.try_divide(above[0], above[0] + above[1]), F.lit(1.0))
    return c.agg(F.sum(F.col("p") * (prec + before) / 2).alias("x"), F.sum("p").alias("tp")).select(F.try_divide("x", "tp").alias("pr_auc"))


def hit_at_k(df: DataFrame, group: Sequence[str], label: str, score: str, ks: Sequence[int] = (1, 3, 5), ties: Sequence[str] = ()) -> DataFrame:
    """(k, hit_rate): share of groups with a positive among their k best rows."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), *[F.col(t) for t in ties])
    best = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= max(ks))
    per = best.groupBy(*group).agg(*[F.max(F.when(F.col("__k") <= k, (F.col(label) > 0).cast("int"))).alias(f"h{k}") for k in ks])
    one = per.agg(*[F.avg(f"h{k}").alias(f"h{k}") for k in ks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hit_rate")) for k in ks])).alias("x")).select("x.*")


def precision_at_k(df: DataFrame, label: str, score: str, ks: Sequence[int], ties: Sequence[str] = ()) -> DataFrame:
    """(k, precision): positives among the k best rows over k."""
    best = df.orderBy(F.col(score).desc(), *[F.col(t) for t in ties]).limit(max(ks))
    w = Window.orderBy(F.col(score).desc(), *[F.col(t) for t in ties])
    ranked = best.withColumn("__k", F.row_number().over(w))  # at most max(ks) rows
    one = ranked.agg(*[(F.count_if((F.col("__k") <= k) & (F.col(label) > 0)) / k).alias(f"h{k}") for k in ks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("precision")) for k in ks])).alias("x")).select("x.*")


def top_share_hit(df: DataFrame, label: str, score: str, percents: Sequence[int] = (5, 10, 20, 50), ties: Sequence[str] = ()) -> DataFrame:
    """(percent, hit_rate): share of positives among the best int(n * percent / 100) rows."""
    from ..operators.limits import with_ordinal

    total = F.broadcast(df.agg(F.count("*").alias("__t")))
    keyed = df.withColumn("__s", -F.col(score))
    ranked = with_ordinal(keyed, ["__s", *ties], "__o").join(total)
    most = lambda p: F.floor(F.col("__t") * p / 100)
    one = ranked.agg(*[F.try_divide(F.count_if((F.col("__o") < most(p)) & (F.col(label) > 0)), F.max(most(p))).alias(f"h{p}") for p in percents])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"h{p}").alias("hit_rate")) for p in percents])).alias("x")).select("x.*")


def regression(df: DataFrame, label: str, score: str) -> DataFrame:
    """(rmse, mae)."""
    d = F.col(label) - F.col(score)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def binary_report(df: DataFrame, label: str, score: str, ks: Sequence[int] = (2000, 5000, 10000), percents: Sequence[int] = (5, 10, 20), ties: Sequence[str] = ()) -> DataFrame:
    """(metric, value): the areas and the precisions at ranks and shares."""
    rows = [auc(df, label, score).select(F.lit("auc").alias("metric"), F.col("auc").alias("value")), pr_auc(df, label, score).select(F.lit("pr_auc").alias("metric"), F.col("pr_auc").alias("value"))]
    rows.append(precision_at_k(df, label, score, ks, ties).select(F.concat(F.lit("top_"), F.col("k").cast("string")).alias("metric"), F.col("precision").alias("value")))
    rows.append(top_share_hit(df, label, score, percents, ties).select(F.concat(F.lit("top_"), F.col("percent").cast("string"), F.lit("%")).alias("metric"), F.col("hit_rate").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

"""A trained pair scorer over path features: logistic regression, or a perceptron with hidden layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_scorer(samples: DataFrame, features: Sequence[str], label: str = "Label", max_iter: int = 20, reg: float = 0.01, hidden: Sequence[int] = (), seed: int = 0):
    """A fitted pipeline: zero fill, assembling, standard scaling, and the classifier; ``hidden`` are sizes of hidden layers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True),
        LogisticRegression(featuresCol="__scaled", labelCol="__label", maxIter=max_iter, regParam=reg),
    ]
    if hidden:
        stages[-1] = MultilayerPerceptronClassifier(featuresCol="__scaled", labelCol="__label", maxIter=max_iter, layers=[len(features), *hidden, 2], seed=seed)
    # Each stage passes over the samples: they are computed once.
    data = samples.fillna(0, list(features)).select(*features, (F.col(label) > 0).cast("double").alias("__label")).persist()
    try:
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def score_pairs(model, samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Samples with ``score``, the probability of a link."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(samples.fillna(0, list(features)).withColumn("__label", F.lit(0.0)))
    return out.withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*samples.columns, "score")

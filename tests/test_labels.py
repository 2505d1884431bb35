"""Budgets of negatives."""

from pathloom.operators.labels import downsample_negatives
from pathloom.plans.schema import TIME


def test_splits_are_not_dealt_to_a_task_each(spark):
    """A split's rows stay where they are: only its row of counts travels, whatever sizes Spark expects."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, i % 2, "m", "train") for i in range(40)], f"a long, Label int, {TIME} string, split string")
        out = downsample_negatives(df, {"train": 30}, ["a"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.where("Label = 1").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

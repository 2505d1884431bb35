"""Edges are dealt into parts whose number follows their files, so that a task's share does not grow with them."""

from pyspark.sql import functions as F

from pathloom.operators import paths
from pathloom.plans.schema import TIME, EdgeSpec, Hop, MetaPath, Relation
from pathloom.sources import io


def inputs(spark, at):
    spark.range(4000).select((F.col("id") % 500).alias("a"), F.col("id").alias("b"), F.lit("m").alias("dt")).write.parquet(f"{at}/first edges")
    spark.range(9000).select((F.col("id") % 5000).alias("b"), (F.col("id") % 70).alias("c"), (F.col("id") % 9).cast("double").alias("w"), F.lit("m").alias("dt")).write.parquet(f"{at}/second")
    return spark.read.parquet(f"{at}/first edges"), spark.read.parquet(f"{at}/second")


def queries(spark, first, second):
    a, b = EdgeSpec(first, "a", ("b",), features=()), EdgeSpec(second, "b", ("c",), features=("w",))
    seeds = first.select(F.col("a").alias("Node_0"), F.col("dt").alias(TIME)).distinct()
    relations = [Relation("one", first, "a", "A", "b", "B", features=()), Relation("two", second, "b", "B", "c", "C", features=("w",))]
    return {
        "path": lambda: paths.sample_path(spark, [a, b]),
        "metapath": lambda: paths.metapath(spark, MetaPath((Hop(a), Hop(b, "w")))),
        "subgraph": lambda: paths.subgraph(spark, seeds, "A", relations, 2),
    }


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_files(spark, tmp_path, monkeypatch):
    first, second = inputs(spark, f"file://{tmp_path}")
    size = io.input_bytes(second)
    assert size == sum(f.stat().st_size for f in tmp_path.glob("second/*.parquet"))
    assert io.input_bytes(first.join(second, "b")) == size + sum(f.stat().st_size for f in tmp_path.glob("first edges/*.parquet"))
    assert io.input_bytes(spark.createDataFrame([(1,)], "a int")) == 0
    made = queries(spark, first, second)
    want = {n: rows(make()) for n, make in made.items()}
    assert all(want.values())
    for parts in (11, 23):
        monkeypatch.setattr(io, "PART_BYTES", -(-size // parts))
        for n, make in made.items():
            df = make()
            assert f", {parts}), REPARTITION_BY_NUM" in plan(df), (n, plan(df))
            assert rows(df) == want[n], n


def test_small_inputs_and_buckets_stay(spark, tmp_path, monkeypatch):
    first, second = inputs(spark, f"file://{tmp_path}")
    made = queries(spark, first, second)
    assert not any("REPARTITION_BY_NUM" in plan(make()) for make in made.values())
    monkeypatch.setattr(io, "PART_BYTES", 100)
    io.write_bucketed(second, "dealt_second", ["b", "dt"], 3, f"file://{tmp_path}/buckets")
    try:
        path = paths.sample_path(spark, [EdgeSpec(first, "a", ("b",), features=()), EdgeSpec("dealt_second", "b", ("c",), source="table", features=("w",))])
        assert "REPARTITION_BY_NUM" not in plan(path) and len(rows(path)) == len(rows(made["path"]()))
    finally:
        spark.sql("DROP TABLE dealt_second")

"""What several later steps use is made once: rows are counted as they are made."""

import os

import pytest
from pyspark.sql import functions as F

from pathloom import queries as Q
from pathloom.functions import attention
from pathloom.operators import pairing
from pathloom.plans.schema import TIME, EdgeSpec, PathSchema

SF = os.environ.get("PATHLOOM_TEST_SF", "/root/testdata/sf0.001")


def counted(spark, df, column):
    """``df`` and an accumulator of how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    kind = df.schema[column].dataType
    return df.withColumn(column, F.udf(seen, kind).asNondeterministic()(column)), made


def test_samples_make_the_paths_once(spark):
    schema = PathSchema("A").extend(EdgeSpec(None, "a", ("b",), head_type="A", tail_types=("B",)))
    path = spark.createDataFrame([(1, 10, "m"), (1, 11, "m"), (2, 12, "m"), (3, 10, "m")], f"Node_0 long, Node_1 long, {TIME} string")
    pairs = spark.createDataFrame([(1, 10, "m"), (2, 13, "m")], f"start long, end long, {TIME} string")
    path, made = counted(spark, path, "Node_1")
    got = pairing.sample_pairs({"p": (schema, path)}, ["p"], pairs)
    assert sorted(map(tuple, got.collect())) == [(1, 10, "m", 1), (1, 11, "m", 0)]
    assert made.value == 4


def test_layers_make_the_nodes_once(spark):
    edges = spark.createDataFrame([(0, "r", "A", "a", "B", "b", "m"), (1, "s", "B", "b", "C", "c", "m")], f"hop int, relation string, near_type string, near string, far_type string, far string, {TIME} string")
    nodes = spark.createDataFrame([("A", "a", "m", 1.0), ("B", "b", "m", 2.0), ("C", "c", "m", 4.0)], f"node_type string, node string, {TIME} string, x double")
    nodes, made = counted(spark, nodes, "x")
    gat = attention.Gat([[1.0]], [0.0], [0.0], [0.0])
    out = attention.layered(edges, nodes, nodes.where("node_type = 'A'").select("node_type", "node", TIME), ["x"], [{"r": ("A", gat)}, {"s": ("B", gat)}])
    assert out.first().x == (1 + (2 + 4) / 2) / 2
    assert made.value <= 4  # each node, and the seed as such


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scores_do_not_read_the_tables_again(spark):
    df = Q.QUERIES["pair_scorer_ml"](spark, SF)
    assert df.count() and not [f for f in df.inputFiles() if "lineitem" in f or "orders" in f]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_replay_joins_the_lines_once(spark):
    """Pairs, orders' suppliers and suppliers' nations come from one reading of the lines; the first hops are not made again for the second ones."""
    counts = {}

    class Tables:
        def __init__(self):
            self.read = self

        def parquet(self, path):
            df = spark.read.parquet(path)
            for name, column in (("lineitem", "l_suppkey"), ("orders", "o_custkey")):
                if path.endswith(f"/{name}.parquet"):
                    n = df.count()
                    df, made = counted(spark, df, column)
                    counts[name] = n, made
            return df

    v = Q.View(Tables(), SF)
    v.spark = spark
    got = Q.replay_on_other_seeds(v)
    assert got.count() == got.distinct().count() > 0
    n, made = counts["lineitem"]
    assert made.value == n
    n, made = counts["orders"]
    assert made.value == 3 * n  # for the lines and for two relations

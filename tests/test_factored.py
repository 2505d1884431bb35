"""Paths as two factors: counts, nodes and the paths between pairs are those of the enumerated paths, without making these."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import counting, pairing, paths
from pathloom.plans.schema import TIME, Relation

from .test_counting import graph, inputs


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize(("simple", "dead_ends", "hops", "same", "end"), [(True, True, 2, True, None), (True, False, 3, True, "Person"), (False, True, 2, True, "Person"), (True, True, 3, False, "Thing")])
def test_factors_stand_for_the_paths(spark, simple, dead_ends, hops, same, end):
    relations = graph(spark, same=same)
    seeds, pairs = inputs(spark, "p", {"Thing": "t", "Person": "p", None: "t"}[end])
    found = paths.enumerate_khop(spark, seeds, "Person", relations, hops, end, simple=simple, dead_ends=dead_ends)
    schemas = paths.schemas_of("Person", relations, hops, end)
    factors = paths.factored(spark, seeds, schemas, simple=simple, dead_ends=dead_ends)
    assert set(factors) == set(found)
    want = {n: (df.count(), df.where(F.col(s.end).isNull()).count()) for n, (s, df) in found.items()}
    assert {r.schema: (r.n_paths, r.n_ended) for r in counting.path_counts(factors.values()).collect()} == {n: k for n, k in want.items() if k[0]}
    assert {r.schema: r.n_same for r in counting.shared_counts((f, f) for f in factors.values()).collect()} == {n: k[0] for n, k in want.items() if k[0]}
    assert rows(paths.node_ids(factors.values())) == rows(paths.node_ids(found.values()))
    for n, (s, df) in paths.between(spark, seeds, schemas, pairs, simple=simple).items():
        assert rows(df) == rows(pairing.restrict(*found[n], pairs).select(*df.columns)), n


def test_what_two_enumerations_share(spark):
    """A path that only one of them continues is in neither way the other's."""
    own = spark.createDataFrame([("p0", "t0", "m"), ("p1", "t0", "m"), ("p1", "t1", "m")], "h string, t string, dt string")
    at = lambda *ends: spark.createDataFrame([(*e, "m") for e in ends], "h string, t string, dt string")
    seeds = spark.createDataFrame([("p0", "m"), ("p1", "m"), ("p2", "m")], f"Node_0 string, {TIME} string")

    def found(places):
        relations = [Relation("owns", own, "h", "Person", "t", "Thing"), Relation("at", places, "h", "Thing", "t", "Place")]
        return list(paths.factored(spark, seeds, paths.schemas_of("Person", relations, 2, "Place"), dead_ends=True).values())

    a, b = found(at(("t0", "l0"), ("t0", "l1"))), found(at(("t0", "l1"), ("t1", "l1")))
    want = a[0].paths().intersectAll(b[0].paths().select(*a[0].paths().columns)).count()
    assert counting.shared_counts(zip(a, b)).first().n_same == want == 3


def test_no_row_per_path_through_a_hub(spark, tmp_path):
    """400 people and 300 cities meet in one place: 120,000 paths; what is stored and joined is their sum."""
    into = spark.createDataFrame([(f"p{i}", "hub", "m") for i in range(400)], "h string, t string, dt string")
    out = spark.createDataFrame([("hub", f"c{i}", "m") for i in range(300)], "h string, t string, dt string")
    relations = [Relation("in", into, "h", "Person", "t", "Place"), Relation("to", out, "h", "Place", "t", "City")]
    seeds = spark.createDataFrame([(f"p{i}", "m") for i in range(400)], f"Node_0 string, {TIME} string")
    schemas = paths.schemas_of("Person", relations, 2, "City")
    from pathloom.sources.io import Checkpoint, MonthlyCheckpoint

    for k, kind in enumerate((Checkpoint, MonthlyCheckpoint)):
        cache = kind(spark, f"file://{tmp_path}/{k}")
        factors = paths.factored(spark, seeds, schemas, dead_ends=True, cache=cache)
        stored = [spark.read.parquet(f"{cache.store.root}/{n}/data").count() for n in cache.names()]
        assert sorted(stored) == [300, 400]
        row = counting.path_counts(factors.values()).first()
        assert (row.n_paths, row.n_ended) == (120_000, 0)
    pairs = spark.createDataFrame([(f"p{i}", f"c{i}", "m") for i in range(250)] + [("p0", "x", "m"), ("x", "c0", "m")], f"start string, end string, {TIME} string")
    (_, df), = paths.between(spark, seeds, schemas, pairs).values()
    assert df.count() == 250
    assert "Node_0" in df._jdf.queryExecution().optimizedPlan().toString() and paths.node_ids(factors.values()).count() == 701


@pytest.mark.parametrize(("light", "carried", "simple", "end"), [(0, 0, False, "Person"), (1, 1, False, "Thing"), (32, 64, True, "Person")])
def test_labels_from_factors_are_those_of_the_paths(spark, monkeypatch, light, carried, simple, end):
    """Whatever is listed and whatever is made last: several schemas, nodes that share starts and ends, parts of a node."""
    for name, value in (("LIGHT", light), ("CARRIED", carried), ("TASK_PAIRS", 5), ("TASKS", 3)):
        monkeypatch.setattr(pairing, name, value)
    relations = graph(spark, same=True)
    seeds, pairs = inputs(spark, "p", end[0].lower())
    schemas = paths.schemas_of("Person", relations, 2, end)
    found = paths.follow_all(spark, seeds, schemas, simple=simple)
    factors = paths.factored(spark, seeds, schemas, simple=simple)
    want = rows(pairing.label_connected(found.values(), pairs))
    assert want and rows(pairing.label_factored(factors.values(), pairs)) == want


@pytest.mark.parametrize(("light", "carried", "size", "simple", "end"), [(0, 0, 1, False, "Person"), (1, 64, 2, False, "Thing"), (0, 64, 3, True, "Person")])
def test_lists_of_ends_may_be_cut_anywhere(spark, monkeypatch, light, carried, size, simple, end):
    """A node's ends lie in several lists, those that it shares apart from its own; first factors are stored."""
    for name, value in (("LIGHT", light), ("CARRIED", carried), ("CHUNK", size), ("TASK_PAIRS", 40)):
        monkeypatch.setattr(pairing, name, value)
    relations = graph(spark, same=True)
    seeds, pairs = inputs(spark, "p", end[0].lower())
    schemas = paths.schemas_of("Person", relations, 2, end)
    want = rows(pairing.label_connected(paths.follow_all(spark, seeds, schemas, simple=simple).values(), pairs))
    assert want and rows(pairing.label_factored(paths.factored(spark, seeds, schemas, simple=simple, store=True).values(), pairs)) == want


def shuffled(spark):
    """Rows shuffled so far in the session."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_no_pair_through_a_hub_is_shuffled(spark, tmp_path):
    """120,000 pairs through one node, some of them known and some also met elsewhere: none is in an exchange."""
    into = spark.createDataFrame([(f"p{i}", "hub", "m") for i in range(400)] + [("p0", "side", "m")], "h string, t string, dt string")
    out = spark.createDataFrame([("hub", f"c{i}", "m") for i in range(300)] + [("side", "c0", "m"), ("side", "c300", "m")], "h string, t string, dt string")
    relations = [Relation("in", into, "h", "Person", "t", "Place"), Relation("to", out, "h", "Place", "t", "City")]
    seeds = spark.createDataFrame([(f"p{i}", "m") for i in range(400)], f"Node_0 string, {TIME} string")
    pairs = spark.createDataFrame([("p0", "c0", "m"), ("p0", "c300", "m"), ("p7", "c9", "m"), ("p7", "c300", "m")], f"start string, end string, {TIME} string")
    before = shuffled(spark)
    got = pairing.label_factored(paths.factored(spark, seeds, paths.schemas_of("Person", relations, 2, "City")).values(), pairs)
    got.write.parquet(f"file://{tmp_path}/out")
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 20_000
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(tuple(r)[:2] for r in got.where("Label").select("start", "end").collect()) == [("p0", "c0"), ("p0", "c300"), ("p7", "c9")]
    assert got.count() == got.distinct().count() == 120_001

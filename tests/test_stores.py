"""Stored edges and paths: what later runs and hops read, by plan and by file."""

import re

import pytest
from pyspark.sql import functions as F

from pathloom.operators import edges, paths
from pathloom.plans.schema import TIME, Relation
from pathloom.sources import io

MONTHS = ["2020-01-01", "2020-02-01", "2020-03-01"]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def relations(spark, tmp_path_factory):
    """Edges stored by month."""
    root = f"file://{tmp_path_factory.mktemp('edges')}"
    out = []
    for name, a, b in (("owns", "Person", "Thing"), ("at", "Thing", "Place"), ("near", "Place", "Place")):
        df = spark.createDataFrame([(f"{a}{i}", f"{b}{i * k % 5}", float(k), m) for i in range(5) for k in (1, 2, 3) for m in MONTHS], "h string, t string, w double, dt string")
        io.write_parquet(df, f"{root}/{name}", "dt")
        out.append(Relation(name, f"{root}/{name}", "h", a, "t", b, source="parquet", features=("w",)))
    return out


def seeds(spark, months):
    return spark.createDataFrame([(f"Person{i}", m) for i in range(4) for m in months], f"Node_0 string, {TIME} string")


def test_scans_open_the_seeds_months(spark, relations):
    df = paths.enumerate_khop(spark, seeds(spark, MONTHS[1:2]), "Person", relations, 1)["Person/owns:Head>Thing"][1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ (=|IN) [^\]]*2020-02-01", plan) and "2020-01-01" not in plan
    edge = relations[0].oriented("Head", 0)
    months = edges.frontier_months(seeds(spark, MONTHS[1:2]), [edge.table], None)
    assert months == MONTHS[1:2]
    every = edges.read_edges(spark, edge)[0]
    assert {m for m in MONTHS for f in edges.read_edges(spark, edge, months)[0].inputFiles() if f"dt={m}" in f} <= set(MONTHS) and every.count() > df.count()
    # Tables at hand are not searched for months: that would compute the seeds once more.
    assert edges.frontier_months(seeds(spark, MONTHS), [spark.range(1)], None) is None


def test_a_new_month_is_made_alone(spark, relations, tmp_path, monkeypatch):
    store, read = io.MonthlyCheckpoint(spark, f"file://{tmp_path}/p"), []
    kept = edges.scan

    def scan(spark, table, source="table", time=None, times=None):
        read.append(tuple(times))
        return kept(spark, table, source, time, times)

    monkeypatch.setattr(edges, "scan", scan)
    go = lambda months, cache: paths.enumerate_khop(spark, seeds(spark, months), "Person", relations, 2, times=months, cache=cache)
    go(MONTHS[:2], store)
    assert set(read) == {tuple(MONTHS[:2])}
    read.clear()
    later = io.MonthlyCheckpoint(spark, f"file://{tmp_path}/p")
    got = go(MONTHS, later)
    assert set(read) == {(MONTHS[2],)} and {tuple(m) for m in later.made.values()} == {(MONTHS[2],)}
    want = go(MONTHS, None)
    assert {n: rows(df) for n, (_, df) in got.items()} == {n: rows(df.select(*got[n][1].columns)) for n, (_, df) in want.items()}
    # Fewer months: read, not made; a month without rows is done too; another making starts anew.
    again = io.MonthlyCheckpoint(spark, f"file://{tmp_path}/p")
    assert {n: rows(df) for n, (_, df) in go(MONTHS[:1], again).items()} == {n: rows(df.where(F.col(TIME) == MONTHS[0])) for n, (_, df) in got.items()} and not again.made
    go(["2021-01-01"], again)
    assert {tuple(m) for m in again.made.values()} == {("2021-01-01",)}
    again.made.clear()
    assert all(df.count() == 4 for _, df in go(["2021-01-01"], again).values() if "Node_2" not in df.columns) and not again.made  # seeds without an edge
    with pytest.raises(ValueError):
        again.get("x", None, {"schema": "x", "times": None})


def test_interrupted_months_are_made_again(spark, tmp_path):
    store = io.MonthlyCheckpoint(spark, f"file://{tmp_path}/q", "m")
    df = lambda months: spark.createDataFrame([(1, m) for m in months], "x int, m string")
    store.get("a", df, {"of": 1, "times": ["1", "2"]})

    def fails(months):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.get("a", fails, {"of": 1, "times": ["2", "3"]})
    assert store.months("a", {"of": 1}) == ["1", "2"]
    assert rows(store.get("a", df, {"of": 1, "times": ["2", "3"]})) == rows(df(["2", "3"])) and store.made["a"] == ["3"]
    assert rows(store.get("a", df, {"of": 2, "times": ["2"]})) == rows(df(["2"])) and store.months("a", {"of": 2}) == ["2"]


def below(plan, node):
    """For each line of a plan with ``node``, the lines under it."""
    lines = plan.split("\n")
    depth = [max(x.find("+- "), x.find(":- ")) for x in lines]
    for i, line in enumerate(lines):
        if node in line:
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                j += 1
            yield lines[i], "\n".join(lines[i + 1 : j])


def test_bucketed_edges_are_joined_without_an_exchange(spark, relations, tmp_path):
    stored = [edges.store_relation(spark, r, f"loom_b_{r.name}", 4, f"file://{tmp_path}/{r.name}") for r in relations[:2]]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for start, name, hops in (("Person", "Person/owns:Head>Thing/at:Head>Place/at:Tail>Thing", 3), ("Place", "Place/at:Tail>Thing/owns:Tail>Person", 2)):
            first = spark.createDataFrame([(f"{start}{i}", m) for i in range(4) for m in MONTHS], f"Node_0 string, {TIME} string")
            want = paths.enumerate_khop(spark, first, start, relations[:2], hops)[name][1]
            got = paths.enumerate_khop(spark, first, start, stored, hops)[name][1]
            plan = got._jdf.queryExecution().executedPlan().toString()
            scans = re.findall(r"loom_b_\w+", plan)
            assert scans and "SortMergeJoin" in plan
            for _, under in below(plan, "Exchange"):  # what moves are paths: edges only as part of one
                assert "loom_b_" not in under or re.search("Join.*(Inner|LeftOuter)", under)
            assert "Bucketed: true" in plan and rows(want.select(*got.columns)) == rows(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for r in stored:
            spark.sql(f"DROP TABLE {r.table}")
            spark.sql(f"DROP TABLE {r.tail_table}")


def test_scratch_goes_and_the_rest_stays(spark):
    kept = io.stored(spark.range(3))
    with io.scratch(spark):
        gone = io.stored(spark.range(4))
        with io.scratch(spark):
            inner = io.stored(spark.range(5))
        assert gone.count() == 4
        with pytest.raises(Exception):
            inner.count()
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()

"""Counts of paths against the enumerated paths."""

import random

import pytest

from pathloom.operators import counting, pairing, paths
from pathloom.plans.schema import TIME, Relation


def graph(spark, seed=1, same=True):
    """People who know people and own things; things lie in places: types come again along paths."""
    rng = random.Random(seed)
    edge = lambda n, a, b: spark.createDataFrame([(f"{a}{rng.randrange(7)}", f"{b}{rng.randrange(6)}", f"2020-0{rng.randint(1, 2)}-01") for _ in range(n)], "h string, t string, dt string")
    rel = lambda name, df, a, b: Relation(name, df, "h", a, "t", b)
    out = [rel("owns", edge(14, "p", "t"), "Person", "Thing"), rel("at", edge(9, "t", "l"), "Thing", "Place")]
    return [*out, rel("knows", edge(11, "p", "p"), "Person", "Person")] if same else out


def inputs(spark, start, end):
    seeds = spark.createDataFrame([(f"{start}{i}", f"2020-0{m}-01") for i in range(6) for m in (1, 2)], f"Node_0 string, {TIME} string")
    pairs = spark.createDataFrame([(f"{start}{i}", f"{end}{(i * j) % 6}", f"2020-0{1 + j % 2}-01") for i in range(6) for j in range(1, 4)], f"start string, end string, {TIME} string")
    return seeds, pairs


@pytest.mark.parametrize(("simple", "dead_ends", "hops", "same", "end"), [(True, True, 3, True, "Thing"), (True, False, 3, True, None), (False, True, 2, True, "Person"), (True, True, 4, False, "Thing"), (True, False, 1, False, "Thing")])
def test_counts_are_those_of_the_paths(spark, simple, dead_ends, hops, same, end):
    relations = graph(spark, same=same)
    seeds, pairs = inputs(spark, "p", {"Thing": "t", "Person": "p", None: "t"}[end])
    found = paths.enumerate_khop(spark, seeds, "Person", relations, hops, end, simple=simple, dead_ends=dead_ends)
    want = {r.schema: tuple(r) for r in pairing.cover_summary(found, pairs).collect()}
    got = {r.schema: tuple(r) for r in counting.cover_counts(spark, seeds, "Person", relations, hops, pairs, end, simple=simple, dead_ends=dead_ends).collect()}
    assert got == want and len(want) >= 1
    assert {s.name for s in paths.schemas_of("Person", relations, hops, end)} == set(found)


def test_rows_are_pairs_not_paths(spark):
    """A hub of 300 things between 2 people and 2 places: 600 paths to a place are 2 rows of the state."""
    own = spark.createDataFrame([(f"p{i}", f"t{j}", "m") for i in range(2) for j in range(300)], "h string, t string, dt string")
    at = spark.createDataFrame([(f"t{j}", f"l{k}", "m") for j in range(300) for k in range(2)], "h string, t string, dt string")
    where = spark.createDataFrame([("l0", "c0", "m"), ("l1", "c0", "m")], "h string, t string, dt string")
    relations = [Relation("owns", own, "h", "Person", "t", "Thing"), Relation("at", at, "h", "Thing", "t", "Place"), Relation("in", where, "h", "Place", "t", "City")]
    seeds = spark.createDataFrame([("p0", "m"), ("p1", "m")], f"Node_0 string, {TIME} string")
    pairs = spark.createDataFrame([("p0", "c0", "m"), ("p1", "c9", "m")], f"start string, end string, {TIME} string")
    made, kept = [], counting.stored
    try:
        counting.stored = lambda df: made.append(kept(df)) or made[-1]
        row = counting.cover_counts(spark, seeds, "Person", relations, 3, pairs, "City").first()
    finally:
        counting.stored = kept
    assert (row.path_count, row.path_cover_count, row.pair_cover_count, row.pair_count) == (1200, 600, 1, 2)
    assert [df.count() for df in made if "__n" in df.columns] == [2, 600, 4]


def test_prefix_tree_reads_each_table_once(spark):
    """Four schemas of three hops over two shared prefixes: each edge of the tree is made once."""
    relations = graph(spark, same=False)
    schemas = [s for s in paths.schemas_of("Person", relations, 4) if len(s.edges) >= 2]
    seeds, _ = inputs(spark, "p", "t")
    made, kept = [], paths.extend
    try:
        paths.extend = lambda spark, path, schema, edge, *a, **k: made.append((schema.name, edge.name)) or kept(spark, path, schema, edge, *a, **k)
        got = paths.follow_all(spark, seeds, schemas, dead_ends=True)
    finally:
        paths.extend = kept
    edges = {(s.name.rsplit("/", 1)[0], s.edges[-1].name) for s in paths.schemas_of("Person", relations, 4)}
    assert len(made) == len(set(made)) and set(made) <= edges and len(schemas) > 3
    every = paths.enumerate_khop(spark, seeds, "Person", relations, 4)
    for n, (_, df) in got.items():
        assert df.exceptAll(every[n][1]).isEmpty() and every[n][1].exceptAll(df).isEmpty()
    scans = list(got.values())[-1][1]._jdf.queryExecution().executedPlan().toString()
    assert scans.count("Scan ExistingRDD") <= 1  # the last edge's table; what comes before it is read from storage
    assert paths.follow_all(spark, seeds, []) == {}

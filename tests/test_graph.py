"""Small graphs written by hand: one behaviour each."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.functions import attention, metrics, scaling, vectors
from pathloom.functions.dates import month_list, months_back
from pathloom.functions.names import numeric_columns, positional, sanitize, shortened, suffixed
from pathloom.operators import export, labels, limits, nodes, pairing, paths
from pathloom.operators.aggregate import aggregate, chunks, publish
from pathloom.operators.edges import read_edges
from pathloom.plans import schema as S
from pathloom.session import ResilientRunner
from pathloom.sources import io

T = S.TIME


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def edges(spark, data, cols="a string, b string, w double, dt string"):
    return spark.createDataFrame(data, cols)


def test_dirty_endpoints_and_parallel_edges(spark):
    df = edges(spark, [("x", "y", 1.0, "m"), ("x", "y", 2.0, "m"), (None, "y", 1.0, "m"), ("", "y", 1.0, "m"), ("x", None, 1.0, "m"), ("x", "", 1.0, "m"), ("x", "z", None, "m")])
    got, feats = read_edges(spark, S.EdgeSpec(df, "a", ("b",)))
    assert feats == ["w"] and rows(got) == [("x", "y", "m", 3.0), ("x", "z", "m", None)]
    got, _ = read_edges(spark, S.EdgeSpec(df, "a", ("b",), features=()))
    assert rows(got) == [("x", "y", "m"), ("x", "z", "m")]
    ids = spark.createDataFrame([(1, 2, "m"), (None, 2, "m")], "a long, b long, dt string")
    assert rows(read_edges(spark, S.EdgeSpec(ids, "a", ("b",)))[0]) == [(1, 2, "m")]


def test_threshold_drops_hubs_whole(spark):
    df = spark.createDataFrame([("k", i) for i in range(3)] + [("l", i) for i in range(4)], "k string, i int")
    assert rows(limits.threshold_n(df, ["k"], 3)) == [("k", 0), ("k", 1), ("k", 2)]


def test_rank_and_row_number_on_ties(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, 4.0), ("k", 4, 5.0)], "k string, i int, w double")
    assert len(rows(limits.rank_n(df, ["k"], 1, "w"))) == 3
    assert len(rows(limits.top_n(df, ["k"], 2, ["w"]))) == 2


def test_random_samples_are_stable_subsets(spark):
    df = spark.range(500).selectExpr("id % 7 AS k", "id")
    one = rows(limits.random_n(df, ["k"], 5, 1))
    assert one == rows(limits.random_n(df.repartition(9), ["k"], 5, 1)) and len(one) == 35
    assert set(one) <= set(rows(df)) and one != rows(limits.random_n(df, ["k"], 5, 2))
    assert 50 < len(rows(limits.bernoulli(df, 0.2, ["id"]))) < 150
    assert rows(limits.row_range(df, ["id"], 10, 13)) == [(3, 10), (4, 11), (5, 12)]


def relation(spark, data, name="r", at="A", bt="B", **more):
    return S.Relation(name, spark.createDataFrame(data, "a string, b string, dt string"), "a", at, "b", bt, features=(), **more)


def test_hops_stay_in_their_month(spark):
    e = edges(spark, [("x", "y", 1.0, "m1"), ("y", "z", 1.0, "m2"), ("y", "u", 1.0, "m1")])
    path = paths.sample_path(spark, [S.EdgeSpec(e, "a", ("b",), "Node_0", ("Node_1",)), S.EdgeSpec(e, "a", ("b",), "Node_1", ("Node_2",))])
    assert rows(path, "Node_0", "Node_1", "Node_2", T) == [("x", "y", "u", "m1")]


def test_dead_ends_and_simple_paths(spark):
    seeds = spark.createDataFrame([("x", "m"), ("v", "m")], f"Node_0 string, {T} string")
    r = relation(spark, [("x", "p", "m"), ("w", "p", "m")])
    one = paths.enumerate_khop(spark, seeds, "A", [r], 1)
    assert rows(one["A/r:Head>B"][1], "Node_0", "Node_1") == [("v", None), ("x", "p")]
    two = paths.enumerate_khop(spark, seeds, "A", [r], 2)
    assert set(one) < set(two)
    # The new node is of the seed's type: it must differ, and null does not differ from anything.
    assert rows(two["A/r:Head>B/r:Tail>A"][1], "Node_0", "Node_1", "Node_2") == [("x", "p", "w")]


def test_disabled_directions_and_pruning(spark):
    off = {"Tail": {"neighbor_limit": S.NeighborLimit("threshold", 0)}}
    r, q = relation(spark, [("x", "p", "m")], limits=off), relation(spark, [("p", "z", "m")], "q", "B", "C")
    seeds = spark.createDataFrame([("x", "m")], f"Node_0 string, {T} string")
    assert set(paths.enumerate_khop(spark, seeds, "A", [r, q], 2)) == {"A/r:Head>B", "A/r:Head>B/q:Head>C"}
    assert set(paths.enumerate_khop(spark, seeds, "A", [r, q], 2, "C")) == {"A/r:Head>B/q:Head>C"}
    assert paths.enumerate_khop(spark, seeds, "A", [r, q], 1, "C") == {}


def test_resume_from_stored_paths(spark, tmp_path):
    seeds = spark.createDataFrame([("x", "m")], f"Node_0 string, {T} string")
    r = relation(spark, [("x", "p", "m"), ("w", "p", "m")])
    store = io.Checkpoint(spark, f"file://{tmp_path}")
    first = paths.enumerate_khop(spark, seeds, "A", [r], 2, cache=store)
    assert len(store.names()) == 2
    again = paths.enumerate_khop(spark, seeds, "A", [r], 2, cache=store)
    assert {k: rows(df) for k, (_, df) in first.items()} == {k: rows(df) for k, (_, df) in again.items()}
    assert store.done(store.names()[0], {"schema": "other"}) is False


def covered(spark):
    path = spark.createDataFrame([("a", "p", "x", "m"), ("a", "q", "x", "m"), ("a", "p", "y", "m"), ("b", "p", None, "m"), ("c", "p", "z", "m")], f"Node_0 string, Node_1 string, Node_2 string, {T} string")
    e = S.EdgeSpec(None, "h", ("t",), tail_types=("M",), name="e"), S.EdgeSpec(None, "h", ("t",), tail_types=("E",), name="f")
    pairs = spark.createDataFrame([("a", "x", "m"), ("b", "y", "m"), ("c", "x", "m"), ("a", "x", "m")], f"start string, end string, {T} string")
    return S.PathSchema("S", e), path, pairs


def test_cover(spark):
    schema, path, pairs = covered(spark)
    assert [r.cover_mark for r in pairing.path_cover(schema, path, pairs).orderBy("Node_0", "Node_2", "Node_1").collect()] == [True, True, False, False, False]
    assert rows(pairing.pair_cover(schema, path, pairs)) == [("a", "x", "m", 2), ("b", "y", "m", 0), ("c", "x", "m", 0)]
    r = pairing.cover_summary({schema.name: (schema, path)}, pairs).first()
    assert (r.path_count, r.path_cover_count, r.path_uncover_count, r.pair_count, r.pair_cover_count, r.pair_uncover_count) == (5, 2, 3, 3, 1, 2)
    assert r.path_cover_rate == 0.4
    with pytest.raises(ValueError):
        pairing.path_cover(schema, path, pairs, "S", "Other")
    assert rows(pairing.sample_pairs({schema.name: (schema, path)}, [schema.name], pairs)) == [("a", "x", "m", 1), ("a", "y", "m", 0)]
    main, aux = pairing.choose_main(pairing.cover_summary({schema.name: (schema, path)}, pairs), 5, 1, 1)
    assert (main, aux) == ([schema.name], [])


def test_nodes(spark):
    t = spark.createDataFrame([("x", "m", 1.0, None), ("x", "m", 0.5, 3), ("y", "m", 2.0, 4)], "id string, dt string, f double, g int")
    spec = S.NodeSpec(t, "id")
    assert rows(nodes.read_nodes(spark, spec, "n")[0], "n", "f", "g") == [("x", 0.5, 3), ("y", 2.0, 4)]
    target = spark.createDataFrame([("x", "m"), ("z", "m")], f"n string, {T} string")
    assert rows(nodes.read_nodes(spark, spec, "n", target=target)[0], "n", "f") == [("x", 0.5), ("z", 0.0)]
    other = spark.createDataFrame([("z", "m", 7)], "id string, dt string, h int")
    out, feats = nodes.combine_nodes(spark, [spec, S.NodeSpec(other, "id")], "n")
    assert rows(out, "n", *feats) == [("x", 0.5, 3, 0), ("y", 2.0, 4, 0), ("z", 0.0, 0, 7)]
    assert rows(nodes.duplicate_keys(t, ["id"])) == [("x", 2)]
    assert rows(nodes.constant_columns(t.selectExpr("1 AS c", "f"), ["c", "f"])) == [("c", 1.0)]


def test_zero_fill_against_skipping(spark):
    df = spark.createDataFrame([("k", 4.0), ("k", None)], "k string, f double")
    assert rows(aggregate(df, ["k"], ["f"])) == [("k", 2.0, 4.0, 4.0, 0.0, 2)]
    assert rows(aggregate(df, ["k"], ["f"], ("AVG", "MIN"), fill=None)) == [("k", 4.0, 4.0)]
    with pytest.raises(ValueError):
        aggregate(df, ["k"], ["f"], ("MEDIAN",))
    assert chunks(list("abcde"), ("AVG", "MAX", "COUNT"), 4) == [["a", "b"], ["c", "d"], ["e"]]


def test_labels(spark):
    t = spark.createDataFrame([("p", "c", 0, "2020-01-05"), ("p", "c", 1, "2020-01-07"), ("p", "d", 0, "2020-01-31"), ("", "d", 1, "2020-01-31"), ("q", "c", 2, "2020-02-01"), ("r", "c", 0, "2020-03-01")], "a string, b string, y int, ts string")
    spec = S.LabelSpec(t, ("a", "b"), ("A", "B"), "y", "ts", label_map={2: 1}, label_range=(0, 1))
    got = labels.read_labels(spark, spec, {"train": ("2020-01-01", "2020-02-01"), "test": ("2020-02-01", "2020-03-01")})
    assert rows(got) == [("p", "c", 1, "2020-01-07", "2020-01-01", "train"), ("p", "d", 0, "2020-01-31", "2020-01-01", "train"), ("q", "c", 1, "2020-02-01", "2020-02-01", "test")]
    from dataclasses import replace

    few = labels.read_labels(spark, replace(spec, max_rows=1), {"train": ("2020-01-01", "2020-04-01")})
    assert {r.Label for r in few.collect()} == {1}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0)], "x double, c double")
    assert rows(scaling.min_max(df, ["x", "c"]), "x_norm", "c_norm") == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert abs(sum(r[0] for r in rows(scaling.z_score(df.dropna(), ["x"]), "x_std"))) < 1e-9
    ml = scaling.vectors(df, ["x", "c"]).collect()
    assert {r.Feature_Normalized[1] for r in ml} == {0.5} and {r.Feature_Standard[1] for r in ml} == {0.0}


def test_vectors(spark):
    df = spark.createDataFrame([("(3,[0,2],[1.5,-2])",), ("[1, -2.5e-1,3]",), ("(2,[],[])",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(vectors.parse_vector(df.s)).collect()] == [[1.5, 0.0, -2.0], [1.0, -0.25, 3.0], [0.0, 0.0], None, None]
    a, b = spark.createDataFrame([(1, [1.0])], "k int, v array<double>"), spark.createDataFrame([(2, [2.0, 3.0])], "k int, v array<double>")
    assert rows(vectors.merge_vectors([a, b], ["k"], "v", [1, 2])) == rows(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 3.0])], "k int, v array<double>"))
    assert [r.v for r in vectors.left_join_vectors(a.select("k"), b, ["k"], ["v"], [2]).collect()] == [[0.0, 0.0]]


def test_metrics_with_equal_scores(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.9, "a"), (1, 0.5, "b"), (0, 0.5, "b"), (0, 0.5, "c"), (1, 0.1, "c"), (0, 0.0, "c"), (0, 0.0, "d")], "y int, s double, g string")
    data = [(r.y, r.s) for r in df.collect()]
    wins = sum((p > n) + (p == n) / 2 for a, p in data if a for b, n in data if not b)
    assert abs(metrics.auc(df, "y", "s").first()[0] - wins / 15) < 1e-9
    assert abs(metrics.average_precision(df, "y", "s").first()[0] - (1 / 2 + 2 / 5 + 3 / 6) / 3) < 1e-9
    assert rows(metrics.hit_at_k(df, ["g"], "y", "s", (1, 3), ["y"])) == [(1, 0.0), (3, 0.75)]
    assert rows(metrics.top_share_hit(df, "y", "s", (50,), ["g", "y"])) == [(50, 0.5)]
    report = {r.metric: r.value for r in metrics.binary_report(df, "y", "s", (2,), (50,), ["g", "y"]).collect()}
    assert set(report) == {"auc", "pr_auc", "top_2", "top_50%"} and report["top_2"] == 0.5


def test_attention(spark):
    df = spark.createDataFrame([("a", 1000.0, 1.0), ("a", 1000.0, 3.0), ("b", -5.0, 2.0)], "g string, s double, x double")
    assert rows(attention.segment_softmax(df, ["g"], "s"), "g", "attention") == [("a", 0.5), ("a", 0.5), ("b", 1.0)]
    assert rows(attention.attend(df, ["g"], "s", ["x"])) == [("a", 2.0), ("b", 2.0)]
    assert rows(attention.l2_normalized(df.selectExpr("3.0D AS u", "4.0D AS v").distinct(), ["u", "v"])) == [(0.6, 0.8)]
    assert len(rows(attention.top_attention(df, ["g"], "x", 1))) == 2


def test_export(spark):
    schema, path, pairs = covered(spark)
    samples = spark.createDataFrame([("a", "x", "m", 1), ("a", "y", "m", 0), ("b", None, "m", 0), ("c", "z", "m", 0)], f"start string, end string, {T} string, Label int")
    data = export.pair_dataset(samples, {"p": (schema, path)})
    assert rows(data["pairs"], "start", "end", "pair_id") == [("a", "x", 0), ("a", "y", 1)]
    assert rows(data["p"], "Node_1", "pair_id", "path_id") == [("p", 0, 0), ("p", 1, 2), ("q", 0, 1)]
    index = export.dense_index(path.selectExpr("Node_0 AS node", T), ["node", T])
    assert rows(index) == [("a", "m", 0), ("b", "m", 1), ("c", "m", 2)]


def test_batches_of_pairs(spark):
    data = {"pairs": spark.createDataFrame([(i,) for i in range(5)], "pair_id long"), "p": spark.createDataFrame([(1, "x"), (3, "y")], "pair_id long, Node_1 string")}
    got = export.slice_pairs(data, 2, 4)
    assert rows(got["pairs"]) == [(0,), (1,)] and rows(got["p"]) == [(1, "y")]


def test_published_features(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0, 3.0), ("k", 3.0, 2.0, 1.0)], "k string, a double, b double, c double")
    names = publish(df, ["k"], ["a", "b", "c"], "loom_f", "m", ("AVG", "COUNT"), "loom_s", 2)
    assert names == ["loom_f_0_1", "loom_s_0", "loom_f_2_2", "loom_s_1"]
    assert rows(spark.table("loom_f_0_1")) == [("k", 2.0, 2.0, 2, "m")] and rows(spark.table("loom_f_2_2")) == [("k", 2.0, "m")]
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_names_and_months(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], ["a b", "c", "d-e"])
    assert sanitize(df).columns == ["a_b", "c", "d_e"] and numeric_columns(df) == ["a b", "d-e"]
    with pytest.raises(ValueError):
        sanitize(spark.createDataFrame([(1, 2)], ["a-b", "a b"]))
    assert shortened(["x" * 130, "y"]) == {"x" * 130: "Feature_Column_0", "y": "y"}
    assert suffixed(["F"], "app_T", ["app_"]) == {"F": "f___t"} and positional([["a", "b"], ["c"]]) == [{"a": "Feature_0", "b": "Feature_1"}, {"c": "Feature_2"}]
    assert month_list("2020-11-15", "2021-02-01") == ["2020-11-01", "2020-12-01", "2021-01-01"]
    got = months_back(spark.createDataFrame([("2020-01-01",)], "dt string"), "dt", 2)
    assert rows(got, T) == [("2019-12-01",), ("2020-01-01",)]


def test_json_forms(tmp_path):
    path = S.path_spec([{"edge_table_name": "t", "head_node_raw_name": "a", "tail_node_raw_names": ["b", "c"], "Edge_Neighbor_Limits": {"Type": "Top_N", "Max_Num": 3, "Feat_Columns": ["w"]}}, {"edge_table_name": "u", "head_node_raw_name": "b", "head_node_std_name": "Node_1_0", "tail_node_raw_name": "d"}])
    assert path[0].tail_names == ("Node_1_0", "Node_1_1") and path[1].tail_names == ("Node_2",) and path[0].neighbor_limit.kind == "top"
    with pytest.raises(S.SpecError, match="unknown keys"):
        S.path_spec([{"edge_table_name": "t", "head_node_raw_name": "a", "tail_node_raw_name": "b", "typo": 1}])
    block = {"Head_Node_name": "a", "Head_Node_class": "A", "Tail_Node_name": "b", "Tail_Node_class": "B", "Relation_Data": "t", "Head_Edge_Neighbor_Limits": {"Type": "Threshold_N", "Max_Num": 20}, "Tail_Edge_Neighbor_Limits": {"Type": "Threshold_N", "Max_Num": 0}, "Head_Max_Sample_Type": "x"}
    with pytest.warns(UserWarning):
        (r,) = S.khop_spec({"r": block})
    assert r.enabled("Head") and not r.enabled("Tail") and r.oriented("Tail", 1).tail_names == ("Node_2",)
    assert S.node_specs({"Feature_Data_List": [{"Table_Name": "t", "UID": "u"}]})[0].key == "u" and S.node_specs([{"node_table_name": "t", "node_raw_name": "u"}])[0].table == "t"
    m = S.metapath_spec({"Relation_List": [{"Relation_Data": "t", "Head_Column_name": "a", "Tail_Column_name": "b", "Max_Sample_Scale": 4, "Max_Sample_Type": "TopN", "Weight_Column": "w"}], "Max_All_Sample_Scale": 9})
    assert (m.hops[0].sampler, m.hops[0].scale, m.max_all) == ("top", 4, 9)
    lab = S.label_spec({"Table_Name": "t", "Node_Columns": ["a"], "Node_Types": ["A"], "Label_Column": "y", "Time_Column": "ts", "train_Max_Rows": 5, "Label_Map_Keys": [2], "Label_Map_Values": [1]}, ["train"])
    assert lab.names == ("A_UID",) and lab.split_max_rows == {"train": 5} and lab.label_map == {2: 1}
    bad = tmp_path / "x.json"
    bad.write_text('{"a": [1,]}')
    with pytest.raises(S.SpecError, match="line 1"):
        S.load_json(str(bad))


def test_metapath_and_subgraph(spark):
    e = edges(spark, [("x", "y", 2.0, "m"), ("x", "y", 3.0, "m"), ("x", "z", 1.0, "m"), ("y", "u", 1.0, "m")])
    hop = lambda a, b, **k: S.Hop(S.EdgeSpec(e, "a", ("b",), a, (b,)), "w", **k)
    spec = S.MetaPath((hop("A", "B"), hop("B", "C")))
    assert rows(paths.metapath(spark, spec, "m"), "A", "B", "C", "Weight_0") == [("x", "y", "u", 5.0)]
    assert rows(paths.metapath(spark, S.MetaPath((hop("A", "B", scale=1, sampler="top"),)), "m"), "A", "B") == [("x", "y"), ("y", "u")]
    cutoff = S.MetaPath((hop("A", "B"), hop("B", "C")), tail_column="B")
    assert "C" not in paths.metapath(spark, cutoff, "m").columns
    with pytest.raises(ValueError):
        paths.metapath_columns(paths.metapath(spark, spec, "m"), spec, "Nothing")
    r = S.Relation("r", e, "a", "N", "b", "N", features=("w",))
    seeds = spark.createDataFrame([("x", "m")], f"node string, {T} string")
    assert rows(paths.subgraph(spark, seeds, "N", [r], 1), "Head", "Tail", "Weight") == [("x", "y", 5.0), ("x", "z", 1.0)]
    assert ("y", "u", 1.0) in rows(paths.subgraph(spark, seeds, "N", [r], 2), "Head", "Tail", "Weight")
    assert rows(paths.subgraph(spark, seeds, "N", [r], 1, [1], [0]), "Head") == [("x",)]


def test_sinks_and_files(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = spark.createDataFrame([(1, "m1"), (2, "m2")], "x int, dt string")
    io.write_parquet(df, f"{root}/t", "dt")
    io.write_parquet(spark.createDataFrame([(3, "m2")], "x int, dt string"), f"{root}/t", "dt")
    assert rows(io.scan(spark, f"{root}/t", "HDFS"), "x", "dt") == [(1, "m1"), (3, "m2")]
    assert rows(io.read_partitions(spark, f"{root}/t", ["m2"]), "x", "dt") == [(3, "m2")]
    assert rows(io.project(df, {"x": "y"}, ["x > 0"], "dt", "m1")) == [(1,)]
    store = io.Store(spark, root)
    store.write_text("a/b.txt", json.dumps({"k": "é"}))
    assert json.loads(store.read_text("a/b.txt")) == {"k": "é"} and store.list("a") == ["b.txt"] and not store.exists("c")
    spark.sql("DROP TABLE IF EXISTS loom_t")
    io.create_orc_table(spark, "loom_t", {"x": "int"}, {"x": "a number"})
    io.insert_partition(spark.createDataFrame([(5,)], "x int"), "loom_t", "m1")
    io.insert_partition(spark.createDataFrame([(6,)], "x int"), "loom_t", "m2")
    io.insert_partition(spark.createDataFrame([(7,)], "x int"), "loom_t", "m1")
    assert rows(io.scan(spark, "loom_t", "table", "dt", ["m1", "m2"]), "x", "dt") == [(6, "m2"), (7, "m1")]
    spark.sql("DROP TABLE loom_t")


def test_runner_starts_again(spark):
    calls = []

    class Stub:
        def stop(self):
            calls.append("stop")

    def task(s, n):
        calls.append("run")
        if len(calls) < n:
            raise ConnectionError("lost")
        return "done"

    assert ResilientRunner(Stub, 3, 0).run(task, 4) == "done" and calls == ["run", "stop", "run", "stop", "run"]
    with pytest.raises(ConnectionError):
        ResilientRunner(Stub, 1, 0).run(task, 10**6)

    def wrong(s):
        calls.append("wrong")
        raise ValueError("a mistake")

    with pytest.raises(ValueError):
        ResilientRunner(Stub, 3, 0).run(wrong)
    assert calls.count("wrong") == 1


def test_ordinals_at_many_partitions(spark):
    """Uneven payloads, ties and many ranges: every place once, in order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 400_000
        df = spark.range(n).select((F.xxhash64("id") % 50_000).alias("k"), F.col("id"), F.expr("repeat('x', cast(id % 700 as int))").alias("payload"))
        got = limits.with_ordinal(df, ["k", "id"], "o").select("k", "id", "o").toPandas().sort_values("o")
        assert got["o"].tolist() == list(range(n))
        assert list(zip(got["k"], got["id"])) == sorted(zip(got["k"], got["id"]))
        total = limits.with_running(df.select("k", "id", "payload"), [F.col("k").desc(), "id"], {"upto": "id"}).select("k", "id", "upto").toPandas()
        total = total.sort_values(["k", "id"], ascending=[False, True])
        assert total["upto"].tolist() == total["id"].cumsum().tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_curves_on_continuous_scores(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    s = np.round(rng.normal(size=3000), 4)
    y = (rng.random(3000) < 1 / (1 + np.exp(-s))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").repartition(7)
    wins = sum((s[y == 1] > b).sum() + (s[y == 1] == b).sum() / 2 for b in s[y == 0])
    assert abs(metrics.auc(df, "y", "s").first()[0] - wins / (y.sum() * (1 - y).sum())) < 1e-9
    kinds = np.unique(s)[::-1]
    tp = np.array([(y[s >= k]).sum() for k in kinds])
    prec, rec = tp / np.array([(s >= k).sum() for k in kinds]), tp / y.sum()
    step = np.diff(np.append(0, rec))
    assert abs(metrics.average_precision(df, "y", "s").first()[0] - (step * prec).sum()) < 1e-9
    assert abs(metrics.pr_auc(df, "y", "s").first()[0] - (step * (prec + np.append(1, prec[:-1])) / 2).sum()) < 1e-9


def test_entry_contract():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and "cover_summary" in E.queries()

"""JSON forms of whole tasks, what they reject, and the tasks on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import flows, labels
from pathloom.operators.scorer import score_pairs, train_scorer
from pathloom.plans import dialects as D
from pathloom.plans import schema as S

T = S.TIME
PATH = [{"edge_table_name": "e", "head_node_raw_name": "a", "head_node_std_name": "A", "tail_node_raw_name": "b", "tail_node_std_name": "B"}]


def test_path_aggregation_form():
    spec = D.path_aggregation({"path_config": PATH, "aggregation_nodes": ["B"], "node_agg_funcs": ["SUM"]})
    assert spec.nodes == {"B": ("SUM",)} and spec.edges[0].head_name == "A"
    assert D.path_aggregation({"path_config": PATH, "aggregation_nodes": ["B"]}).nodes == {"B": ("AVG", "MAX", "MIN")}
    for wrong in ({"aggregation_nodes": ["C"]}, {"aggregation_nodes": ["B"], "node_agg_funcs_list": [["SUM"], ["MAX"]]}, {"aggregation_nodes": []}, {"aggregation_nodes": ["B"], "more": 1}):
        with pytest.raises(S.SpecError):
            D.path_aggregation({"path_config": PATH} | wrong)


@pytest.mark.parametrize("read,good", [
    (D.khop_target, {"Target_Node_df": "t", "Target_Node_Type": "x", "Target_Node_UID_name": "u"}),
    (D.pair_spec, {"Pair_Data": "t", "Start_Node_name": "a", "End_Node_name": "b", "Start_Node_Type": "x", "End_Node_Type": "y"}),
])
def test_targets_and_pairs(read, good):
    assert read(good).times is None and read(good | {"Feature_Times": ["m"]}).times == ("m",)
    with pytest.raises(S.SpecError):
        read(good | {"odd": 1})
    with pytest.raises(S.SpecError):
        read(dict(list(good.items())[1:]))


def test_metapath_and_subgraph_forms():
    hop = {"Relation_Data": "e", "Head_Column_name": "a", "Tail_Column_name": "b"}
    spec = D.metapath_features({"Relation_List": [hop], "Groupby_Type_List": ["SUM"], "Max_Column_Number": -1, "Output_Summary": "True"})
    assert spec.functions == ("SUM",) and spec.most_columns is None and spec.summary and spec.columns == "Head_And_Tail"
    rel = {"Relation_Data": "e", "Head_Column_name": "a", "Tail_Column_name": "b", "Head_Node_class": "X", "Tail_Node_class": "Y", "Max_Sample_Scale_list": [1, 2, 3], "Reverse_Max_Sample_Scale_list": [0, -1]}
    sub = D.subgraph_spec({"r": rel})
    assert sub.scales == {"r": (1, 2)} and sub.reverse_scales == {"r": (0, -1)} and sub.samplers == {"r": "random"}
    for wrong in ({"Max_Sample_Type": "Best"}, {"odd": 1}):
        with pytest.raises(S.SpecError):
            D.subgraph_spec({"r": rel | wrong})


def test_feature_store_form():
    store = D.feature_store({"Start_Node_Feature_Table_List": [{"Table_Name": "t", "UID": "u"}], "Meta_Path_Feature_Table_List": {"p": [{"Node_class": "x", "Feature_Table_List": ["a", "b"]}]}})
    assert store.start[0].key == "u" and [t.table for t in store.paths["p"][0][1]] == ["a", "b"] and store.paths["p"][0][1][0].key == "Start_Column"
    with pytest.raises(S.SpecError):
        D.feature_store({"Meta_Path_Feature_Table_List": {"p": [{"Node_class": "x", "Feature_Table_List": [], "odd": 1}]}})
    with pytest.raises(S.SpecError):
        D.feature_store({"Meta_Path_Feature_Table_List": {"p": [{"Node_class": "x", "Feature_Table_List": ["a", "b"], "Feature_Table_Summary_List": ["s"]}]}})


def test_ml_table_by_stored_profile(spark):
    spark.createDataFrame([("a", 1.0, "m"), ("b", 3.0, "m")], "Start_Column string, f double, dt string").createOrReplaceTempView("loom_t_f")
    spark.createDataFrame([("f", 0.0, 10.0, 2.0, 4.0)], "feature string, min double, max double, mean double, stddev double").createOrReplaceTempView("loom_t_s")
    store = D.feature_store({"Meta_Path_Feature_Table_List": {"p": [{"Node_class": "x", "Feature_Table_List": ["loom_t_f"], "Feature_Table_Summary_List": ["loom_t_s"]}]}})
    targets = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], f"u string, {T} string")
    got = {r.u: r for r in flows.ml_table(spark, store, targets, "u", ("raw", "norm", "std")).collect()}
    assert [got[u]["p^0^f_raw"] for u in "abc"] == [1.0, 3.0, 0.0]
    assert np.allclose([got[u]["p^0^f_norm"] for u in "abc"], [0.1, 0.3, 0.0], atol=1e-5) and np.allclose([got[u]["p^0^f_std"] for u in "abc"], [-0.25, 0.25, -0.5], atol=1e-5)
    from pathloom.sources import io

    made = list(io._made[-1])
    assert made
    io.forget_stored(spark)
    assert not io._made[-1] and not any(io.Store(spark, m).exists() for m in made)


def test_label_months(spark):
    spec = S.label_spec({"Node_Columns": ["a"], "Node_Types": ["x"], "Label_Column": "y", "Time_Column": "t", "Table_Name": "l", "Feature_Time_Range": 2})
    df = spark.createDataFrame([("n", "2020-01-01"), ("n", "2020-02-01")], f"x_UID string, {T} string")
    assert spec.months == 2 and sorted(map(tuple, labels.label_targets(spec, df, "x_UID").collect())) == [("n", "2019-12-01"), ("n", "2020-01-01"), ("n", "2020-02-01")]


def test_metapath_tables_are_published(spark):
    rows = [("x", "p", 1.0, "m"), ("x", "q", 2.0, "m"), ("y", "p", 4.0, "m")]
    spark.createDataFrame(rows, "a string, b string, w double, dt string").createOrReplaceTempView("loom_t_e")
    nodes = spark.createDataFrame([("p", 10.0, 1.0), ("q", 20.0, 3.0)], "b string, f double, g double")
    hop = {"Relation_Data": "loom_t_e", "Head_Column_name": "a", "Tail_Column_name": "b", "Weight_Column": "w"}
    spec = D.metapath_features({"Relation_List": [hop], "Groupby_Type_List": ["AVG"], "Output_Columns_Type": "ALL_Nodes_And_Edges", "Max_Column_Number": 1, "Output_Summary": "True"})
    names = flows.publish_metapath(spark, spec, {"b": [S.NodeSpec(nodes, "b")]}, "loom_pub", "m1")
    try:
        assert {n for n in names if not n.endswith("_summary_0")} == {"loom_pub_b_0", "loom_pub_b_1", "loom_pub_weight_0"}
        got = {tuple(r)[:2] for r in spark.table("loom_pub_b_0").collect()}
        assert got == {("x", 15.0), ("y", 10.0)}
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_link_data_needs_an_explaining_schema(spark):
    known = spark.createDataFrame([("a", "z", "m", "2020")], f"start string, end string, {T} string, Source_Time string")
    edge = spark.createDataFrame([("a", "b", "m")], "x string, y string, dt string")
    rel = S.Relation("r", edge, "x", "X", "y", "Y", features=())
    with pytest.raises(ValueError):
        flows.link_data(spark, known, "start", "end", "X", "Y", [rel], 1, {"Train": ("2020", "2021")})


def test_hidden_layers_separate_what_lines_cannot(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "f double, g double, Label int")
    from pathloom.functions import metrics

    auc = lambda **k: metrics.auc(score_pairs(train_scorer(df, ["f", "g"], max_iter=200, **k), df, ["f", "g"]), "Label", "score").first()[0]
    assert auc() < 0.7 and auc(hidden=(8,), seed=3) > 0.95


def test_scorer_is_the_regularized_fit(spark):
    """Against Newton's method on the same objective."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) * [2.0, 0.5] + [1.0, -3.0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 1.5 * x[:, 1] - 5)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "f double, g double, Label int")
    model = train_scorer(df, ["f", "g"], max_iter=100)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    z1, w = np.column_stack([z, np.ones(len(z))]), np.zeros(3)
    pen = np.array([0.01, 0.01, 0.0])  # of coefficients standardised once more, which changes nothing here
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ w))
        grad = z1.T @ (p - y) / len(y) + pen * w
        w -= np.linalg.solve((z1 * (p * (1 - p))[:, None]).T @ z1 / len(y) + np.diag(pen), grad)
    got = model.stages[-1]
    assert np.allclose([*got.coefficients, got.intercept], w, atol=2e-3)
    scored = score_pairs(model, df, ["f", "g"]).select(F.col("score"), "f", "g").collect()
    want = {(float(a), float(b)): s for (a, b), s in zip(x, 1 / (1 + np.exp(-z1 @ w)))}
    assert max(abs(r.score - want[r.f, r.g]) for r in scored) < 2e-3

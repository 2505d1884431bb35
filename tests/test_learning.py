"""Learned scorers: gradients by differences, training against a plain NumPy loop, examples by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.learning import gradients as G
from pathloom.learning import networks, training
from pathloom.plans.schema import TIME, EdgeSpec, PathSchema

PATHS = networks.PathScorer({"A": 3, "B": 2, "C": 4}, "A", "C", {"s1": ("A", "B", "C"), "s2": ("A", "C")}, hidden=4, heads=2)
METAPATHS = networks.MetapathScorer({"A": 3, "B": 2}, {"m1": "A", "m2": "B", "m3": "A"}, hidden=4, heads=2, layers=2)
RESIDUAL = networks.ResidualScorer({"a": 3, "b": 2}, 5, 2, 2)


def batches(rng):
    of = lambda *shape: rng.normal(size=shape)
    yield PATHS, {"x": {"start": of(3, 3), "end": of(3, 4)}, "paths": {"s1": (np.array([0, 2, 2, 5]), of(5, 9)), "s2": (np.array([0, 0, 1, 1]), of(1, 7))}}
    yield METAPATHS, {"x": {"m1": of(3, 3), "m2": of(3, 2), "m3": of(3, 3)}, "paths": {}}
    yield RESIDUAL, {"x": {"a": of(3, 3), "b": of(3, 2)}, "paths": {}}


@pytest.mark.parametrize("kind", range(3))
def test_gradients_are_differences(kind):
    rng = np.random.default_rng(kind)
    net, batch = list(batches(rng))[kind]
    label, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    at = networks.first_weights(net, 1) + rng.normal(size=len(networks.first_weights(net))) * 0.1
    _, gradient = networks.loss_and_gradient(net, at, batch, label, weight)
    for i in rng.choice(len(at), 150, replace=False):
        e = np.zeros(len(at))
        e[i] = 1e-5
        up, down = (networks.loss_and_gradient(net, at + s * e, batch, label, weight)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-3 * max(1, abs(gradient[i]))


def test_no_paths_count_as_zero():
    rng = np.random.default_rng(0)
    net, batch = next(batches(rng))
    p = {n: G.Var(v) for n, v in networks.unpack(net.shapes(), networks.first_weights(net)).items()}
    one = {"x": {k: v[1:2] for k, v in batch["x"].items()}, "paths": {"s1": (np.array([0, 0]), np.zeros((0, 9))), "s2": (np.array([0, 1]), batch["paths"]["s2"][1])}}
    assert np.allclose(net.logit(p, batch).value[1], net.logit(p, one).value[0])


def auc(label, score):
    a, b = score[label > 0][:, None], score[label <= 0][None, :]
    return float(((a > b) + (a == b) / 2).mean())


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(240, 3)), rng.normal(size=(240, 2))
    label = (x[:, 0] + y[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(float)
    data = [(i, float(t), a.tolist(), b.tolist()) for i, (t, a, b) in enumerate(zip(label, x, y))]
    return spark.createDataFrame(data, "id long, label double, x_a array<double>, x_b array<double>").repartition(7)


LAYOUT = training.Layout.of_columns({"x_a": 3, "x_b": 2})


def arrays(df):
    got = sorted(df.collect(), key=lambda r: r.id)
    return {"x": {"a": np.array([r.x_a for r in got]), "b": np.array([r.x_b for r in got])}, "paths": {}}, np.array([r.label for r in got])


def test_training_is_the_plain_loop(rows):
    train, valid = rows.where("id < 160"), rows.where("id >= 160")
    kw = {"rate": 0.05, "seed": 3}
    fitted = training.fit(RESIDUAL, LAYOUT, train, valid, epochs=12, rounds=2, patience=2, positive_share=0.5, **kw)
    # The same slices, steps and stop in one process.
    slice_of = {r.id: r.s for r in train.select("id", F.pmod(F.xxhash64(F.lit(3), "id", "label"), F.lit(2)).alias("s")).collect()}
    batch, label = arrays(train)
    vbatch, vlabel = arrays(valid)
    part = np.array([slice_of[i] for i in range(160)])
    n, pos = len(label), label.sum()
    weight = np.where(label > 0, 0.5 * n / pos, 0.5 * n / (n - pos))
    w, best, history = networks.first_weights(RESIDUAL, 3), None, []
    first = second = 0.0
    step = 0
    for epoch in range(12):
        total = 0.0
        for s in (0, 1):
            own = {"x": {k: v[part == s] for k, v in batch["x"].items()}, "paths": {}}
            loss, g = networks.loss_and_gradient(RESIDUAL, w, own, label[part == s], weight[part == s])
            g, step, total = g / weight[part == s].sum(), step + 1, total + loss
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        p = {k: G.Var(v) for k, v in networks.unpack(RESIDUAL.shapes(), w).items()}
        history.append((epoch, total / weight.sum(), auc(vlabel, G.sigmoid(RESIDUAL.logit(p, vbatch).value))))
        if best is None or history[-1][2] > best[1]:
            best = epoch, history[-1][2], w
        elif epoch - best[0] >= 2:
            break
    assert fitted.best_epoch == best[0] and len(fitted.history) == len(history)
    assert np.allclose(np.array(fitted.history), np.array(history), rtol=1e-6, atol=1e-9)
    assert np.allclose(fitted.weights, best[2], rtol=1e-6, atol=1e-8)
    assert fitted.history[-1][1] < fitted.history[0][1] and best[1] > 0.7
    # Going on from given weights.
    more = training.fit(RESIDUAL, LAYOUT, train, valid, epochs=1, rounds=2, start=fitted.weights, rate=0.0, seed=3)
    assert np.allclose(more.weights, fitted.weights)
    got = {r.id: r.score for r in fitted.score(rows, ["id"]).collect()}
    every, _ = arrays(rows)
    p = {k: G.Var(v) for k, v in networks.unpack(RESIDUAL.shapes(), fitted.weights).items()}
    assert np.allclose([got[i] for i in range(240)], G.sigmoid(RESIDUAL.logit(p, every).value))


def test_steps_sum_over_any_number_of_tasks(rows, monkeypatch):
    w = networks.first_weights(RESIDUAL)
    want = training.gradient_step(rows.coalesce(1), RESIDUAL, LAYOUT, w)
    got = training.gradient_step(rows.repartition(150), RESIDUAL, LAYOUT, w)  # three groups of tasks, some tasks empty
    assert got[0] == want[0] == 240 and np.isclose(got[1], want[1]) and np.allclose(got[2], want[2])
    none = training.gradient_step(rows.where("id < 0"), RESIDUAL, LAYOUT, w)
    assert none[0] == 0 and not none[2].any()


def test_pair_examples(spark):
    month = "2020-01-01"
    samples = spark.createDataFrame([("a1", "c1", month, 1), ("a1", "c2", month, 0), ("a9", "c1", month, 0)], f"start string, end string, {TIME} string, Label int")
    schema = PathSchema("A", tuple(EdgeSpec(None, "x", ("y",), head_type=a, tail_types=(b,), name=f"{a}{b}") for a, b in (("A", "B"), ("B", "C"))))
    path = spark.createDataFrame([("a1", "b2", "c1", month), ("a1", "b1", "c1", month), ("a1", "b1", "c9", month), ("a1", "b7", "c1", month)], f"Node_0 string, Node_1 string, Node_2 string, {TIME} string")
    make = lambda rows: (training.node_array(spark.createDataFrame(rows, "n string, f double, g int"), "n", ["f", "g"], "x"), 2)
    features = {"A": make([("a1", 1.0, 2)]), "B": make([("b1", 3.0, None), ("b2", 4.0, 5)]), "C": make([("c1", 6.0, 7)])}
    got = {(r.start, r.end): r for r in training.pair_examples(samples, {"s": (schema, path)}, features, "A", "C").collect()}
    assert got["a1", "c1"].p_0 == [[1, 2, 3, 0, 6, 7], [1, 2, 4, 5, 6, 7], [1, 2, 0, 0, 6, 7]] and got["a1", "c1"].label == 1
    assert got["a1", "c2"].p_0 is None and got["a1", "c2"].x_end == [0, 0] and got["a9", "c1"].x_start == [0, 0]


def test_ends_of_a_pair_are_not_joined_to_its_paths(spark):
    """Paths take the features of the nodes between; those of a pair's ends come from its row, also for paths of one edge."""
    month = "m"
    samples = spark.createDataFrame([("a1", "c1", month, 1), ("a2", "c1", month, 0)], f"start string, end string, {TIME} string, Label int")
    edge = lambda a, b: EdgeSpec(None, "x", ("y",), head_type=a, tail_types=(b,), name=f"{a}{b}")
    long, short = PathSchema("A", (edge("A", "B"), edge("B", "C"))), PathSchema("A", (edge("A", "C"),))
    path = spark.createDataFrame([("a1", "b1", "c1", month), ("a2", "b1", "c1", month)], f"Node_0 string, Node_1 string, Node_2 string, {TIME} string")
    make = lambda rows: (training.node_array(spark.createDataFrame(rows, "n string, f double"), "n", ["f"], "x"), 1)
    features = {"A": make([("a1", 1.0)]), "B": make([("b1", 2.0)]), "C": make([("c1", 3.0)])}
    both = {"long": (long, path), "short": (short, path.drop("Node_1").withColumnRenamed("Node_2", "Node_1"))}
    for between in (False, True):
        df = training.pair_examples(samples, both, features, "A", "C", between)
        got = {r.start: r for r in df.collect()}
        assert df.columns == ["start", "end", TIME, "label", "x_start", "x_end", "p_0", "p_1"]  # slices hash the keys in this order
        assert got["a1"].p_0 == [[1, 2, 3]] and got["a1"].p_1 == [[1, 3]] and got["a2"].p_0 == [[0, 2, 3]] and got["a2"].p_1 == [[0, 3]]
        # The samples' two, the node between; the packed paths of two schemas; and, where paths may connect others, their keys.
        assert str(df._jdf.queryExecution().optimizedPlan()).count("Join") == (5 if between else 7)


def test_examples_are_stored_once_and_shuffles_are_let_go(spark, monkeypatch, tmp_path):
    """What is stored for training, choosing and holding out are the parts of one write, and no shuffle file outlives its run."""
    from pathlib import Path

    from pathloom import queries_learned as L
    from pathloom.sources import io

    df = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("label"), F.array(F.col("id").cast("double")).alias("x_a"))
    want = [p.orderBy("id").collect() for p in L._split(df, "id")]
    seen = []
    real = io.shared_folder
    monkeypatch.setattr(io, "shared_folder", lambda s: seen.append(real(s)) or seen[-1])
    train, valid, held_out = L._split_slices(df, 3, "id")
    assert sorted(r for p in train for r in p.collect()) == want[0] and valid.orderBy("id").collect() == want[1] and held_out.orderBy("id").collect() == want[2]
    assert len(seen) == 1
    slices = [sorted(p.collect()) for p in training.slices(L._split(df, "id")[0], 3)]
    assert slices == [sorted(p.collect()) for p in train]
    monkeypatch.undo()

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).parent
    files = lambda: set(local.rglob("shuffle_*.data"))
    before = files()
    with io.tidy(spark):
        assert io.stored(spark.range(1000).repartition(7)).count() == 1000
    for _ in range(50):
        if not files() - before:
            break
        import time

        time.sleep(0.1)
    assert not files() - before
    assert io.stored(spark.range(1000).repartition(7)).count() == 1000 and files() - before

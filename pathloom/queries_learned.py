"""Queries of the learned scorers: networks with stated weights beside their SQL, and trained ones on held-out rows."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import attention, metrics
from .learning import networks, training
from .operators import paths
from .plans.schema import TIME, Relation
from .queries import View, _round, query
from .sources.io import stored, tidy


def stated_weights(net, seed: int) -> np.ndarray:
    """Weights between -1 and 1 that a rule gives: two places after the point."""
    n = sum(int(np.prod(s)) for s in net.shapes().values())
    return (np.arange(n) * 37 + seed) % 101 / 50 - 1


class Sql:
    """Columns of lists, one step after the other, that repeat a network's arithmetic with its weights written out."""

    def __init__(self, net, weights: np.ndarray):
        self.p, self.steps, self.n = networks.unpack(net.shapes(), weights), [], 0

    def column(self, expression: str) -> str:
        self.n += 1
        self.steps.append((f"v{self.n}", expression))
        return f"v{self.n}"

    def select(self, source: str, base: str, *outputs: str) -> str:
        """``base`` columns of ``source`` and the outputs of the steps, each step stored for the ones after it."""
        used = [set(re.findall(r"\bv\d+\b", e)) for _, e in self.steps] + [set(outputs)]
        parts = [f"s0 AS MATERIALIZED ({source})"]
        for k, (name, expression) in enumerate(self.steps):
            live = [n for n, _ in self.steps[:k] if any(n in u for u in used[k + 1 :])]
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT {', '.join([base, *live])}, {expression} AS {name} FROM s{k})")
        return f"WITH {', '.join(parts)} SELECT {', '.join([base, *outputs])} FROM s{len(self.steps)}"

    def linear(self, name: str, x: str) -> str:
        w, b = self.p[f"{name}.w"], self.p[f"{name}.b"]
        dots = [f"list_dot_product({x}, {[float(v) for v in col]}::DOUBLE[]) + {float(shift)}" for col, shift in zip(w.T, b)]
        return self.column(f"[{', '.join(dots)}]")

    def norm(self, name: str, x: str) -> str:
        scale, shift = self.p[f"{name}.scale"], self.p[f"{name}.shift"]
        z = self.column(f"list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5))")
        return self.column("[" + ", ".join(f"{z}[{i + 1}] * {float(a)} + {float(b)}" for i, (a, b) in enumerate(zip(scale, shift))) + "]")

    def each(self, function: str, x: str) -> str:
        return self.column(f"list_transform({x}, lambda v: {function})")

    def tanh(self, x: str) -> str:
        return self.each("2 / (1 + exp(-2 * v)) - 1", x)

    def add(self, a: str, b: str) -> str:
        return self.column(f"list_transform(list_zip({a}, {b}), lambda v: v[1] + v[2])")

    def encoder(self, name: str, xs: list[str], heads: int) -> list[str]:
        width = len(self.p[f"{name}.query.b"])
        own = width // heads
        q, k, v = ([self.linear(f"{name}.{part}", x) for x in xs] for part in ("query", "key", "value"))
        out = []
        for i, x in enumerate(xs):
            parts = []
            for h in range(heads):
                cut = f"[{h * own + 1}:{(h + 1) * own}]"
                s = self.column("[" + ", ".join(f"list_dot_product({q[i]}{cut}, {k[j]}{cut}) * {own**-0.5}" for j in range(len(xs))) + "]")
                e = self.each(f"exp(v - list_max({s}))", s)
                a = self.each(f"v / list_sum({e})", e)
                parts += [" + ".join(f"{a}[{j + 1}] * {v[j]}[{h * own + d + 1}]" for j in range(len(xs))) for d in range(own)]
            mixed = self.column(f"[{', '.join(parts)}]")
            y = self.norm(f"{name}.norm1", self.add(x, self.linear(f"{name}.out", mixed)))
            dense = self.linear(f"{name}.out2", self.each("greatest(v, 0)", self.linear(f"{name}.in2", y)))
            out.append(self.norm(f"{name}.norm2", self.add(y, dense)))
        return out

    def residual(self, name: str, x: str, blocks: int, depth: int) -> str:
        x = self.linear(f"{name}.prepare", x)
        for b in range(blocks):
            y = x
            for d in range(depth):
                y = self.norm(f"{name}.{b}.{d}", self.tanh(self.linear(f"{name}.{b}.{d}", y)))
            x = self.norm(f"{name}.{b}", self.tanh(self.add(x, y)))
        return self.linear(f"{name}.last", x)


# --- nodes by their metapaths ---------------------------------------------------

_META_NET = networks.MetapathScorer({"Order": 2, "Line": 3}, {"orders": "Order", "lines": "Line", "returns": "Line"}, hidden=4, heads=2, layers=2, blocks=1, depth=2)


def _meta_sql(net: networks.MetapathScorer) -> str:
    s = Sql(net, stated_weights(net, 5))
    xs = [s.residual(f"transform.{t}", f"x_{m}", net.blocks, net.depth) for m, t in net.metapaths.items()]
    xs = [s.linear("enter", x) for x in xs]
    for k in range(net.layers):
        xs = s.encoder(f"layer.{k}", xs, net.heads)
    x = s.linear("leave", s.column(" || ".join(xs)))
    z = s.residual("head", x, net.blocks, net.depth)
    rows = """SELECT c, [a, b]::DOUBLE[] AS x_orders, [p, q, r]::DOUBLE[] AS x_lines, [coalesce(u, 0), coalesce(v, 0), coalesce(w, 0)]::DOUBLE[] AS x_returns
      FROM (SELECT c, count(*) / 10 AS a, sum(price) / 1e6 AS b FROM m GROUP BY c)
      JOIN (SELECT c, sum(q) / 1e3 AS p, sum(d) / 10 AS q, count(*) / 100 AS r FROM l GROUP BY c) USING (c)
      LEFT JOIN (SELECT c, sum(q) / 1e3 AS u, sum(d) / 10 AS v, count(*) / 100 AS w FROM l WHERE f = 'R' GROUP BY c) USING (c)"""
    return f"SELECT c AS Customer, round(1 / (1 + exp(-{z}[1])), 6) AS score FROM ({s.select(rows, 'c, x_orders, x_lines, x_returns', z)})"


def _meta_examples(v: View) -> DataFrame:
    """(Customer, x_orders, x_lines, x_returns, label): whether a third of a customer's goods came back."""
    orders = v.orders.groupBy(F.col("o_custkey").alias("Customer")).agg((F.count("*") / 10).alias("a"), (F.sum("o_totalprice") / 1e6).alias("b"))
    sums = lambda df: df.groupBy(F.col("o_custkey").alias("Customer")).agg((F.sum("l_quantity") / 1e3).alias("p"), (F.sum("l_discount") / 10).alias("q"), (F.count("*") / 100).alias("r"))
    array = lambda df, name, *cols: df.select("Customer", F.array(*[F.col(c).cast("double") for c in cols]).alias(name))
    rows = array(orders, "x_orders", "a", "b").join(array(sums(v.lines), "x_lines", "p", "q", "r"), "Customer")
    rows = rows.join(array(sums(v.lines.where("l_returnflag = 'R'")), "x_returns", "p", "q", "r"), "Customer", "left")
    rows = rows.withColumn("x_returns", F.coalesce("x_returns", F.array_repeat(F.lit(0.0), 3)))
    return rows.withColumn("label", (F.col("x_returns")[0] * 3 > F.col("x_lines")[0]).cast("double"))


_META_LAYOUT = training.Layout.of_columns({"x_orders": 2, "x_lines": 3, "x_returns": 3})


@query(_meta_sql(_META_NET))
def metapath_scorer_stated(v: View) -> DataFrame:
    return _round(training.scored(_meta_examples(v), _META_NET, _META_LAYOUT, stated_weights(_META_NET, 5), ["Customer"]), "score", to=6)


# --- rows of features by the residual net ---------------------------------------

_RES_NET = networks.ResidualScorer({"orders": 2, "lines": 3}, hidden=5, blocks=2, depth=2)


def _res_sql(net: networks.ResidualScorer) -> str:
    s = Sql(net, stated_weights(net, 11))
    z = s.residual("net", s.column("x_orders || x_lines"), net.blocks, net.depth)
    rows = """SELECT c, [a, b]::DOUBLE[] AS x_orders, [p, q, r]::DOUBLE[] AS x_lines
      FROM (SELECT c, count(*) / 10 AS a, sum(price) / 1e6 AS b FROM m GROUP BY c)
      JOIN (SELECT c, sum(q) / 1e3 AS p, sum(d) / 10 AS q, count(*) / 100 AS r FROM l GROUP BY c) USING (c)"""
    return f"SELECT c AS Customer, round(1 / (1 + exp(-{z}[1])), 6) AS score FROM ({s.select(rows, 'c, x_orders, x_lines', z)})"


@query(_res_sql(_RES_NET))
def residual_scorer_stated(v: View) -> DataFrame:
    layout = training.Layout.of_columns({"x_orders": 2, "x_lines": 3})
    return _round(training.scored(_meta_examples(v), _RES_NET, layout, stated_weights(_RES_NET, 11), ["Customer"]), "score", to=6)


# --- pairs by their paths ---------------------------------------------------------

_COS, _CNS = "Customer/co:Head>Order/os:Head>Supplier", "Customer/cn:Head>Nation/sn:Tail>Supplier"
_PATH_NET = networks.PathScorer({"Customer": 2, "Order": 1, "Nation": 1, "Supplier": 2}, "Customer", "Supplier", {_COS: ("Customer", "Order", "Supplier"), _CNS: ("Customer", "Nation", "Supplier")}, hidden=4, heads=2)


def _path_sql(net: networks.PathScorer) -> str:
    weights = stated_weights(net, 17)
    parts, h = [], net.hidden
    for i, (name, middle) in enumerate(zip(net.schemas, ("[price / 1e6]", "[n / 25]"))):
        s = Sql(net, weights)
        kinds = net.schemas[name]
        places = [s.tanh(s.norm("norm", s.linear(f"project.{t}", x))) for t, x in zip(kinds, ("x0", "x1", "x2"))]
        coded = s.encoder(f"path.{name}", places, net.heads)
        path = s.tanh(s.norm("norm", s.linear(f"path.{name}.project", s.column(" || ".join(coded)))))
        a = s.tanh(s.linear(f"path.{name}.attention", s.column(f"{places[0]} || {path} || {places[2]}")))
        table = "scos" if i == 0 else "scns"
        rows = f"SELECT c, s, t, xc AS x0, {middle}::DOUBLE[] AS x1, xs AS x2 FROM {table} SEMI JOIN pr USING (c, s, t) JOIN cf USING (c) JOIN sf USING (s)"
        mixed = ", ".join(f"sum(exp({a}[1]) * {path}[{d + 1}]) / sum(exp({a}[1]))" for d in range(h))
        parts.append(f"h{i} AS (SELECT c, s, t, [{mixed}] AS h{i} FROM ({s.select(rows, 'c, s, t, x0, x1, x2', a, path)}) GROUP BY c, s, t)")
    s = Sql(net, weights)
    first, last = (s.tanh(s.norm("norm", s.linear(f"project.{t}", x))) for t, x in (("Customer", "xc"), ("Supplier", "xs")))
    zero = f"{[0.0] * h}::DOUBLE[]"
    mixed = [s.tanh(s.norm("norm", x)) for x in s.encoder("mutual", [s.column(f"coalesce(h{i}, {zero})") for i in range(2)], net.heads)]
    z = s.linear("predict", s.column(" || ".join([first, last, *mixed])))
    rows = "SELECT c, s, t, xc, xs, h0, h1 FROM pr JOIN cf USING (c) JOIN sf USING (s) LEFT JOIN h0 USING (c, s, t) LEFT JOIN h1 USING (c, s, t)"
    return f""", cf AS (SELECT c_custkey AS c, [c_acctbal / 1e4, c_nationkey / 25]::DOUBLE[] AS xc FROM customer), sf AS (SELECT s_suppkey AS s, [s_acctbal / 1e4, s_nationkey / 25]::DOUBLE[] AS xs FROM supplier),
{', '.join(parts)} SELECT c AS start, s AS "end", t AS Feature_Time, round(1 / (1 + exp(-{z}[1])), 6) AS score FROM ({s.select(rows, 'c, s, t, xc, xs, h0, h1', z)})"""


def _features(v: View) -> dict[str, tuple[DataFrame, int]]:
    over = lambda c, by: (F.col(c) / by).alias(c)
    customer = v.customer.select(F.col("c_custkey").alias("Customer"), over("c_acctbal", 1e4), over("c_nationkey", 25))
    supplier = v.supplier.select(F.col("s_suppkey").alias("Supplier"), over("s_acctbal", 1e4), over("s_nationkey", 25))
    nation = v.customer.select(F.col("c_nationkey").alias("Nation")).union(v.supplier.select("s_nationkey")).distinct().select("Nation", (F.col("Nation") / 25).alias("x"))
    orders = v.orders.select(F.col("o_orderkey").alias("Order"), over("o_totalprice", 1e6))
    tables = {"Customer": (customer, "Customer"), "Supplier": (supplier, "Supplier"), "Nation": (nation, "Nation"), "Order": (orders, "Order")}
    return {t: (training.node_array(df, key, df.columns[1:], "x"), len(df.columns) - 1) for t, (df, key) in tables.items()}


def _path_examples(v: View, samples: DataFrame) -> DataFrame:
    """The examples of (start, end, month, Label) samples, none of which occurs twice."""
    samples = stored(samples)
    seeds = stored(samples.select(F.col("start").alias("Node_0"), TIME).distinct())
    relations = [replace(r, features=()) for r in (v.r_co, v.r_os, v.r_cn, v.r_sn)]
    schemas = {s.name: s for s in paths.schemas_of("Customer", relations, 2, "Supplier")}
    found = paths.between(v.spark, seeds, [schemas[s] for s in _PATH_NET.schemas], samples, once=True)
    # What a schema's joins shuffle is gone before the next one's.
    made = {s: (found[s][0], stored(found[s][1])) for s in _PATH_NET.schemas}
    return training.pair_examples(samples, made, _features(v), "Customer", "Supplier", between=True)


@query(_path_sql(_PATH_NET))
def path_scorer_stated(v: View) -> DataFrame:
    rows = _path_examples(v, v.pairs.withColumn("Label", F.lit(1)))
    return _round(training.scored(rows, _PATH_NET, training.Layout.of_pairs(_PATH_NET), stated_weights(_PATH_NET, 17), ["start", "end", TIME]), "score", to=6)


def _split(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Six, two and two tenths of the rows by a hash of their keys: to train on, to choose the epoch by, held out."""
    tenth = F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(10))
    return df.where(tenth < 6), df.where(tenth.between(6, 7)), df.where(tenth > 7)


def _split_slices(df: DataFrame, n: int, *keys: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """``_split`` with what to train on in ``n`` slices; every row is stored once."""
    tenth = F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(10))
    part = F.when(tenth < 6, training.slice_of(df, n)).when(tenth.between(6, 7), n).otherwise(n + 1)
    parts = training.folders(df, part, n + 2)
    return parts[:n], parts[n], parts[n + 1]


def _report(fitted: training.Fitted, held_out: DataFrame) -> DataFrame:
    """One row: size, share of positives and AUC of what was held out, the epoch kept and how many there were."""
    rows = stored(fitted.score(held_out, ["label"]))
    one = rows.agg(F.count("*").alias("n_rows"), F.sum("label").cast("long").alias("n_positive"))
    made = F.lit(fitted.best_epoch).alias("best_epoch"), F.lit(len(fitted.history)).alias("epochs")
    return one.join(F.broadcast(metrics.auc(rows, "label", "score"))).select("n_rows", "n_positive", F.round("auc", 4).alias("auc"), *made)


@query(None)
def path_scorer_trained(v: View) -> DataFrame:
    """Whether a customer and a supplier met in a large order, from their paths: the AUC on held-out pairs."""
    price = v.orders.select("o_orderkey", "o_totalprice")
    met = v.lines.join(price, "o_orderkey").groupBy(F.col("o_custkey").alias("start"), F.col("l_suppkey").alias("end"), F.col("dt").alias(TIME))
    samples = met.agg((F.max("o_totalprice") > 250_000).cast("int").alias("Label"))
    rounds = 4
    with tidy(v.spark):
        train, valid, held_out = _split_slices(_path_examples(v, samples), rounds, "start", "end", TIME)
        fitted = training.fit(_PATH_NET, training.Layout.of_pairs(_PATH_NET), train, valid, epochs=6, rounds=rounds, rate=0.02, positive_share=0.5)
        return _report(fitted, held_out)


@query(None)
def metapath_scorer_trained(v: View) -> DataFrame:
    """Customers of whose goods a third came back, from their metapaths: the AUC on held-out customers."""
    net = networks.MetapathScorer(_META_NET.widths, _META_NET.metapaths, hidden=8, heads=2, layers=1, blocks=1, depth=1)
    train, valid, held_out = _split(stored(_meta_examples(v)), "Customer")
    return _report(training.fit(net, _META_LAYOUT, train, valid, epochs=8, rounds=3, rate=0.02), held_out)


# --- messages from the last hop to the first ----------------------------------------

_GATS = {
    "co": attention.Gat([[0.9, -0.4], [0.3, 0.7]], [0.1, -0.2], [0.5, -1.1], [1.3, 0.8], 0.05, [0.02, -0.03]),
    "cn": attention.Gat([[0.2, 0.6], [-0.8, 0.5]], [0.0, 0.1], [-0.7, 0.4], [0.9, 1.2], -0.1, [0.01, 0.04]),
    "os": attention.Gat([[-0.5, 0.8], [0.6, 0.4]], [-0.1, 0.3], [1.4, 0.2], [-0.6, 1.1], 0.2, [-0.05, 0.06]),
}


def _gat_sql(g: attention.Gat, near: str, far: str) -> tuple[str, list[str]]:
    """(the score, the mapped far features) for features near.a, near.b and far.a, far.b."""
    of = lambda x: [f"({r[0]} * {x}.a + {r[1]} * {x}.b + {b})" for r, b in zip(g.linear, g.shift)]
    a, b = of(near), of(far)
    z = " + ".join(f"{w} * {c}" for w, c in zip((*g.near, *g.far), (*a, *b)))
    return f"exp(2 / (1 + exp(-2 * ({z} + {g.score_shift}))) - 1)", b


def _hier_sql() -> str:
    os_, co, cn = _GATS["os"], _GATS["co"], _GATS["cn"]
    (w2, f2), (w1, f1), (w0, f0) = _gat_sql(os_, "x", "y"), _gat_sql(co, "x", "y"), _gat_sql(cn, "x", "y")
    mean = lambda w, f: f"sum({w} * {f[0]}) / sum({w}) AS ra, sum({w} * {f[1]}) / sum({w}) AS rb"
    return f""", hc AS (SELECT c_custkey AS c, c_acctbal / 1e4 AS a, c_nationkey / 25 AS b FROM customer), hs AS (SELECT s_suppkey AS s, s_acctbal / 1e4 AS a, s_nationkey / 25 AS b FROM supplier),
ho AS (SELECT o, t, price / 1e6 AS a, 0.5 AS b FROM m), hn AS (SELECT n_nationkey AS n, n_nationkey / 25 AS a, n_regionkey / 5 AS b FROM nation),
e1 AS (SELECT DISTINCT o, t FROM co SEMI JOIN seeds USING (c, t)),
r1 AS (SELECT o, t, {mean(w2, f2)} FROM os SEMI JOIN e1 USING (o, t) JOIN ho x USING (o, t) JOIN hs y USING (s) GROUP BY o, t),
b1 AS (SELECT o, t, (ho.a + coalesce(ra, 0) + {os_.bias[0]}) / 2 AS a, (ho.b + coalesce(rb, 0) + {os_.bias[1]}) / 2 AS b FROM e1 JOIN ho USING (o, t) LEFT JOIN r1 USING (o, t)),
rc AS (SELECT c, t, {mean(w1, f1)} FROM co SEMI JOIN seeds USING (c, t) JOIN hc x USING (c) JOIN b1 y USING (o, t) GROUP BY c, t),
rn AS (SELECT c, t, {mean(w0, f0)} FROM cn SEMI JOIN seeds USING (c, t) JOIN hc x USING (c) JOIN hn y USING (n) GROUP BY c, t)
SELECT c AS Customer, t AS Feature_Time, round((hc.a + coalesce(rc.ra, 0) + coalesce(rn.ra, 0) + {co.bias[0] + cn.bias[0]}) / 3, 6) AS a, round((hc.b + coalesce(rc.rb, 0) + coalesce(rn.rb, 0) + {co.bias[1] + cn.bias[1]}) / 3, 6) AS b
FROM seeds JOIN hc USING (c) LEFT JOIN rc USING (c, t) LEFT JOIN rn USING (c, t)"""


@query(_hier_sql())
def attention_hierarchical(v: View) -> DataFrame:
    """Two layers over a subgraph: orders from their suppliers, customers from those orders and from their nations."""
    relations: list[Relation] = [v.r_co, v.r_os, v.r_cn]
    own = stored(v.seeds)
    edges = stored(paths.subgraph(v.spark, own, "Customer", relations, 2, {"co": [-1, 0], "os": [0, -1], "cn": [-1, 0]}, {}))
    of = lambda t, df, key, a, b: df.select(F.lit(t).alias("node_type"), F.col(key).cast("string").alias("node"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    nation = v.spark.read.parquet(f"{v.sf}/nation.parquet")
    fixed = of("Customer", v.customer, "c_custkey", F.col("c_acctbal") / 1e4, F.col("c_nationkey") / 25).union(of("Supplier", v.supplier, "s_suppkey", F.col("s_acctbal") / 1e4, F.col("s_nationkey") / 25))
    fixed = fixed.union(of("Order", v.orders, "o_orderkey", F.col("o_totalprice") / 1e6, F.lit(0.5))).union(of("Nation", nation, "n_nationkey", F.col("n_nationkey") / 25, F.col("n_regionkey") / 5))
    seeds = own.select(F.lit("Customer").alias("node_type"), F.col("Node_0").cast("string").alias("node"), TIME)
    ends = edges.select(F.col("Head").alias("node"), TIME).union(edges.select("Tail", TIME)).union(seeds.select("node", TIME)).distinct()
    nodes = fixed.join(ends, "node")
    hops = attention.hop_edges(edges, {"co": ("Customer", "Order"), "os": ("Order", "Supplier"), "cn": ("Customer", "Nation")})
    layers = [{"co": ("Customer", _GATS["co"]), "cn": ("Customer", _GATS["cn"])}, {"os": ("Order", _GATS["os"])}]
    out = attention.layered(hops, nodes, seeds, ["a", "b"], layers)
    return _round(out.select(F.col("node").cast("long").alias("Customer"), TIME, "a", "b"), "a", "b", to=6)


@query("""SELECT c AS Customer, round(coalesce(a / nullif(sqrt(a * a + b * b), 0), 0), 6) AS a, round(coalesce(b / nullif(sqrt(a * a + b * b), 0), 0), 6) AS b
FROM (SELECT c, avg(x) / 1e4 AS a, avg(d) * 10 - 0.5 AS b FROM l GROUP BY c)""")
def attention_unit_length(v: View) -> DataFrame:
    rows = v.lines.groupBy(F.col("o_custkey").alias("Customer")).agg((F.avg("l_extendedprice") / 1e4).alias("a"), (F.avg("l_discount") * 10 - 0.5).alias("b"))
    return _round(attention.l2_normalized(rows, ["a", "b"]), "a", "b", to=6)

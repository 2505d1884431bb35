"""Paths: fixed paths, typed k-hop enumeration, metapaths, recall and subgraphs.

A path is a row; extending one is a join on (last node, month).  A hop uses the
paths before it twice, for the frontier and for the join, so paths of two hops and more that others
extend are stored first (``stored``, or ``cache``, a ``Checkpoint`` that a later run
takes up); the paths that are returned are lazy.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import TIME, EdgeSpec, MetaPath, PathSchema, Relation
from ..sources.io import Checkpoint, MonthlyCheckpoint, bucketed, dealt, scan, stored
from .edges import collapse, frontier_months, present, read_edges
from .limits import apply_limit, random_n, top_n


def sample_path(spark: SparkSession, edges: Sequence[EdgeSpec], times: Iterable[str] | None = None, target: DataFrame | None = None) -> DataFrame:
    """Instances of a fixed path: Node columns, month, ``Hop_{k}_Edge_Table_{f}``.

    ``target``: (first node, month) rows to start from.  Hops never cross months.
    """
    path: DataFrame | None = None
    if target is not None:
        times = frontier_months(target, [e.table for e in edges], times)
    for k, spec in enumerate(edges):
        front = None
        if path is not None:
            front = path.select(spec.head_name, TIME).distinct()
        elif target is not None:
            front = target.select(spec.head_name, TIME).distinct()
        df, features = read_edges(spark, spec, times, front)
        df = df.withColumnsRenamed({f: f"Hop_{k}_Edge_Table_{f}" for f in features})
        path = df if path is None else path.join(df, [spec.head_name, TIME])
        if spec.path_limit:
            path = path.where(F.expr(spec.path_limit))
        path = apply_limit(path, [edges[0].head_name], spec.path_neighbor_limit)
        if 0 < k < len(edges) - 1:
            path = stored(path)
    return path


def simple_path(schema: PathSchema, new: str) -> Column | None:
    """The new node differs from every earlier node of its type; null if there is none."""
    earlier = [f"Node_{i}" for i, t in enumerate(schema.node_types) if t == schema.end_type and f"Node_{i}" != new]
    return reduce(lambda a, b: a & b, [F.col(new) != F.col(c) for c in earlier]) if earlier else None


def extend(spark: SparkSession, path: DataFrame, schema: PathSchema, edge: EdgeSpec, times=None, simple: bool = True, dead_ends: bool = True) -> tuple[DataFrame, PathSchema]:
    """Paths longer by one edge; a path that ends stays with a null node (unless nodes of its type must differ)."""
    grown = schema.extend(edge)
    out = path.join(hop_edges(spark, path, schema, edge, times), [schema.end, TIME], "left" if dead_ends else "inner")
    differs = simple_path(grown, grown.end) if simple else None
    return (out if differs is None else out.where(differs)), grown


def hop_edges(spark: SparkSession, path: DataFrame, schema: PathSchema, edge: EdgeSpec, times=None) -> DataFrame:
    """The edges from the ends of paths, their features named for the longer path."""
    front = path.select(schema.end, TIME).where(F.col(schema.end).isNotNull()).distinct()
    df, features = read_edges(spark, edge, times, front)
    return df.withColumnsRenamed({f: f"Edge_Feat_{f}_to_{schema.extend(edge).end}" for f in features})


def reaches(relations: Sequence[Relation], end_type: str, hops: int) -> list[set[str]]:
    """Types from which ``end_type`` can be reached in at most k hops, for k = 0 to ``hops``."""
    out = [{end_type}]
    steps = [(r.head_type, r.tail_type) for r in relations if r.enabled("Head")] + [(r.tail_type, r.head_type) for r in relations if r.enabled("Tail")]
    for _ in range(hops):
        out.append(out[-1] | {a for a, b in steps if b in out[-1]})
    return out


def _of_months(path: DataFrame, months: Sequence[str] | None, times: Sequence[str] | None) -> DataFrame:
    """The paths of fewer months than the ones at hand."""
    return path if months is None or months == times else path.where(F.col(TIME).isin(list(months)))


def _file_name(schema: str) -> str:
    return schema.replace("/", "__").replace(">", "-").replace(":", "-")


def _months(seeds: DataFrame, tables, times, cache: Checkpoint | None) -> list[str] | None:
    times = frontier_months(seeds, tables, times)
    if times is None and isinstance(cache, MonthlyCheckpoint):
        times = sorted(r[0] for r in seeds.select(TIME).distinct().collect())  # a row per month
    return times


def steps(schema: PathSchema, relations: Sequence[Relation], hops: int, reach: list[set[str]] | None = None) -> list[EdgeSpec]:
    """The edges by which a schema goes on, in both directions of each relation, if its end can still be reached."""
    hop, out = len(schema.edges), []
    for r in relations:
        for start, own in (("Head", r.head_type), ("Tail", r.tail_type)):
            edge = r.oriented(start, hop)
            if own == schema.end_type and r.enabled(start) and not (reach and edge.tail_types[0] not in reach[hops - hop - 1]):
                out.append(edge)
    return out


def schemas_of(seed_type: str, relations: Sequence[Relation], hops: int, end_type: str | None = None) -> list[PathSchema]:
    """The schemas that ``enumerate_khop`` finds paths of."""
    reach = reaches(relations, end_type, hops) if end_type else None
    level, out = [PathSchema(seed_type)], []
    for _ in range(hops):
        level = [s.extend(e) for s in level for e in steps(s, relations, hops, reach)]
        out += [s for s in level if end_type is None or s.end_type == end_type]
    return out


def enumerate_khop(
    spark: SparkSession, seeds: DataFrame, seed_type: str, relations: Sequence[Relation], hops: int, end_type: str | None = None, times=None,
    simple: bool = True, dead_ends: bool = True, cache: Checkpoint | None = None,
) -> dict[str, tuple[PathSchema, DataFrame]]:
    """Every typed path from (Node_0, month) seeds of up to ``hops`` hops, in both edge directions, by schema name.

    With ``end_type`` schemas that can't end there in the hops left are not built.  ``cache``: what
    a later run takes up; a ``MonthlyCheckpoint`` makes only the months that are new.
    """
    reach = reaches(relations, end_type, hops) if end_type else None
    times = _months(seeds, [r.table for r in relations], times, cache)
    level = [(PathSchema(seed_type), stored(seeds.select("Node_0", TIME).distinct()))]
    found: dict[str, tuple[PathSchema, DataFrame]] = {}
    for hop in range(hops):
        grown = []
        for schema, path in level:
            for edge in steps(schema, relations, hops, reach):
                make = lambda months=times, path=path, schema=schema, edge=edge: extend(spark, _of_months(path, months, times), schema, edge, months, simple, dead_ends)[0]
                s = schema.extend(edge)
                if cache is not None:
                    df = cache.get(_file_name(s.name), make, {"schema": s.name, "times": times})
                else:
                    df = stored(make()) if 0 < hop < hops - 1 else make()
                grown.append((s, df))
                if end_type is None or s.end_type == end_type:
                    found[s.name] = (s, df)
        level = grown
    return found


def follow_all(
    spark: SparkSession, seeds: DataFrame, schemas: Iterable[PathSchema], times=None, simple: bool = True, dead_ends: bool = False, cache: Checkpoint | None = None
) -> dict[str, tuple[PathSchema, DataFrame]]:
    """Known schemas' paths from other seeds, by name: the same rules and names as in the enumeration.

    Schemas are followed as a prefix tree: a prefix that several share, or that is
    extended further, is made and stored once, so each edge of the tree reads its table once.
    """
    schemas = {s.name: s for s in schemas}
    first = next(iter(schemas.values()), None)
    if first is None:
        return {}
    if len({s.start_type for s in schemas.values()}) > 1:
        raise ValueError("schemas start at different types")
    times = _months(seeds, [e.table for s in schemas.values() for e in s.edges], times, cache)
    inner = {PathSchema(s.start_type, s.edges[:k]).name for s in schemas.values() for k in range(1, len(s.edges))}
    made = {first.start_type: stored(seeds.select("Node_0", TIME).distinct())}
    for s in schemas.values():
        grown = PathSchema(s.start_type)
        for edge in s.edges:
            before, grown = grown, grown.extend(edge)
            if grown.name not in made:
                make = lambda months=times, before=before, edge=edge: extend(spark, _of_months(made[before.name], months, times), before, edge, months, simple, dead_ends)[0]
                if cache is not None:
                    made[grown.name] = cache.get(_file_name(grown.name), make, {"schema": grown.name, "times": times})
                else:
                    made[grown.name] = stored(make()) if grown.name in inner else make()
    return {n: (s, made[n]) for n, s in schemas.items()}


def follow(spark: SparkSession, seeds: DataFrame, schema: PathSchema, times=None, simple: bool = True, dead_ends: bool = False) -> DataFrame:
    """One known schema's paths from other seeds."""
    return follow_all(spark, seeds, [schema], times, simple, dead_ends)[schema.name][1]


@dataclass(frozen=True)
class Factored:
    """A schema's paths as their two factors: the paths before the last hop, and that hop's edges.

    Through a node that many paths enter and many edges leave, paths are as many as the product;
    the factors are as many as the sum.
    """

    schema: PathSchema
    prefix: DataFrame
    edges: DataFrame
    simple: bool = True
    dead_ends: bool = False

    @property
    def last(self) -> str:
        """The node in which the factors meet."""
        return self.schema.edges[-1].head_name

    @property
    def differs(self) -> Column | None:
        return simple_path(self.schema, self.schema.end) if self.simple else None

    def paths(self) -> DataFrame:
        """Every path."""
        out = self.prefix.join(self.edges, [self.last, TIME], "left" if self.dead_ends else "inner")
        return out if self.differs is None else out.where(self.differs)

    def between(self, pairs: DataFrame, once: bool = False) -> DataFrame:
        """The paths that connect (start, end, month) rows: the pairs' starts meet the first factor, then both ends of
        the last hop are known.  No other path is made.  ``once``: no pair occurs twice."""
        keys = pairs.select(F.col("start").alias("Node_0"), F.col("end").alias(self.schema.end), TIME)
        keys = keys if once else keys.distinct()
        met = self.prefix.join(keys, ["Node_0", TIME]).join(self.edges, [self.last, self.schema.end, TIME])
        return (met if self.differs is None else met.where(self.differs)).select(*self.paths().columns)


def factored(
    spark: SparkSession, seeds: DataFrame, schemas: Iterable[PathSchema], times=None, simple: bool = True, dead_ends: bool = False, cache: Checkpoint | None = None,
    store: bool = False,
) -> dict[str, Factored]:
    """Known schemas' paths from seeds as factors, by name; ``cache`` keeps the factors, never their product.

    ``store``: the first factors are made once, as the second ones are found from their ends.
    """
    schemas = {s.name: s for s in schemas}
    before = {n: PathSchema(s.start_type, s.edges[:-1]) for n, s in schemas.items()}
    times = _months(seeds, [e.table for s in schemas.values() for e in s.edges], times, cache)
    prefixes = follow_all(spark, seeds, before.values(), times, simple, dead_ends, cache)
    if store and cache is None:
        prefixes = {n: (s, stored(df) if s.edges else df) for n, (s, df) in prefixes.items()}
    out = {}
    for n, s in schemas.items():
        prior, path = prefixes[before[n].name]
        make = lambda months=times, path=path, prior=prior, edge=s.edges[-1]: hop_edges(spark, _of_months(path, months, times), prior, edge, months)
        edges = make() if cache is None else cache.get(_file_name(n) + "__edges", make, {"edges": n, "times": times})
        out[n] = Factored(s, path, edges, simple, dead_ends)
    return out


def between(
    spark: SparkSession, seeds: DataFrame, schemas: Iterable[PathSchema], pairs: DataFrame, times=None, simple: bool = True, once: bool = False
) -> dict[str, tuple[PathSchema, DataFrame]]:
    """Known schemas' paths from seeds that connect (start, end, month) pairs, by name.

    ``once``: the pairs are stored, and none occurs twice; they are not made distinct and stored again.
    """
    known = pairs.select("start", "end", TIME).dropna()
    known = known if once else stored(known.distinct())
    times = _months(seeds, [e.table for s in schemas for e in s.edges], times, None)
    own = seeds.join(known.select(F.col("start").alias("Node_0"), TIME).distinct(), ["Node_0", TIME], "left_semi")
    return {n: (f.schema, f.between(known, once)) for n, f in factored(spark, own, schemas, times, simple, store=once).items()}


def recall(path: DataFrame, start: str) -> DataFrame:
    """Distinct start nodes that have a path."""
    return path.select(start).distinct()


def metapath(spark: SparkSession, spec: MetaPath, at: str | None = None, target: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Instances of a metapath: node columns and ``Weight_{k}`` (1 where a hop has no weight).

    ``at``: the one month taken; ``target``: rows of the first node's column.
    """
    path: DataFrame | None = None
    first = spec.hops[0].edge.head_name
    for k, hop in enumerate(spec.hops):
        e = hop.edge
        df = scan(spark, e.table, e.source)
        if e.time and at is not None:
            df = df.where(F.col(e.time) == at)
        for c in (e.head, *e.tails):
            df = df.where(present(df, c))
        if hop.scan_limit:
            df = df.where(F.expr(hop.scan_limit))
        weight = F.col(hop.weight) if hop.weight else F.lit(1)
        ids = [e.head_name, *e.tail_names]
        df = df.select(*[F.col(c).alias(n) for c, n in zip((e.head, *e.tails), ids)], weight.alias(f"Weight_{k}"))
        front = target if path is None else path
        if front is not None:
            if not bucketed(spark, e.table, e.source):
                df = dealt(df, [e.head_name])
            df = df.join(front.select(e.head_name).distinct(), e.head_name, "left_semi")
        df = collapse(df, ids, [f"Weight_{k}"])
        for node, name in zip(hop.lookups, hop.lookup_as):
            table = scan(spark, node.table, node.source)
            df = df.join(table.select(F.col(node.key).alias(name), *node.features), name, "left")
        if hop.lookup_limit:
            df = df.where(F.expr(hop.lookup_limit))
        df = df.select(*ids, f"Weight_{k}")
        if hop.scale > 0:
            df = top_n(df, [e.head_name], hop.scale, [f"Weight_{k}"], seed, ids) if hop.sampler == "top" else random_n(df, [e.head_name], hop.scale, seed, ids)
        path = df if path is None else path.join(df, e.head_name)
        if hop.join_limit:
            path = path.where(F.expr(hop.join_limit))
        if 0 < k < len(spec.hops) - 1:
            path = stored(path)
    if spec.tail_column:
        nodes = [c for h in spec.hops for c in (h.edge.head_name, *h.edge.tail_names)]
        keep = list(dict.fromkeys(nodes))
        path = path.select(*keep[: keep.index(spec.tail_column) + 1], *[c for c in path.columns if c.startswith("Weight_")])
    if spec.max_all <= 0:
        return path
    # A path is known by its nodes, unless some of them were cut off.
    nodes = list(dict.fromkeys(c for h in spec.hops for c in (h.edge.head_name, *h.edge.tail_names)))
    return random_n(path, [first], spec.max_all, seed, None if spec.tail_column else nodes)


def metapath_columns(path: DataFrame, spec: MetaPath, kind: str) -> DataFrame:
    """A metapath's projection: ``Head_And_Tail``, ``ALL_Nodes``, ``ALL_Edges``, ``ALL_Nodes_And_Edges`` or ``Tail_Edges``."""
    nodes = [c for c in dict.fromkeys(c for h in spec.hops for c in (h.edge.head_name, *h.edge.tail_names)) if c in path.columns]
    weights = [f"Weight_{k}" for k in range(len(spec.hops))]
    kinds = {"Head_And_Tail": [nodes[0], nodes[-1]], "ALL_Nodes": nodes, "ALL_Edges": [nodes[0], *weights], "ALL_Nodes_And_Edges": [*nodes, *weights], "Tail_Edges": [nodes[0], nodes[-1], weights[-1]]}
    if kind not in kinds:
        raise ValueError(f"unknown projection {kind!r}")
    out = path.select(*kinds[kind])
    return out.distinct() if kind in ("Head_And_Tail", "ALL_Nodes") else out


def subgraph(spark: SparkSession, seeds: DataFrame, seed_type: str, relations: Sequence[Relation], hops: int, scales: Sequence[int] = (), reverse_scales: Sequence[int] = (), times=None, seed: int = 0, samplers: dict[str, str] | None = None) -> DataFrame:
    """Edges within ``hops`` hops of (node, month) seeds: (hop, relation, Head, Tail, month, Weight).

    ``scales`` cap edges per seed node by hop and direction: 0 skips it, a negative one is no cap; a dict
    holds them by relation, and a relation without a scale for a hop is skipped there.  ``samplers``, by
    relation: ``top`` keeps the largest weights, else the choice is random.
    Frontiers are kept by node type; a node is a seed of the next hop however it was reached.
    """
    fronts = {seed_type: seeds.select(F.col(seeds.columns[0]).alias("node"), TIME).distinct()}
    times = frontier_months(seeds, [r.table for r in relations], times)
    out = []
    for hop in range(hops):
        reached: dict[str, list[DataFrame]] = {}
        for r in relations:
            for start, own, caps in (("Head", r.head_type, scales), ("Tail", r.tail_type, reverse_scales)):
                if isinstance(caps, dict):
                    cap = caps[r.name][hop] if hop < len(caps.get(r.name, ())) else 0
                else:
                    cap = caps[hop] if hop < len(caps) else -1
                if own not in fronts or cap == 0 or not r.enabled(start):
                    continue
                edge = replace(r.oriented(start, 0), head_as="node", tails_as=("other",))
                df, features = read_edges(spark, edge, times, fronts[own])
                df = df.select("node", "other", TIME, (F.col(features[0]) if features else F.lit(1)).cast("double").alias("Weight"))
                if cap > 0 and (samplers or {}).get(r.name) == "top":
                    df = top_n(df, ["node", TIME], cap, ["Weight"], seed, ["node", "other", TIME])
                elif cap > 0:
                    df = random_n(df, ["node", TIME], cap, seed, ["node", "other", TIME])
                if hop < hops - 1:
                    df = stored(df)  # what it reaches is the next frontier
                a, b = ("node", "other") if start == "Head" else ("other", "node")
                out.append(df.select(F.lit(hop).alias("hop"), F.lit(r.name).alias("relation"), F.col(a).cast("string").alias("Head"), F.col(b).cast("string").alias("Tail"), TIME, "Weight"))
                reached.setdefault(edge.tail_types[0], []).append(df.select(F.col("other").alias("node"), TIME))
        if hop < hops - 1:
            fronts = {t: stored(reduce(lambda a, b: a.unionByName(b), parts).distinct()) for t, parts in reached.items()}
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def node_ids(paths: Iterable[tuple[PathSchema, DataFrame] | Factored]) -> DataFrame:
    """(type, node, month) of every node on any path, once each; from the factors where these are given."""
    parts = []
    for found in paths:
        schema, *dfs = _node_sources(found) if isinstance(found, Factored) else found
        for i, t in enumerate(schema.node_types):
            df = next(df for df in dfs if f"Node_{i}" in df.columns)
            parts.append(df.select(F.lit(t).alias("node_type"), F.col(f"Node_{i}").cast("string").alias("node"), TIME).where(F.col("node").isNotNull()).distinct())
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def _node_sources(f: Factored) -> tuple[PathSchema, DataFrame] | tuple[PathSchema, DataFrame, DataFrame]:
    """Rows that hold the nodes of all paths: both factors, as every edge goes on from a path; where nodes must differ, the paths."""
    if f.differs is not None:
        return f.schema, f.paths()
    on = f.prefix if f.dead_ends else f.prefix.join(f.edges.select(f.last, TIME).distinct(), [f.last, TIME], "left_semi")
    return f.schema, on, f.edges

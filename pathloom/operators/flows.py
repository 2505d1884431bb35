"""Whole tasks in one call: link prediction data, metapath feature tables, subgraph data, readers of stored features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scaling, vectors
from ..plans.dialects import FeatureStore, MetaFeatures, Pairs, PathAggregation, Subgraph, Target
from ..plans.schema import TIME, NodeSpec, PathSchema, Relation
from ..sources.io import Checkpoint, scan, stored
from . import counting, pairing, paths
from .aggregate import aggregate, chunks, node_aggregate, publish
from .export import dense_index, subgraph_index
from .limits import row_range
from .nodes import combine_nodes, read_nodes

Found = dict[str, tuple[PathSchema, DataFrame]]


def aggregate_path(spark: SparkSession, spec: PathAggregation, tables: Mapping[str, Sequence[NodeSpec]], times=None, target: DataFrame | None = None) -> dict[str, DataFrame]:
    """Features of each named node of a fixed path, aggregated to its start; ``tables`` by node name."""
    path = stored(paths.sample_path(spark, spec.edges, times, target))  # each node's features read it
    return {n: node_aggregate(spark, path, spec.edges[0].head_name, n, tables[n], fns, times) for n, fns in spec.nodes.items()}


def known_pairs(spark: SparkSession, spec: Pairs) -> DataFrame:
    """Distinct (start, end, month) of the pairs' months."""
    df = scan(spark, spec.data, time=TIME, times=spec.times)
    return df.select(F.col(spec.start).alias("start"), F.col(spec.end).alias("end"), TIME).distinct()


def mine_pairs(
    spark: SparkSession, target: Target, pairs: Pairs, relations: Sequence[Relation], hops: int, max_main: int = 5, min_valid: int = 10, min_main: int = 50,
    min_rate: float = 1e-4, cache: Checkpoint | None = None,
) -> tuple[Found, DataFrame, list[str], list[str], DataFrame]:
    """(paths of the chosen schemas, summary, main schemas, auxiliary schemas, labelled samples): which typed paths explain the pairs.

    The summary comes from counts; paths are made for the chosen schemas only.
    """
    if pairs.start_type != target.node_type:
        raise ValueError(f"pairs start at {pairs.start_type}, paths at {target.node_type}")
    nodes = scan(spark, target.nodes, time=TIME, times=target.times).select(F.col(target.column).alias("Node_0"), TIME)
    known = known_pairs(spark, pairs)
    end_type = target.end_type or pairs.end_type
    summary = stored(counting.cover_counts(spark, nodes, target.node_type, relations, hops, known, end_type, target.times))
    main, aux = pairing.choose_main(summary, max_main, min_valid, min_main, min_rate)
    if not main:
        raise ValueError("no path schema explains enough pairs")
    chosen = [s for s in paths.schemas_of(target.node_type, relations, hops, end_type) if s.name in (*main, *aux)]
    found = paths.follow_all(spark, nodes, chosen, target.times, dead_ends=True, cache=cache)
    return found, summary, main, aux, pairing.sample_pairs(found, main, known)


@dataclass(frozen=True)
class LinkData:
    """Samples and paths by split; schemas by role."""

    main: list[str]
    aux: list[str]
    summary: DataFrame
    samples: dict[str, DataFrame]
    paths: dict[str, Found]


def link_data(
    spark: SparkSession, labels: DataFrame, start: str, end: str, start_type: str, end_type: str, relations: Sequence[Relation], hops: int,
    ranges: Mapping[str, tuple[str, str]], train: str = "Train", **chosen,
) -> LinkData:
    """Schemas and samples from the pairs of the training range, and the same schemas replayed on the other ranges.

    ``labels``: (start, end, month, Source_Time) of known pairs; ``ranges`` are [from, to) of
    ``Source_Time``; ``chosen`` goes to ``mine_pairs``.
    """
    inside = lambda r: (F.col("Source_Time") >= r[0]) & (F.col("Source_Time") < r[1])
    own = labels.where(inside(ranges[train]))
    spec = Pairs(own, start, end, start_type, end_type)
    found, summary, main, aux, samples = mine_pairs(spark, Target(own, start_type, start, end_type), spec, relations, hops, **chosen)
    samples = stored(samples)
    nodes = own.select(F.col(start).alias("Node_0"), TIME)
    known_aux = paths.between(spark, nodes, [found[n][0] for n in aux], samples)
    out = LinkData(main, aux, summary, {train: samples}, {train: {n: found[n] for n in main} | known_aux})
    others = {k: r for k, r in ranges.items() if k != train}
    if not others:
        return out
    rest = labels.where(reduce(lambda a, b: a | b, [inside(r) for r in others.values()]))
    known = known_pairs(spark, Pairs(rest, start, end, start_type, end_type))
    seeds = rest.select(F.col(start).alias("Node_0"), TIME)
    replayed = {n: (s, stored(df)) for n, (s, df) in paths.follow_all(spark, seeds, [found[n][0] for n in main]).items()}
    connected = stored(pairing.label_connected([replayed[n] for n in main], known).withColumn("Label", F.col("Label").cast("int")))
    # Auxiliary schemas' paths are made between the samples only: all of them may be as many as starts times ends.
    replayed |= {n: (s, stored(df)) for n, (s, df) in paths.between(spark, seeds, [found[n][0] for n in aux], connected).items()}
    starts = rest.select(F.col(start).alias("start"), TIME, "Source_Time").distinct()
    timed = pairing.split_by_time(connected, starts, others)
    for k in others:
        out.samples[k] = timed.where(F.col("split") == k).drop("split")
        times = starts.where(inside(others[k])).select(F.col("start").alias("Node_0"), TIME).distinct()
        out.paths[k] = {n: (s, df.join(times, ["Node_0", TIME], "left_semi")) for n, (s, df) in replayed.items()}
    return out


def metapath_tables(spark: SparkSession, spec: MetaFeatures, tables: Mapping[str, Sequence[NodeSpec]], at: str | None = None, target: DataFrame | None = None) -> dict[str, DataFrame]:
    """A table of aggregates per start for each column that the projection has.

    A node column gives the features of its nodes (``tables`` by column), a weight column
    the statistics of the weights; both over the rows of the projection.
    """
    path = paths.metapath(spark, spec.path, at, target)
    rows = stored(paths.metapath_columns(path, spec.path, spec.columns))
    start, *rest = rows.columns
    out = {}
    for c in rest:
        if c.startswith("Weight_"):
            out[c] = aggregate(rows, [start], [c], spec.functions)
        elif c in tables:
            nodes, features = combine_nodes(spark, [NodeSpec(t.table, t.key, t.features, t.source, None) for t in tables[c]], "__node", fill=None)
            joined = rows.select(start, F.col(c).alias("__node")).join(nodes, "__node", "left")
            out[c] = aggregate(joined, [start], features, spec.functions)
    return out


def publish_metapath(spark: SparkSession, spec: MetaFeatures, tables: Mapping[str, Sequence[NodeSpec]], name: str, at: str, root: str | None = None) -> list[str]:
    """Write ``metapath_tables`` as partitions of ORC tables, one set of tables per column; returns their names."""
    written = []
    for c, df in metapath_tables(spark, spec, tables).items():
        keys, features = df.columns[:1], df.columns[1:]
        most = spec.most_columns or max(1, len(features))
        for i, own in enumerate(chunks(features, ("MAX",), most)):
            part = f"{name}_{c}" if len(features) <= most else f"{name}_{c}_{i}"
            # A row per start already: its value is its own maximum.
            rows = df.select(*keys, *own)
            written += publish(rows, keys, own, part.lower(), at, ("MAX",), f"{part}_summary".lower() if spec.summary else None, max(1, len(own)), root)
    return written


def subgraph_data(spark: SparkSession, seeds: DataFrame, seed_type: str, spec: Subgraph, hops: int, tables: Mapping[str, Sequence[NodeSpec]], times=None, seed: int = 0) -> dict[str, DataFrame]:
    """``edges`` of the subgraph, ``nodes`` with dense indices, indexed ``links``, and the features of each node type's nodes."""
    edges = stored(paths.subgraph(spark, seeds, seed_type, spec.relations, hops, spec.scales, spec.reverse_scales, times, seed, spec.samplers))
    kinds = {r.name: (r.head_type, r.tail_type) for r in spec.relations}
    ends = []
    for k, column in enumerate(("Head", "Tail")):
        kind = reduce(lambda c, kv: c.when(F.col("relation") == kv[0], kv[1][k]), kinds.items(), F)
        ends.append(edges.select(kind.alias("node_type"), F.col(column).alias("node"), TIME))
    own = seeds.select(F.lit(seed_type).alias("node_type"), F.col(seeds.columns[0]).cast("string").alias("node"), TIME)
    every = stored(ends[0].unionByName(ends[1]).unionByName(own).distinct())
    index = dense_index(every, ["node_type", "node", TIME])
    head, tail = (reduce(lambda c, kv, k=k: c.when(F.col("relation") == kv[0], kv[1][k]), kinds.items(), F) for k in (0, 1))
    named = edges.withColumns({"Head": F.concat_ws("/", head, "Head"), "Tail": F.concat_ws("/", tail, "Tail")})
    links = subgraph_index(named, index.select(F.concat_ws("/", "node_type", "node").alias("node"), TIME, "index"))
    out = {"edges": edges, "nodes": index, "links": links}
    for kind, specs in tables.items():
        target = every.where(F.col("node_type") == kind).select("node", TIME)
        out[kind] = combine_nodes(spark, specs, "node", times, target)[0]
    return out


def read_vectors(spark: SparkSession, specs: Sequence[NodeSpec], targets: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Vectors of the targets (node, month) that any table has, concatenated in the tables' order; missing ones are zeros.

    A table's width is that of its longest vector among the targets' (a row per table reaches the driver).
    """
    keys, own = [name, TIME], []
    for spec in specs:
        df = scan(spark, spec.table, spec.source).withColumnsRenamed({spec.key: name} | ({spec.time: TIME} if spec.time else {}))
        own.append(stored(df.where(F.col(name).isNotNull()).select(*keys, *columns).join(targets.select(*keys).distinct(), keys)))
    widths = [df.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)).alias(c) for c in columns]).first() for df in own]
    merged = [vectors.merge_vectors([df.select(*keys, c) for df in own], keys, c, [w[c] for w in widths]) for c in columns]
    return reduce(lambda a, b: a.join(b, keys), merged)


def load_vectors(
    spark: SparkSession, store: FeatureStore, targets: DataFrame, name: str, columns: Sequence[str] = ("Feature_Raw", "Feature_Normalized"), without: Sequence[str] = (), without_columns: Mapping[str, Sequence[int]] | None = None
) -> dict[str, DataFrame | dict[int, DataFrame]]:
    """``Target_Node`` and, by path, the vectors of each of its columns; some paths or columns may be left out."""
    out: dict = {"Target_Node": read_vectors(spark, store.start, targets, name, columns)} if store.start else {}
    for path in sorted(set(store.paths) - set(without)):
        gone = (without_columns or {}).get(path, ())
        out[path] = {i: read_vectors(spark, specs, targets, name, columns) for i, (_, specs) in enumerate(store.paths[path]) if i not in gone}
    return out


def ml_table(spark: SparkSession, store: FeatureStore, targets: DataFrame, name: str, kinds: Sequence[str] = ("norm", "std"), start: int | None = None, end: int | None = None) -> DataFrame:
    """Targets with all numeric features of the store's tables, raw and scaled: ``{part}^{column}_{kind}``.

    Statistics are those of all targets, or of the stored profile where the store names one
    for a table; ``start`` and ``end`` then take the targets with places in
    [start, end) of the (node, month) order.  Missing features are 0.
    """
    if unknown := set(kinds) - {"raw", "norm", "std"}:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    keys = [name, TIME]
    parts = {"Start_Node": store.start} if store.start else {}
    parts |= {f"{p}^{i}": specs for p, columns in sorted(store.paths.items()) for i, (_, specs) in enumerate(columns)}
    out, features, known = targets, [], []
    for part, specs in parts.items():
        for k, spec in enumerate(specs):
            df, own = read_nodes(spark, spec, name, fill=None)
            names = {f: f"{part}^{k}^{f}" if len(specs) > 1 else f"{part}^{f}" for f in own}
            out = out.join(df.withColumnsRenamed(names), keys, "left")
            features += names.values()
            if part in store.summaries:
                profile = scan(spark, store.summaries[part][k])
                known += [(profile, {f: n for f, n in names.items()})]
    out = stored(out.fillna(0, features))
    plain = {f: f"__f{i}" for i, f in enumerate(features)}
    scaled = out.withColumnsRenamed(plain)
    for profile, names in known:
        renamed = reduce(lambda c, kv: c.when(F.col("feature") == kv[0], plain[kv[1]]), names.items(), F)
        scaled = scaling.eps_scaled(scaled, [plain[n] for n in names.values()], profile.withColumn("feature", renamed))
    if own := [p for f, p in plain.items() if not any(f in names.values() for _, names in known)]:
        scaled = scaling.eps_scaled(scaled, own)
    picked = [F.col(f"{p}{'' if k == 'raw' else '_' + k}").alias(f"{f}_{k}") for f, p in plain.items() for k in kinds]
    scaled = scaled.select(*targets.columns, *picked)
    return scaled if start is None and end is None else row_range(scaled, keys, start or 0, end if end is not None else 1 << 62)

"""Counts of paths without the paths.

Per schema the state is (start, last node, month) -> number of paths.  A hop joins the
state with its edges and sums over the nodes left behind, so rows are as many as
(start, node) pairs, however many paths lie between them.  Nodes that a later hop has
to differ from (their type comes again) stay in the state; all others are summed out.

The last hop is not expanded either: totals need the number of edges per last-but-one
node only, and covered pairs are found by joining the known pairs with the edges from
their ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import TIME, PathSchema, Relation
from ..sources.io import stored
from .edges import frontier_months, read_edges
from .pairing import PAIR, cover_rates
from .paths import Factored, reaches, simple_path, steps


def _needed(types: Sequence[str], grown: Sequence[Sequence[str]], simple: bool) -> list[str]:
    """Inner nodes of a path of ``types`` whose type comes again in a continuation (lists of further types); the start always stays."""
    if not simple:
        return []
    later = {t for more in grown for t in more}
    return [f"Node_{i}" for i, t in enumerate(types[:-1]) if i and t in later]


def _continuations(schema: PathSchema, relations: Sequence[Relation], hops: int, reach) -> list[tuple[str, ...]]:
    """The types that can follow a schema in the hops left."""
    left = hops - len(schema.edges)
    if not left:
        return []
    out = []
    for edge in steps(schema, relations, hops, reach):
        grown = schema.extend(edge)
        out += [(grown.end_type, *more) for more in [(), *_continuations(grown, relations, hops, reach)]]
    return out


def cover_counts(
    spark: SparkSession, seeds: DataFrame, seed_type: str, relations: Sequence[Relation], hops: int, pairs: DataFrame, end_type: str | None = None, times=None, simple: bool = True, dead_ends: bool = True
) -> DataFrame:
    """``pairing.cover_summary`` of ``paths.enumerate_khop`` with the same arguments, from counts alone."""
    reach = reaches(relations, end_type, hops) if end_type else None
    times = frontier_months(seeds, [r.table for r in relations], times)
    known = stored(pairs.select(*PAIR).distinct())
    level = [(PathSchema(seed_type), stored(seeds.select(F.col("Node_0"), TIME).distinct().withColumn("__n", F.lit(1).cast("long"))))]
    parts = []
    for hop in range(hops):
        grown = []
        for schema, state in level:
            front = state.select(schema.end, TIME).where(F.col(schema.end).isNotNull()).distinct()
            for edge in steps(schema, relations, hops, reach):
                longer = schema.extend(edge)
                ids = [schema.end, longer.end, TIME]
                ends_here = end_type is None or longer.end_type == end_type
                last = hop == hops - 1
                edges = read_edges(spark, edge, times, front)[0].select(*ids)
                differs = simple_path(longer, longer.end) if simple else None
                if last and differs is None:
                    parts.append(_closed(longer, state, stored(edges), known, dead_ends))
                    continue
                if last:
                    keep = ["Node_0", longer.end]
                else:
                    more = _continuations(longer, relations, hops, reach)
                    keep = list(dict.fromkeys(["Node_0", *_needed(longer.node_types, more, simple), longer.end]))
                joined = state.join(edges, [schema.end, TIME], "left" if dead_ends else "inner")
                if differs is not None:
                    joined = joined.where(differs)
                made = joined.groupBy(*keep, TIME).agg(F.sum("__n").alias("__n"))
                if not last:
                    made = stored(made)
                    grown.append((longer, made))
                if ends_here:
                    parts.append(_counted(longer, made, known))
        level = grown
    return cover_rates(reduce(DataFrame.unionAll, parts), known)


_SUMS = ("schema", "path_count", "path_cover_count", "pair_cover_count")


def _counted(schema: PathSchema, state: DataFrame, known: DataFrame) -> DataFrame:
    """Sums of a schema from its counts by (start, end, month)."""
    counts = state.groupBy(F.col("Node_0").alias("start"), F.col(schema.end).alias("end"), TIME).agg(F.sum("__n").alias("n"))
    hit = F.col("__known").isNotNull()
    sums = counts.join(known.withColumn("__known", F.lit(1)), list(PAIR), "left").agg(
        F.count("*").alias("rows"), F.sum("n").alias("path_count"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("path_cover_count"), F.count_if(hit).alias("pair_cover_count")
    )
    return sums.where("rows > 0").select(F.lit(schema.name).alias("schema"), *_SUMS[1:])


def _closed(schema: PathSchema, state: DataFrame, edges: DataFrame, known: DataFrame, dead_ends: bool) -> DataFrame:
    """Sums of a schema whose last hop needs no comparison: from degrees and from the pairs' ends."""
    at = schema.edges[-1].head_name
    degrees = edges.groupBy(at, TIME).agg(F.count("*").alias("__d"))
    paths = state.join(degrees, [at, TIME], "left").agg(F.sum(F.col("__n") * F.coalesce("__d", F.lit(1 if dead_ends else 0))).alias("path_count"))
    before = known.join(edges.withColumnRenamed(schema.end, "end"), ["end", TIME])
    start = state.groupBy(F.col("Node_0").alias("start"), at, TIME).agg(F.sum("__n").alias("__n"))
    covered = before.join(start, ["start", at, TIME]).groupBy(*PAIR).agg(F.sum("__n").alias("n"))
    hits = covered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("path_cover_count"), F.count("*").alias("pair_cover_count"))
    return paths.join(F.broadcast(hits)).where("path_count > 0").select(F.lit(schema.name).alias("schema"), *_SUMS[1:])  # a row each


def path_counts(found: Iterable[Factored]) -> DataFrame:
    """(schema, n_paths, n_ended) of all paths and of those without an end, from their factors."""
    return reduce(DataFrame.unionAll, [_tally(f, f.prefix, f.edges).select("schema", "n_paths", "n_ended") for f in found])


def shared_counts(found: Iterable[tuple[Factored, Factored]]) -> DataFrame:
    """(schema, n_same): the paths that two enumerations of a schema have in common."""
    parts = []
    for a, b in found:
        own = _tally(a, a.prefix.intersectAll(b.prefix), a.edges.intersectAll(b.edges.select(*a.edges.columns)), a.edges.unionByName(b.edges))
        parts.append(own.select("schema", F.col("n_paths").alias("n_same")))
    return reduce(DataFrame.unionAll, parts)


def _tally(f: Factored, prefix: DataFrame, edges: DataFrame, going_on: DataFrame | None = None) -> DataFrame:
    """A row, if there is a path: per node where the factors meet, ways in times edges out.

    Ways at nodes without an edge in ``going_on`` (``edges`` by default) end there.  Where the new node has to differ from
    earlier ones, which differ from each other, the returns are counted for each and taken off.
    """
    at, back = [f.last, TIME], [f"Node_{i}" for i, t in enumerate(f.schema.node_types[:-1]) if t == f.schema.end_type] if f.simple else []
    ways = prefix.groupBy(*at).agg(F.count("*").alias("__w"))
    degrees = edges.groupBy(*at).agg(F.count("*").alias("__d"))
    met = ways.join(degrees, at, "left")
    if going_on is not None:
        met = met.join(going_on.select(*at).distinct().withColumn("__on", F.lit(True)), at, "left")
    ends = F.col("__d" if going_on is None else "__on").isNull()
    ended = F.when(ends, F.col("__w")).otherwise(0) if f.dead_ends and not back else F.lit(0).cast("long")
    sums = met.agg(
        F.coalesce(F.sum(F.col("__w") * F.coalesce("__d", F.lit(0))), F.lit(0)).alias("__through"), F.coalesce(F.sum(ended), F.lit(0)).alias("n_ended")
    )
    through = F.col("__through")
    for k, node in enumerate(back):
        keys = edges.select(*at, F.col(f.schema.end).alias("__back"))
        again = prefix.select(*at, F.col(node).alias("__back")).join(keys, [*at, "__back"]).agg(F.count("*").alias(f"__r{k}"))
        sums, through = sums.join(F.broadcast(again)), through - F.col(f"__r{k}")  # a row each
    return sums.select(F.lit(f.schema.name).alias("schema"), (through + F.col("n_ended")).alias("n_paths"), "n_ended").where("n_paths > 0")

"""Edge tables: scan, clean, restrict, collapse, limit - in this order.

Only edges of the frontier are aggregated: Catalyst does not move a semi join
below an aggregate by itself, so it is written here.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import numeric_columns, sanitize
from ..plans.schema import TIME, EdgeSpec, Relation
from ..sources.io import bucketed, dealt, scan, write_bucketed
from .limits import apply_limit


def present(df: DataFrame, column: str) -> Column:
    """Not null and, for strings, not empty."""
    kind = df.schema[column].dataType
    ok = F.col(column).isNotNull()
    return ok & (F.col(column) != "") if isinstance(kind, T.StringType) else ok


def collapse(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Parallel edges as one: features are summed; without features rows are made distinct."""
    if not features:
        return df.select(*ids).distinct()
    return df.groupBy(*ids).agg(*[F.sum(f).alias(f) for f in features])


def frontier_months(seeds: DataFrame, tables: Iterable, times: Iterable[str] | None) -> list[str] | None:
    """The months to read: those given, or, where edges lie in storage, those of the seeds (a row per month).

    Hops never cross months, so a path's edges are all of its seed's month: with the
    months as literals a scan opens only their partitions.
    """
    if times is not None:
        return list(times)
    if TIME not in seeds.columns or all(isinstance(t, DataFrame) for t in tables):
        return None
    return sorted(r[0] for r in seeds.select(TIME).distinct().collect())


def read_edges(spark: SparkSession, spec: EdgeSpec, times: Iterable[str] | None = None, frontier: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(edges, feature names): columns are the ids, the month and the features.

    ``frontier``: (head, month) rows; other edges are dropped before anything is summed.
    """
    df = scan(spark, spec.table, spec.source, spec.time, times)
    if spec.scan_limit:
        df = df.where(F.expr(spec.scan_limit))
    raw = [spec.head, *spec.tails]
    names = [spec.head_name, *spec.tail_names]
    for c in raw:
        df = df.where(present(df, c))
    df = df.withColumnsRenamed(dict(zip(raw, names)) | ({spec.time: TIME} if spec.time and spec.time != TIME else {}))
    df = sanitize(df)
    ids = [*names, *([TIME] if spec.time else [])]
    features = list(spec.features) if spec.features is not None else numeric_columns(df, ids)
    df = df.select(*ids, *features)
    if frontier is not None:
        keys = [c for c in (spec.head_name, TIME) if c in frontier.columns and c in ids]
        if not bucketed(spark, spec.table, spec.source):
            df = dealt(df, keys)
        df = df.join(frontier.select(*keys), keys, "left_semi")
    df = collapse(df, ids, features)
    if spec.edge_limit:
        df = df.where(F.expr(spec.edge_limit))
    for limit in spec.node_limits:
        df = node_limited(spark, df, limit, times)
    return apply_limit(df, [spec.head_name], spec.neighbor_limit, by=ids), features


def node_limited(spark: SparkSession, df: DataFrame, limit, times: Iterable[str] | None = None) -> DataFrame:
    """Rows whose endpoint's features satisfy a predicate."""
    from .nodes import combine_nodes

    keys = [limit.node, *([TIME] if TIME in df.columns else [])]
    nodes, _ = combine_nodes(spark, limit.tables, limit.node, times, prefix=False, target=df.select(*keys).distinct())
    good = nodes.where(F.expr(limit.predicate)).select(*keys)
    return df.join(good, keys, "left_semi").select(*df.columns)


def store_relation(spark: SparkSession, relation: Relation, name: str, buckets: int, at: str | None = None, times: Iterable[str] | None = None) -> Relation:
    """The relation over two stored tables, ``{name}_head`` and ``{name}_tail``: its edges, cleaned and summed, bucketed by (head, month) and by (tail, month).

    A hop joins on (node, month) and sums by more columns than these, so it reads either table
    without an exchange of edges; only the paths move.  Filters on edges and neighbour limits stay with the hops.
    """
    plain = EdgeSpec(relation.table, relation.head, (relation.tail,), source=relation.source, time=relation.time, features=relation.features, scan_limit=relation.scan_limit)
    edges, features = read_edges(spark, plain, times)
    timed = relation.time is not None
    if timed:
        edges = edges.withColumn(TIME, F.col(TIME).cast("string"))  # folder names may have been read as dates
    for side, key in (("head", relation.head), ("tail", relation.tail)):
        write_bucketed(edges.withColumnRenamed(TIME, "dt"), f"{name}_{side}", [key, *(["dt"] if timed else [])], buckets, f"{at}/{side}" if at else None)
    return replace(relation, table=f"{name}_head", tail_table=f"{name}_tail", source="table", time="dt" if timed else None, features=tuple(features), scan_limit=None)

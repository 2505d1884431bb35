"""Readers of the composed JSON forms: path aggregations, targets, pairs, metapath features, subgraphs, feature stores."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .schema import SAMPLERS, EdgeSpec, MetaPath, NodeSpec, Relation, SpecError, _only, _several, metapath_spec, path_spec

# Functions of an aggregation that names none.
NODE_AGGREGATES = ("AVG", "MAX", "MIN")


@dataclass(frozen=True)
class PathAggregation:
    """A fixed path and, for some of its nodes, the functions that bring their features to its start."""

    edges: tuple[EdgeSpec, ...]
    nodes: dict[str, tuple[str, ...]]


# Keys of a path aggregation.
AGGREGATION_KEYS = ("path_config", "aggregation_nodes", "node_agg_funcs", "node_agg_funcs_list")


def path_aggregation(config: dict) -> PathAggregation:
    """``node_agg_funcs_list`` has functions per node, ``node_agg_funcs`` the same for all."""
    _only(config, AGGREGATION_KEYS, "path aggregation")
    names = _several(config.get("aggregation_nodes"))
    if not names or "path_config" not in config:
        raise SpecError("path aggregation: a path and nodes are needed")
    edges = path_spec(config["path_config"])
    known = {edges[0].head_name, *[n for e in edges for n in e.tail_names]}
    if unknown := set(names) - known:
        raise SpecError(f"path aggregation: the path has no nodes {sorted(unknown)}")
    lists = config.get("node_agg_funcs_list")
    if lists is not None and len(lists) != len(names):
        raise SpecError("path aggregation: as many lists of functions as nodes are needed")
    each = lists if lists is not None else [config.get("node_agg_funcs", NODE_AGGREGATES)] * len(names)
    return PathAggregation(edges, {n: tuple(_several(f)) for n, f in zip(names, each)})


@dataclass(frozen=True)
class Target:
    """Nodes that paths start from."""

    nodes: Any
    node_type: str
    column: str
    end_type: str | None = None
    times: tuple[str, ...] | None = None


# Keys of a k-hop target.
TARGET_KEYS = ("Target_Node_df", "Target_Node_Type", "Target_Node_UID_name", "End_Node_Type", "Feature_Times")


def khop_target(config: dict) -> Target:
    _only(config, TARGET_KEYS, "k-hop target")
    if missing := {"Target_Node_df", "Target_Node_Type", "Target_Node_UID_name"} - set(config):
        raise SpecError(f"k-hop target: {sorted(missing)} are needed")
    return Target(config["Target_Node_df"], config["Target_Node_Type"], config["Target_Node_UID_name"], config.get("End_Node_Type"), _several(config.get("Feature_Times")))


@dataclass(frozen=True)
class Pairs:
    """Known pairs of start and end nodes."""

    data: Any
    start: str
    end: str
    start_type: str
    end_type: str
    times: tuple[str, ...] | None = None


# Keys of a table of pairs.
PAIR_KEYS = ("Pair_Data", "Start_Node_name", "End_Node_name", "Start_Node_Type", "End_Node_Type", "Feature_Times")


def pair_spec(config: dict) -> Pairs:
    _only(config, PAIR_KEYS, "pairs")
    if missing := set(PAIR_KEYS[:5]) - set(config):
        raise SpecError(f"pairs: {sorted(missing)} are needed")
    return Pairs(*[config[k] for k in PAIR_KEYS[:5]], _several(config.get("Feature_Times")))


@dataclass(frozen=True)
class MetaFeatures:
    """A metapath and how its nodes' features and weights become a table per column."""

    path: MetaPath
    functions: tuple[str, ...] = NODE_AGGREGATES
    columns: str = "Head_And_Tail"
    most_columns: int | None = None
    summary: bool = False
    comment: str | None = None


# Keys that metapath features add to a metapath's.
META_FEATURE_KEYS = ("Groupby_Type_List", "Table_Name_Comment", "Output_Columns_Type", "Max_Column_Number", "Output_Summary")


def metapath_features(config: dict) -> MetaFeatures:
    """``Output_Summary`` is the word "True"; ``Max_Column_Number`` below 1 means no bound."""
    own = {k: v for k, v in config.items() if k in META_FEATURE_KEYS}
    path = metapath_spec({k: v for k, v in config.items() if k not in META_FEATURE_KEYS})
    most = int(own.get("Max_Column_Number", -1))
    return MetaFeatures(
        path, tuple(own.get("Groupby_Type_List", NODE_AGGREGATES)), own.get("Output_Columns_Type", "Head_And_Tail"), most if most > 0 else None, own.get("Output_Summary") in ("True", True), own.get("Table_Name_Comment")
    )


@dataclass(frozen=True)
class Subgraph:
    """Relations of a subgraph, with caps by relation for each hop and direction."""

    relations: tuple[Relation, ...]
    scales: dict[str, tuple[int, ...]] = field(default_factory=dict)
    reverse_scales: dict[str, tuple[int, ...]] = field(default_factory=dict)
    samplers: dict[str, str] = field(default_factory=dict)


# Keys of a relation of a subgraph.
SUBGRAPH_KEYS = (
    "Head_Column_name", "Tail_Column_name", "Head_Node_class", "Tail_Node_class", "Relation_Data", "Relation_Data_Source", "Weight_Column", "Limits",
    "Max_Sample_Scale_list", "Reverse_Max_Sample_Scale_list", "Max_Sample_Type",
)


def subgraph_spec(config: dict[str, dict]) -> Subgraph:
    """Both lists of scales bound the hops of a relation: where one ends, it is not followed."""
    relations, forward, backward, samplers = [], {}, {}, {}
    for name, c in config.items():
        _only(c, SUBGRAPH_KEYS, f"relation {name}")
        kind = c.get("Max_Sample_Type", "Random")
        if kind not in SAMPLERS:
            raise SpecError(f"relation {name}: unknown sampler {kind!r}")
        weight = c.get("Weight_Column") or None
        relations.append(Relation(name, c["Relation_Data"], c["Head_Column_name"], c["Head_Node_class"], c["Tail_Column_name"], c["Tail_Node_class"], c.get("Relation_Data_Source", "table"), features=(weight,) if weight else (), scan_limit=c.get("Limits") or None))
        hops = min(len(c["Max_Sample_Scale_list"]), len(c["Reverse_Max_Sample_Scale_list"]))
        forward[name], backward[name] = tuple(c["Max_Sample_Scale_list"][:hops]), tuple(c["Reverse_Max_Sample_Scale_list"][:hops])
        samplers[name] = SAMPLERS[kind]
    return Subgraph(tuple(relations), forward, backward, samplers)


@dataclass(frozen=True)
class FeatureStore:
    """Tables of aggregated features: of the start nodes, and of each column of each path."""

    start: tuple[NodeSpec, ...]
    paths: dict[str, tuple[tuple[str, tuple[NodeSpec, ...]], ...]]  # (node class, tables) of each column
    summaries: dict[str, tuple[str, ...]] = field(default_factory=dict)  # by path and column ("p^0"): stored profiles of its tables


# Keys of a feature store, and the column that tables of paths go by.
STORE_KEYS, COLUMN_KEYS, START_COLUMN = ("Start_Node_Feature_Table_List", "Meta_Path_Feature_Table_List"), ("Node_class", "Feature_Table_List", "Feature_Table_Summary_List"), "Start_Column"


def feature_store(config: dict) -> FeatureStore:
    _only(config, STORE_KEYS, "feature store")
    start = []
    for c in config.get("Start_Node_Feature_Table_List", []):
        _only(c, ("Table_Name", "UID", "Source"), "feature store, start table")
        start.append(NodeSpec(c["Table_Name"], c["UID"], source=c.get("Source", "table")))
    paths, summaries = {}, {}
    for name, columns in config.get("Meta_Path_Feature_Table_List", {}).items():
        for i, c in enumerate(columns):
            _only(c, COLUMN_KEYS, f"feature store, path {name}")
            if own := c.get("Feature_Table_Summary_List"):
                if len(own) != len(c["Feature_Table_List"]):
                    raise SpecError(f"feature store, path {name}: as many summaries as tables are needed")
                summaries[f"{name}^{i}"] = tuple(own)
        paths[name] = tuple((c["Node_class"], tuple(NodeSpec(t, START_COLUMN) for t in c["Feature_Table_List"])) for c in columns)
    return FeatureStore(tuple(start), paths, summaries)

"""Immutable specifications of queries, and readers of their JSON forms.

All readers reject unknown keys by name.  Keys are the query language's own
words and are listed as fixed values beside each reader.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

TIME = "Feature_Time"


class SpecError(ValueError):
    """A specification that can't be understood."""


@dataclass(frozen=True)
class NeighborLimit:
    """At most ``n`` rows a key: ``threshold`` drops larger keys, ``top`` and ``random`` cut them."""

    kind: str
    n: int
    features: tuple[str, ...] = ()
    by_time: bool = True
    seed: int = 0

    def __post_init__(self):
        if self.kind not in ("threshold", "top", "random"):
            raise SpecError(f"unknown neighbour limit {self.kind!r}")
        if self.kind == "top" and not self.features:
            raise SpecError("a top limit needs feature columns")


@dataclass(frozen=True)
class NodeSpec:
    """A table of node features."""

    table: Any
    key: str
    features: tuple[str, ...] | None = None
    source: str = "table"
    time: str | None = "dt"


@dataclass(frozen=True)
class NodeLimit:
    """A predicate on the features of one endpoint."""

    node: str
    tables: tuple[NodeSpec, ...]
    predicate: str


@dataclass(frozen=True)
class EdgeSpec:
    """One relation: a head column, one or more tail columns, features, limits."""

    table: Any
    head: str
    tails: tuple[str, ...]
    head_as: str | None = None
    tails_as: tuple[str, ...] | None = None
    head_type: str | None = None
    tail_types: tuple[str, ...] | None = None
    source: str = "table"
    time: str | None = "dt"
    features: tuple[str, ...] | None = None
    edge_limit: str | None = None
    node_limits: tuple[NodeLimit, ...] = ()
    neighbor_limit: NeighborLimit | None = None
    path_limit: str | None = None
    path_neighbor_limit: NeighborLimit | None = None
    name: str | None = None
    scan_limit: str | None = None

    @property
    def head_name(self) -> str:
        return self.head_as or self.head

    @property
    def tail_names(self) -> tuple[str, ...]:
        return self.tails_as or self.tails


@dataclass(frozen=True)
class Relation:
    """A relation of a typed graph, with the limits of each direction of traversal."""

    name: str
    table: Any
    head: str
    head_type: str
    tail: str
    tail_type: str
    source: str = "table"
    time: str | None = "dt"
    features: tuple[str, ...] | None = None
    limits: dict[str, dict[str, Any]] = field(default_factory=dict)  # by "Head" / "Tail", the end it starts from
    scan_limit: str | None = None
    tail_table: Any = None  # the same edges laid out for hops that start from the tail

    def oriented(self, start: str, hop: int) -> EdgeSpec:
        """The relation as the edge of a hop that starts from its ``Head`` or its ``Tail``."""
        own = self.limits.get(start, {})
        ends = [(self.head, self.head_type), (self.tail, self.tail_type)]
        (a, at), (b, bt) = ends if start == "Head" else ends[::-1]
        table = self.tail_table if start == "Tail" and self.tail_table is not None else self.table
        return EdgeSpec(
            table, a, (b,), f"Node_{hop}", (f"Node_{hop + 1}",), at, (bt,), self.source, self.time, self.features,
            own.get("edge_limit"), own.get("node_limits", ()), own.get("neighbor_limit"), name=f"{self.name}:{start}", scan_limit=self.scan_limit,
        )

    def enabled(self, start: str) -> bool:
        limit = self.limits.get(start, {}).get("neighbor_limit")
        return limit is None or limit.n > 0


@dataclass(frozen=True)
class PathSchema:
    """An ordered list of oriented edges; its name is its content."""

    start_type: str
    edges: tuple[EdgeSpec, ...] = ()

    @property
    def name(self) -> str:
        return "/".join([self.start_type, *[f"{e.name}>{e.tail_types[0]}" for e in self.edges]])

    @property
    def node_types(self) -> tuple[str, ...]:
        return (self.start_type, *[e.tail_types[0] for e in self.edges])

    @property
    def end_type(self) -> str:
        return self.node_types[-1]

    @property
    def end(self) -> str:
        return f"Node_{len(self.edges)}"

    def extend(self, edge: EdgeSpec) -> "PathSchema":
        return replace(self, edges=(*self.edges, edge))


@dataclass(frozen=True)
class LabelSpec:
    """A label table: endpoints, label and event time."""

    table: Any
    columns: tuple[str, ...]
    names: tuple[str, ...]
    label: str
    time: str
    source: str = "table"
    dt: str | None = None
    limits: str | None = None
    split_limits: dict[str, str] = field(default_factory=dict)
    label_map: dict[Any, Any] = field(default_factory=dict)
    label_range: tuple[Any, ...] | None = None
    max_rows: int | None = None
    split_max_rows: dict[str, int] = field(default_factory=dict)
    months: int = 1  # months of features that each label's nodes need, its own the last


def load_json(path: str) -> Any:
    """A JSON file; malformed text is reported with its place."""
    with open(path, encoding="utf-8") as f:
        try:
            return json.load(f)
        except json.JSONDecodeError as e:
            raise SpecError(f"{path}: line {e.lineno}, column {e.colno}: {e.msg}") from e


def _only(config: dict, allowed: Iterable[str], what: str, ignored: Iterable[str] = ()) -> dict:
    for k in set(config) & set(ignored):
        warnings.warn(f"{what}: {k} has no effect", stacklevel=3)
    if unknown := set(config) - set(allowed) - set(ignored):
        raise SpecError(f"{what}: unknown keys {sorted(unknown)}")
    return config


def _several(value) -> tuple | None:
    return None if value is None else (value,) if isinstance(value, str) else tuple(value)


# The words for samplers in configurations.
SAMPLERS = {"Threshold_N": "threshold", "Top_N": "top", "TopN": "top", "Random_N": "random", "Random": "random"}


def neighbor_limit(config: dict | None, seed: int = 0) -> NeighborLimit | None:
    if not config:
        return None
    _only(config, ("Type", "Max_Num", "Feat_Columns"), "neighbour limit")
    kind = config.get("Type", "Random_N")
    if kind not in SAMPLERS:
        raise SpecError(f"unknown neighbour limit {kind!r}")
    return NeighborLimit(SAMPLERS[kind], int(config["Max_Num"]), _several(config.get("Feat_Columns")) or (), seed=seed)


# Keys of a node table.
NODE_KEYS = ("node_table_name", "node_table_source", "node_raw_name", "target_feature_columns", "Table_Name", "UID", "Source", "Simple_Table_Name")


def node_spec(config: dict) -> NodeSpec:
    """A node table in either of its two forms."""
    _only(config, NODE_KEYS, "node table")
    table, key = config.get("node_table_name", config.get("Table_Name")), config.get("node_raw_name", config.get("UID"))
    if table is None or key is None:
        raise SpecError("node table: table name and key are needed")
    return NodeSpec(table, key, _several(config.get("target_feature_columns")), config.get("node_table_source", config.get("Source", "table")))


def node_specs(config: dict | list) -> tuple[NodeSpec, ...]:
    """Node tables of one type; a dict may hold them under ``Feature_Data_List``."""
    if isinstance(config, dict) and "Feature_Data_List" in config:
        config = config["Feature_Data_List"]
    return tuple(node_spec(c) for c in (config if isinstance(config, list) else [config]))


def node_limits(config: dict | list | None) -> tuple[NodeLimit, ...]:
    out = []
    for c in [] if not config else config if isinstance(config, list) else [config]:
        _only(c, ("node_std_name", "node_tables", "limit"), "node limit")
        out.append(NodeLimit(c["node_std_name"], node_specs(c["node_tables"]), c["limit"]))
    return tuple(out)


# Keys of an edge of a path.
EDGE_KEYS = (
    "edge_table_name", "edge_table_source", "head_node_raw_name", "head_node_std_name", "head_node_type", "tail_node_raw_name", "tail_node_raw_names",
    "tail_node_std_name", "tail_node_std_names", "tail_node_type", "tail_node_types", "edge_target_feature_columns", "Edge_Feature_Limits",
    "Node_Feature_Limits", "Edge_Neighbor_Limits", "Path_Feature_Limits", "Path_Neighbor_Limits",
)


def path_spec(config: list[dict]) -> tuple[EdgeSpec, ...]:
    """A fixed path; unnamed nodes are Node_k, or Node_k_j where a hop has several tails."""
    out: list[EdgeSpec] = []
    for k, c in enumerate(config):
        _only(c, EDGE_KEYS, f"edge {k}")
        tails = _several(c.get("tail_node_raw_names", c.get("tail_node_raw_name")))
        if not tails or "head_node_raw_name" not in c or "edge_table_name" not in c:
            raise SpecError(f"edge {k}: table, head and tail are needed")
        default = (f"Node_{k + 1}",) if len(tails) == 1 else tuple(f"Node_{k + 1}_{j}" for j in range(len(tails)))
        head = c.get("head_node_std_name", f"Node_{k}")
        out.append(
            EdgeSpec(
                c["edge_table_name"], c["head_node_raw_name"], tails, head, _several(c.get("tail_node_std_names", c.get("tail_node_std_name"))) or default,
                c.get("head_node_type"), _several(c.get("tail_node_types", c.get("tail_node_type"))), c.get("edge_table_source", "table"), "dt",
                _several(c.get("edge_target_feature_columns")), c.get("Edge_Feature_Limits"), node_limits(c.get("Node_Feature_Limits")),
                neighbor_limit(c.get("Edge_Neighbor_Limits"), k), c.get("Path_Feature_Limits"), neighbor_limit(c.get("Path_Neighbor_Limits"), k),
            )
        )
    return tuple(out)


# Keys of a relation of a k-hop graph.
_ENDS = ("Head", "Tail")
_LIMITS = ("Edge_Feature_Limits", "Node_Feature_Limits", "Edge_Neighbor_Limits")
RELATION_KEYS = (*[f"{e}_Node_{x}" for e in _ENDS for x in ("name", "class")], "Relation_Data", "Relation_Data_Source", *[f"{e}_{x}" for e in _ENDS for x in _LIMITS])


def khop_spec(config: dict[str, dict]) -> tuple[Relation, ...]:
    out = []
    for name, c in config.items():
        _only(c, RELATION_KEYS, f"relation {name}", ignored=("Head_Max_Sample_Type", "Tail_Max_Sample_Type"))
        limits = {
            e: {"edge_limit": c.get(f"{e}_Edge_Feature_Limits"), "node_limits": node_limits(c.get(f"{e}_Node_Feature_Limits")), "neighbor_limit": neighbor_limit(c.get(f"{e}_Edge_Neighbor_Limits"))}
            for e in _ENDS
        }
        out.append(Relation(name, c["Relation_Data"], c["Head_Node_name"], c["Head_Node_class"], c["Tail_Node_name"], c["Tail_Node_class"], c.get("Relation_Data_Source", "table"), limits=limits))
    return tuple(out)


@dataclass(frozen=True)
class Hop:
    """A hop of a metapath: scan predicate, lookups, predicates after lookup and after the join, sampler."""

    edge: EdgeSpec
    weight: str | None = None
    scan_limit: str | None = None
    lookups: tuple[NodeSpec, ...] = ()
    lookup_as: tuple[str, ...] = ()
    lookup_limit: str | None = None
    join_limit: str | None = None
    scale: int = 0
    sampler: str = "random"


@dataclass(frozen=True)
class MetaPath:
    hops: tuple[Hop, ...]
    max_all: int = 0
    tail_column: str | None = None


# Keys of a metapath and of its hops.
META_KEYS = ("Relation_List", "Max_All_Sample_Scale", "Tail_Column")
HOP_KEYS = (
    "Head_Column_name", "Head_Column_name_AS", "Tail_Column_name", "Tail_Column_name_AS", "Tail_Column_name_list", "Tail_Column_name_list_AS", "Head_Node_class",
    "Tail_Node_class", "Tail_Node_class_list", "Relation_Data", "Relation_Data_Source", "Weight_Column", "Limits", "Limits_Add_Feature_List", "Limits_For_Feature",
    "Limits_After_Join", "Max_Sample_Scale", "Max_Sample_Type",
)


def metapath_spec(config: dict) -> MetaPath:
    _only(config, META_KEYS, "metapath")
    hops = []
    for k, c in enumerate(config["Relation_List"]):
        _only(c, HOP_KEYS, f"hop {k}")
        tails = _several(c.get("Tail_Column_name_list", c.get("Tail_Column_name")))
        names = _several(c.get("Tail_Column_name_list_AS", c.get("Tail_Column_name_AS"))) or tails
        edge = EdgeSpec(c["Relation_Data"], c["Head_Column_name"], tails, c.get("Head_Column_name_AS"), names, c.get("Head_Node_class"), _several(c.get("Tail_Node_class_list", c.get("Tail_Node_class"))), c.get("Relation_Data_Source", "table"))
        looked = c.get("Limits_Add_Feature_List", [])
        for x in looked:
            _only(x, ("Table_Name", "UID", "UID_AS", "Column_Name_List"), f"hop {k}, lookup")
        kind = c.get("Max_Sample_Type", "Random")
        if kind not in SAMPLERS:
            raise SpecError(f"hop {k}: unknown sampler {kind!r}")
        hops.append(
            Hop(edge, c.get("Weight_Column"), c.get("Limits"), tuple(NodeSpec(x["Table_Name"], x["UID"], _several(x["Column_Name_List"])) for x in looked), tuple(x.get("UID_AS", x["UID"]) for x in looked),
                c.get("Limits_For_Feature"), c.get("Limits_After_Join"), int(c.get("Max_Sample_Scale", 0)), SAMPLERS[kind])
        )
    return MetaPath(tuple(hops), int(config.get("Max_All_Sample_Scale", 0)), config.get("Tail_Column"))


# Keys of a label table; those of a split are {split}_Limits and {split}_Max_Rows.
LABEL_KEYS = ("Node_Columns", "Node_Types", "Node_UID_Names", "Label_Column", "Time_Column", "Table_Name", "dt", "Feature_Time_Range", "Limits", "Label_Map_Keys", "Label_Map_Values", "Label_Range_Limit", "Max_Rows")


def label_spec(config: dict, splits: Iterable[str] = ()) -> LabelSpec:
    splits = tuple(splits)
    _only(config, (*LABEL_KEYS, *[f"{s}_{x}" for s in splits for x in ("Limits", "Max_Rows")]), "label table")
    keys, values = config.get("Label_Map_Keys", []), config.get("Label_Map_Values", [])
    if len(keys) != len(values):
        raise SpecError("label table: as many map keys as values are needed")
    names = config.get("Node_UID_Names") or [f"{t}_UID" for t in config["Node_Types"]]
    return LabelSpec(
        config["Table_Name"], tuple(config["Node_Columns"]), tuple(names), config["Label_Column"], config["Time_Column"], dt=config.get("dt"), limits=config.get("Limits"),
        split_limits={s: config[f"{s}_Limits"] for s in splits if f"{s}_Limits" in config}, label_map=dict(zip(keys, values)), label_range=_several(config.get("Label_Range_Limit")),
        max_rows=config.get("Max_Rows"), split_max_rows={s: config[f"{s}_Max_Rows"] for s in splits if f"{s}_Max_Rows" in config},
        months=int(config.get("Feature_Time_Range", 1)),
    )

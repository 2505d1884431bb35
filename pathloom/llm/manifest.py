"""Merkle dataset manifest: a content-addressed DAG and proofs by descending it.

Rows are leaves.  The leaves of a tree (a language) stand in ascending id order; every
``fan`` consecutive nodes become the hash of their digests until one is left, the
subroot.  The subroots, in the order of their trees, become the root in the same way.

The DAG is stored as records from a digest to its children.  A *segment* holds the
records of ``span`` levels below one node and is found by that node's digest, so the
store has a row per ``fan ** span`` leaves.  Each level of segments is folded by one
shuffle of digests; no tree and no level is ever in one task.

A request names a tree and a rank.  Requests descend from the root: in each segment
the digits of the rank pick one child of a record, the others are the proof's
siblings.  Requests that still share their path descend as one row per segment, so the
root's segment is no hot key.  What was collected from the root down is reversed to the
proof from the leaf up, which folds any leaf to a root again.

Defined cases: null ids come first, rows of one id in the order of their digests (rows
alike in all columns are interchangeable and have ranks of their own); a null value is
hashed as ``-``; a null language is a tree of its own and comes first; a tree of one
leaf has that leaf as its subroot, a table of one tree its subroot as the root; an
empty table gives no rows; other columns do not count.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

SEGMENT = "tree string, place long, segment binary, records array<struct<digest: binary, children: array<binary>>>"
STEP = "tree string, place long, digest binary, path binary"
PROOF = "tree string, rank long, proof binary, folded binary"


def hash_of(digests) -> bytes:
    """The digest of consecutive nodes: of their hexadecimal forms, concatenated."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 length and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def fold(digests: list[bytes], fan: int, levels: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The node ``levels`` above these, and a record for every node made."""
    records = []
    for _ in range(levels):
        runs = [digests[i : i + fan] for i in range(0, len(digests), fan)]
        digests = [hash_of(r) for r in runs]
        records += zip(digests, runs)
    return digests[0], records


def height(nodes: int, fan: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


def descend(records: dict[bytes, list[bytes]], top: bytes, digit_of: int, fan: int, levels: int) -> tuple[bytes, bytes]:
    """(the node ``levels`` below ``top``, what was not selected on the way: own place in the run, number of siblings, siblings).

    The steps come out from the lowest to the highest.
    """
    steps = []
    for k in range(levels - 1, -1, -1):
        run, own = records[top], digit_of // fan**k % fan
        steps.append(bytes([own, len(run) - 1]) + b"".join(run[:own] + run[own + 1 :]))
        top = run[own]
    return top, b"".join(reversed(steps))


def steps_of(path: bytes):
    """(own place, siblings) of each level from the leaf up."""
    at = 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        yield own, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold_path(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    for own, siblings in steps_of(path):
        leaf = hash_of([*siblings[:own], leaf, *siblings[own:]])
    return leaf


def ranked(rows: DataFrame, order: list[str], at: str) -> DataFrame:
    """``rows`` (stored, with a column ``tree``) with ``rank`` in their tree and its ``size``.

    Rows are range-sorted once and stored with their place in their range; ranks are
    that place plus the sizes of the tree's earlier ranges.
    """
    by = ["tree", *order]
    placed = rows.withColumn("__k", F.monotonically_increasing_id()).repartitionByRange(*by, "__k").sortWithinPartitions(*by, "__k").drop("__k")
    placed = placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = shared.cut(placed, at)
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    parts = parts.select("tree", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__before"), F.sum("__n").over(Window.partitionBy("tree")).alias("size"))
    return placed.join(parts, ["tree", "__part"]).withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


@dataclass(frozen=True)
class Manifest:
    """Stored segments of each level (the lowest first) and the (tree, root, size) of each tree."""

    fan: int
    span: int
    layers: tuple[DataFrame, ...]
    roots: DataFrame


def build(spark: SparkSession, leaves: DataFrame, fan: int = 2, span: int = 10) -> Manifest:
    """The manifest of ``leaves`` (tree, rank, size, digest)."""
    if not 2 <= fan <= 256:
        raise ValueError("fan must be between 2 and 256")
    width = fan**span

    def segment(table: pa.Table) -> pa.Table:
        rank = table.column("rank").to_pylist()
        digest, size = table.column("digest").to_pylist(), table.column("size")[0].as_py()
        top, records = fold([digest[i] for i in sorted(range(len(rank)), key=rank.__getitem__)], fan, min(span, height(size, fan)))
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
        rows = pa.array([[{"digest": d, "children": c} for d, c in records]], kind)
        return pa.table({"tree": table.column("tree")[:1], "place": pa.array([rank[0] // width]), "segment": pa.array([top], pa.binary()), "records": rows})

    layers, roots, level = [], [], leaves.select("tree", "rank", "size", "digest")
    while True:
        roots.append(level.where("size = 1").select("tree", F.col("digest").alias("root"), F.lit(len(layers)).alias("layers")))
        level = level.where("size > 1")
        if level.isEmpty():
            break
        made = level.withColumn("place", F.expr(f"rank div {width}")).groupBy("tree", "place").applyInArrow(segment, SEGMENT)
        layers.append(shared.cut(made, shared.folder(spark, "segments")))
        sizes = level.groupBy("tree").agg(F.expr(f"(max(size) + {width - 1}) div {width}").alias("size"))
        level = layers[-1].select("tree", F.col("place").alias("rank"), F.col("segment").alias("digest")).join(sizes, "tree")
        level = shared.cut(level.select("tree", "rank", "size", "digest"), shared.folder(spark, "level"))
    sizes = leaves.groupBy("tree").agg(F.max("size").alias("size"))
    return Manifest(fan, span, tuple(layers), shared.cut(reduce(DataFrame.unionAll, roots).join(sizes, "tree"), shared.folder(spark, "roots")))


def _frontier(m: Manifest, requests: DataFrame, tops: DataFrame, to: int):
    """The rows (tree, place, digest, path) at which requests enter layer ``to`` - 1, from ``tops``: (tree, root, layers, size, path)."""
    fan, span = m.fan, m.span
    here = lambda layer: tops.where(F.col("layers") == layer + 1).select("tree", F.lit(0).cast("long").alias("place"), F.col("root").alias("digest"), "path")
    at = None
    for layer in range(len(m.layers) - 1, to - 1, -1):
        own = here(layer)
        at = own if at is None else at.unionAll(own)
        if layer == to:
            return at
        width = fan ** (span * layer)
        wanted = requests.select("tree", F.expr(f"rank div {width}").alias("child")).distinct().withColumn("place", F.expr(f"child div {fan**span}"))

        def step(found: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if len(found) and len(asked):
                tree, top, path, records, levels = _segment(found, fan, span)
                for child in asked.column("child").to_pylist():
                    digest, steps = descend(records, top, child % fan**span, fan, levels)
                    out.append({"tree": tree, "place": child, "digest": digest, "path": steps + path})
            return pa.Table.from_pylist(out, pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.binary()), ("path", pa.binary())]))

        at = _with_records(m, at, tops, layer).groupBy("tree", "place").cogroup(wanted.groupBy("tree", "place")).applyInArrow(step, STEP)
    return at


def _with_records(m: Manifest, at: DataFrame, tops: DataFrame, layer: int) -> DataFrame:
    """Segments are found by their digest; the place besides it keeps equal segments of a hot run of copies apart."""
    store = m.layers[layer].select("tree", "place", F.col("segment").alias("digest"), "records")
    size = F.expr(f"cast(ceil(size / power({m.fan}, {m.span * layer})) as long)")
    return at.join(store, ["digest", "tree", "place"]).join(tops.select("tree", size.alias("nodes")), "tree")


def _segment(found: pa.Table, fan: int, span: int):
    row = found.to_pylist()[0]
    return row["tree"], row["digest"], row["path"], {r["digest"]: r["children"] for r in row["records"]}, min(span, height(row["nodes"], fan))


def prove(m: Manifest, requests: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, rank, proof, folded) of each request (tree, rank, leaf).

    ``tops``: (tree, root, layers, size, path), where path is what lies above the
    tree's root (empty if nothing does).  ``proof``: the path from the leaf up;
    ``folded``: the root that ``leaf`` and the proof give.
    """
    fan, span = m.fan, m.span

    def close(found: pa.Table, asked: pa.Table) -> pa.Table:
        rank, leaf, proofs, folded = asked.column("rank").to_pylist(), asked.column("leaf").to_pylist(), [], []
        if not len(found) and len(asked):
            raise RuntimeError("a request has no segment")
        if len(asked):
            _, top, path, records, levels = _segment(found, fan, span)
            for r, x in zip(rank, leaf):
                _, steps = descend(records, top, r % fan**span, fan, levels)
                proofs.append(steps + path)
                folded.append(fold_path(x, proofs[-1]))
        return pa.table({"tree": asked.column("tree"), "rank": asked.column("rank"), "proof": pa.array(proofs, pa.binary()), "folded": pa.array(folded, pa.binary())})

    # A tree of one leaf has no segment: its proof is what lies above it.
    alone = requests.join(tops.where("layers = 0").select("tree", "path"), "tree")
    above = F.udf(lambda leaf, path: fold_path(leaf, path), "binary")
    out = alone.select("tree", "rank", F.col("path").alias("proof"), above("leaf", "path").alias("folded"))
    if m.layers:
        at = _with_records(m, _frontier(m, requests, tops, 0), tops, 0)
        asked = requests.join(tops.where("layers > 0").select("tree"), "tree", "left_semi").withColumn("place", F.expr(f"rank div {fan**span}"))
        out = out.unionAll(at.groupBy("tree", "place").cogroup(asked.groupBy("tree", "place")).applyInArrow(close, PROOF))
    return out


def forest(spark: SparkSession, m: Manifest) -> tuple[DataFrame, str]:
    """(the trees' (tree, root, layers, size, path), the root over all of them)."""
    empty = F.lit(b"")
    trees = shared.cut(m.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root", "layers", F.col("size").alias("leaves")), shared.folder(spark, "trees"))
    rows = shared.cut(ranked(trees, ["name"], shared.folder(spark, "ranked-trees")), shared.folder(spark, "trees"))
    above = build(spark, rows.withColumnRenamed("root", "digest"), m.fan, m.span)
    tops = above.roots.withColumn("path", empty)
    got = prove(above, rows.select("tree", "rank", F.col("root").alias("leaf")), tops)
    paths = got.join(rows.drop("tree", "size"), "rank").select(F.col("name").alias("tree"), "root", "layers", F.col("leaves").alias("size"), F.col("proof").alias("path"))
    top = tops.select(F.lower(F.hex("root")).alias("root")).collect()  # the one root
    return shared.cut(paths, shared.folder(spark, "paths")), top[0].root if top else ""


def proof_digest(path: Column) -> Column:
    """The hash of a proof's siblings from the leaf up, left to right."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: hash_of([s for _, siblings in steps_of(p) for s in siblings]).hex())

    return digest(path)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    values = lambda n: [F.col(c) if c != "n_chars" else n for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n")).alias("tree"),
        "doc_id",
        leaf_of(*values(F.col("n_chars"))).alias("digest"),
        F.when(tampered, leaf_of(*values(F.col("n_chars") + 1))).alias("changed"),
    )
    # Texts are read and hashed once; from here on a row is its digests.
    leaves = shared.cut(leaves, shared.folder(spark, "leaves"))
    rows = shared.cut(ranked(leaves, ["doc_id", "digest"], shared.folder(spark, "ranked")), shared.folder(spark, "ranks"))
    m = build(spark, rows)
    tops, root = forest(spark, m)
    got = prove(m, rows.select("tree", "rank", F.coalesce("changed", "digest").alias("leaf")), tops)
    out = rows.join(got, ["tree", "rank"]).join(tops.select("tree", F.col("root").alias("__subroot")), "tree")
    text = lambda c: F.lower(F.hex(c))
    folded = text(F.col("folded"))
    return out.select("doc_id", text(F.col("digest")).alias("leaf"), text(F.col("__subroot")).alias("subroot"), F.lit(root).alias("root"),
                      proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))

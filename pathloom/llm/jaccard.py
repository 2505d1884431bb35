"""N-gram Jaccard join: all links between documents whose shingle sets are similar.

1. Document frequencies.  Tasks store their documents' shingle sets and ship the
   distinct truncated hashes to hash shards, which answer in how many documents
   each is (``exchange``).  Frequencies only fix one global order, rarest shingle
   first, in which a set's prefix must meet the prefix of every set similar to it.
   A shingle found once meets nothing, so most documents need no entry at all.
2. Equal sets are one node.
3. Index lists.  A list is the nodes of one prefix shingle; of lists over the
   same nodes only the first shingle's is kept.  In a list, nodes are sorted by size and position:
   pairs that size or position rules out are not judged, and a node without an
   open entry is skipped whole; others' overlaps are counted with all the list.
   A list longer than a block is solved block by block first; then one node of
   each component found stands for it, and only what is still outside the list's
   largest component is compared with all the list, by pairs of blocks.
4. Answers.  A node's overlaps with the whole list are derived from those of a
   highly similar node of the list that are already known: minus what the
   common entries lose by the shingles that only the other has, plus what the
   shingles of its own gain.  Only without such a node are they counted afresh.
   Nodes that are already linked, directly or not, are not compared; a list
   gives at most one link fewer than it has nodes, never pairs.
5. Components of the links by alternating large and small stars.

Defined cases: a null or empty text, or one without words, has no shingles and
links with nothing; fewer words than ``width`` are one shingle; equal texts and
repeated rows are linked; a null id counts as none when the smallest id of a
component is chosen; an empty table gives no rows; other columns stay (those
named as outputs are replaced).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .exchange import BLOCK, Blocks, arrays, back, cells, count, deal, flush_name, gathered, put_arrays, runs, span_of
from .words import shingle_sets, slices

FLUSH, DOCS_PER_SHARD, LIST_BLOCK = 1 << 20, 4_000, 2048
#: Shingles that a task reads ahead for its next lists; a longer list is read alone.
READ = 4 << 20


def _order_bits(shards: int) -> int:
    """Bits of a hash that document frequencies are counted by: a shard always has 2^35 of them."""
    return min(64, 35 + max(0, shards - 1).bit_length())


def _shard_of(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    top = keys >> np.uint64(bits - 32) if bits >= 32 else keys
    return (top * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _ship(at: str, width: int, bits: int, shards: int):
    """Documents (id, text) to blocks of truncated shingle hashes; their sets are stored."""
    span = span_of(shards)

    def run(batches):
        held, n, number = [], 0, 0

        def flush():
            ids, valid, sizes, tokens = (np.concatenate([h[k] for h in held]) for k in range(4))
            keys, times = count(tokens >> np.uint64(64 - bits))
            name = flush_name(number, ids, tokens)
            put_arrays(f"{at}/sets-{name}", ids=ids, valid=valid, sizes=sizes, keys=np.array([len(keys)]), tokens=tokens)
            # A flush without shingles asks nothing, but its documents are in the result.
            return cells(name, _shard_of(keys, bits, shards), keys, times, span=span) if len(keys) else cells(name, np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.uint64))

        for batch in batches:
            ids = batch.column(0)
            for a, b in slices(batch.column(1)):
                tokens, ptr = shingle_sets(batch.column(1)[a:b], width)
                own = ids[a:b]
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False), own.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(ptr), tokens))
                n += len(tokens) + b - a
                if n >= FLUSH:
                    yield flush()
                    held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's blocks to the document frequency of each of their hashes, up to 255."""
    blocks = Blocks(pdf, 2)
    keys, times = blocks.columns
    order = np.argsort(keys, kind="stable")
    at = runs(keys[order])
    total = np.add.reduceat(times[order], at[:-1])
    df = np.empty(len(keys), np.uint64)
    df[order] = np.repeat(np.minimum(total, 255), np.diff(at))
    return blocks.answers(df)


def prefix_length(n, num: int, den: int):
    """Entries of the prefix of a set of n shingles."""
    return n - -(-num * n // den) + 1


_SETS = "doc_id long, n_shingles long, node binary, first int, prefix array<long>, df array<int>, file string, at long"


def _index(at: str, bits: int, num: int, den: int):
    """A flush's answers to its documents' set size, node, prefix entries and the place of the stored set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["flush"].iloc[0]
        stored = arrays(f"{at}/sets-{name}")
        tokens, sizes = stored["tokens"], stored["sizes"]
        df = np.ones(len(tokens), np.uint8)
        if len(tokens):
            (answers,) = gathered(pdf, 1, int(stored["keys"][0]))
            keys = tokens >> np.uint64(64 - bits)
            order = np.argsort(keys, kind="stable")
            df[order] = np.repeat(answers.astype(np.uint8), np.diff(runs(keys[order])))
        base = len(shared.view(f"{at}/sets-{name}")) - 8 * len(tokens)  # the tokens are the file's last array
        once = np.concatenate([[0], np.cumsum(df == 1)])
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        rows = {f: [] for f in ("node", "first", "prefix", "df", "file", "at")}
        for x, y in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
            n, alone = y - x, int(once[y] - once[x])
            own = tokens[x:y]
            rows["node"].append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
            most = prefix_length(n, num, den) if n else 0
            got = (None,) * 5
            if alone < most:
                o = np.lexsort((own, df[x:y]))[alone:most]
                got = alone, own[o].view(np.int64), df[x:y][o].astype(np.int32), name, base + 8 * x
            for f, v in zip(("first", "prefix", "df", "file", "at"), got):
                rows[f].append(v)
        ids = pd.array(stored["ids"], dtype="Int64")
        ids[stored["valid"] == 0] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_shingles": sizes, **rows}).astype({"first": "Int32", "at": "Int64"})

    return run


class _Groups:
    """Union-find over the nodes of one list, from components known before."""

    def __init__(self, of: np.ndarray):
        self.of = of.copy()

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i], self.of[j]
        if a == b:
            return False
        self.of[self.of == b] = a
        return True


def link_list(sets: list[np.ndarray], pos: np.ndarray, num: int, den: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the similar sets of one list, sorted by (size, position).

    ``side``: only sets of different sides are compared; ``known``: numbers of
    components already found, inside which nothing is compared.
    """
    size = np.array([len(s) for s in sets])
    count = len(sets)
    groups, links = _Groups(np.arange(count) if known is None else known), []
    similar = lambda common, x, y: den * common >= num * (x + y - common)
    if count == 2:
        if groups.of[0] == groups.of[1]:
            return []
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if similar(common, size[0], size[1]) and (side is None or side[0] != side[1]) else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(count), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def holders(tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set has."""
        a, b = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=count)

    counted: list[tuple[int, np.ndarray]] = []  # nodes whose answers have been counted afresh
    for i in range(count):
        end = np.searchsorted(size, size[i] * den // num, "right")  # larger sets are too large
        if end <= i + 1:
            continue
        y = np.arange(i + 1, end)
        least = -(-num * (size[i] + size[y]) // (num + den))
        open_ = (groups.of[y] != groups.of[i]) & (np.minimum(size[i] - pos[i], size[y] - pos[y]) >= least)
        if side is not None:
            open_ &= side[y] != side[i]
        y = y[open_]
        if not len(y):
            continue
        best, answers = max(counted, key=lambda k: k[1][i], default=(None, None))
        if answers is not None and 2 * (size[i] + size[best] - 2 * answers[i]) < size[i]:
            # Derived: only what differs from the similar set is looked up.
            lost = np.setdiff1d(sets[best], sets[i], assume_unique=True)
            gained = np.setdiff1d(sets[i], sets[best], assume_unique=True)
            own = answers - holders(lost) + holders(gained)
        else:
            own = holders(sets[i])
            counted.append((i, own))
        for j in y[similar(own[y], size[i], size[y])].tolist():
            if groups.join(i, j):
                links.append((i, j))
    return links


def _links(at: str, num: int, den: int):
    """Sorted entries of lists to spanning links (u, v) between nodes."""

    def read(rows: dict, a: int, b: int) -> list[np.ndarray]:
        """The sets of rows a to b: each file is visited once, each set read once; copies, so that no file stays open."""
        got: dict[tuple[str, int], np.ndarray] = {}
        wanted = [(rows["file"][i], int(rows["at"][i]), int(rows["n"][i])) for i in range(a, b)]
        for file, place, n in sorted(set(wanted)):
            got[file, place] = np.frombuffer(bytes(shared.piece(f"{at}/sets-{file}", place, 8 * n)), "<u8")
        return [got[w[:2]] for w in wanted]

    def solve(rows: dict, sets: list[np.ndarray], a: int, b: int):
        side = None
        if rows["left"][a] != rows["right"][a]:
            side = rows["own"][a:b]
        known = np.unique(rows["part"][a:b], return_inverse=True)[1] if len(set(rows["part"][a:b])) < b - a else None
        for i, j in link_list(sets, rows["pos"][a:b], num, den, side, known):
            u, v = rows["node"][a + i], rows["node"][a + j]
            yield (u, v) if u > v else (v, u)

    def run(batches):
        keep = None
        names = ("token", "left", "right", "own", "n", "pos", "at")

        def work(last: bool):
            nonlocal keep
            rows = {c: keep.column(c).to_numpy() for c in names} | {c: keep.column(c).to_pylist() for c in ("node", "file", "part")}
            n = keep.num_rows
            new = np.ones(n, bool)
            new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["left"][1:] != rows["left"][:-1]) | (rows["right"][1:] != rows["right"][:-1])
            starts = np.append(np.flatnonzero(new), n)
            whole = starts if last else starts[:-1]
            ends = np.concatenate([[0], np.cumsum(rows["n"])])
            found, k = set(), 0
            while k < len(whole) - 1:
                # As many lists as fit, one at least.
                m = max(k + 1, int(np.searchsorted(ends[whole], ends[whole[k]] + READ, "right")) - 1)
                first, sets = int(whole[k]), read(rows, int(whole[k]), int(whole[m]))
                for a, b in zip(whole[k:m].tolist(), whole[k + 1 : m + 1].tolist()):
                    found.update(solve(rows, sets[a - first : b - first], a, b))
                k = m
            keep = keep.slice(int(whole[-1]))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            got = pa.Table.from_batches([batch])
            keep = got if keep is None else pa.concat_tables([keep, got]).combine_chunks()
            yield work(False)
        if keep is not None and keep.num_rows:
            yield work(True)

    return run


def _solve(dealt: DataFrame, at: str, num: int, den: int) -> DataFrame:
    """Links (u, v) within the blocks of lists, or between the two of a pair."""
    dealt = dealt.select("token", "left", "right", "own", "node", "n", "pos", "file", "at", "part")
    dealt = dealt.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right", "n", "pos", "node")
    return dealt.mapInArrow(_links(at, num, den), "u binary, v binary")


def connected(edges: DataFrame, at: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is its component's least node."""

    def stored(df: DataFrame, k) -> tuple[DataFrame, tuple]:
        df = shared.cut(df.where("u <> v").distinct(), f"{at}/stars-{k}")
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return df, tuple(r)

    e, mark = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "0")
    k = 0
    while True:
        k += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, now = stored(small, k)
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link if den * intersection >= num * union of their sets of
    ``width``-word shingles; component_id is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    result = shared.folder(spark, "components")
    with shared.scratch(spark):
        return shared.cut(_components(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")), width, num, den, shared.folder(spark, "jaccard")), result)


def _components(docs: DataFrame, width: int, num: int, den: int, at: str) -> DataFrame:
    shards = max(8, -(-docs.count() // DOCS_PER_SHARD))
    bits = _order_bits(shards)
    asked = deal(docs.mapInArrow(_ship(at, width, bits, shards), BLOCK), at, shards, lambda _: 2, lambda _, own: _shard_of(own[0], bits, shards))
    answered = back(asked.groupBy("shard").applyInPandas(_frequencies, BLOCK), at, shards, lambda _: 1)
    rows = shared.cut(answered.groupBy("flush").applyInPandas(_index(at, bits, num, den), _SETS), f"{at}/rows")
    nodes = rows.where("file is not null").groupBy("node").agg(F.min(F.struct("file", "at", "first", "prefix", "df", F.col("n_shingles").alias("n"))).alias("x"))
    entries = nodes.select("node", "x.n", "x.file", "x.at", "x.first", F.posexplode(F.arrays_zip("x.prefix", "x.df")).alias("k", "e"))
    entries = entries.select("node", "n", "file", "at", (F.col("first") + F.col("k")).cast("int").alias("pos"), F.col("e.prefix").alias("token"), F.col("e.df").alias("df"))
    entries = shared.cut(entries, f"{at}/entries")
    lists = entries.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("f1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("f2"), F.min("df").alias("df"))
    # The first shingle, in the unsigned order of the prefixes, of lists over the same nodes.
    rank = F.struct("df", F.expr("token ^ (-9223372036854775807L - 1)"), "token")
    lists = lists.where("size > 1").groupBy("size", "f1", "f2").agg(F.min(rank).alias("r")).select(F.col("r.token").alias("token"), F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks"))
    dealt = shared.cut(entries.drop("df").join(lists, "token").withColumn("part", F.col("node")), f"{at}/dealt")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    # Each block of a list by itself.
    first = dealt.withColumns({"own": own, "left": own, "right": own})
    links = shared.cut(_solve(first, at, num, den), f"{at}/links")
    roots = connected(links, f"{at}/first")
    long = dealt.where("blocks > 1")
    if not long.isEmpty():
        # Of every component that a long list has by now one node is compared with those of the others ...
        def parted():
            return long.drop("part").join(roots.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))

        entry = F.struct("node", "n", "pos", "file", "at")
        some = parted().groupBy("token", "part").agg(F.min(entry).alias("x")).select("token", "part", "x.*")
        blocks = some.groupBy("token").agg(F.ceil(F.count("*") / (4 * LIST_BLOCK)).cast("int").alias("blocks"))
        some = some.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
        more = shared.cut(_solve(some.withColumns({"left": F.col("own"), "right": F.col("own")}), at, num, den), f"{at}/more")
        roots = connected(links.unionByName(more), f"{at}/second")
        # ... and then what is outside a list's largest component with all of it, by pairs of blocks.
        rows_of = parted()
        parts = rows_of.groupBy("token", "part").agg(F.count("*").alias("c"))
        largest = parts.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("all"))
        largest = largest.where("m.c < all").select("token", F.col("m.part").alias("most"), F.ceil((F.col("all") - F.col("m.c")) / LIST_BLOCK).cast("int").alias("cold"), F.ceil(F.col("m.c") / LIST_BLOCK).cast("int").alias("hot"))
        rest = rows_of.join(largest, "token").withColumn("is_cold", F.col("part") != F.col("most"))
        block = F.xxhash64("node", F.lit(7))
        rest = rest.withColumn("own", F.when(F.col("is_cold"), F.pmod(block, F.col("cold"))).otherwise(F.col("cold") + F.pmod(block, F.col("hot"))).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_cold"), F.col("cold") + F.col("hot")).otherwise(F.col("cold")) - 1)))
        last = shared.cut(_solve(rest.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}), at, num, den), f"{at}/last")
        roots = connected(links.unionByName(more).unionByName(last), f"{at}/third")

    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_node = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_node.join(of_root, "root").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)

"""Ranked lexical search on K2-treaps over term-document grids.

Documents are cut into shards.  A shard is a grid whose rows are its terms (the most
frequent first) and whose columns are its documents (in the order of their lengths,
so that neighbours have like impacts).  A cell of the grid holds the impact of a term
in a document.  The grid is stored as a quadtree that keeps only cells with something in
them: level by level four bits a cell that say which quarters exist, and the maximum of
the impacts in the cell, rounded up to a byte.  The lowest cells keep the term's
frequency, from which the exact impact follows.

An item descends in a shard along the paths of all its terms' rows at once.  What is
open are ranges of documents, each with one cell per term; the sum of the cells'
maxima, weighted, bounds the score of every document in the range.  The ranges with the
highest bounds are halved first, in batches; a range whose bound is below the score of
the item's k-th document so far is dropped, which loses none.  What an item has found
in a task's earlier shards sets the bound in the later ones.

Term weights need counts over all documents: shards answer how many of their documents
hold an item's terms, and the sums go into the items' files.  Items are handled in
blocks of about ``BLOCK``, each a file that search tasks open one after the other.

Terms go by 64-bit hashes.  Defined cases: a null or empty text, or one without terms,
is in no result and in none of the counts; an item without terms has no results;
repeated rows are documents of their own; equal scores go by ascending id, null last;
empty tables give no rows; other columns do not count.  A text longer than a window is
counted window by window and may fill a shard of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .encode import SLICE
from .exchange import arrays, count, find, put_arrays, runs
from .words import buffers, hash_bytes, ragged, slices, split_words

#: Bytes of text and documents of a shard; items of a block; shards of a search task.
SHARD_BYTES, SHARD_DOCS, BLOCK, SHARDS_PER_TASK = 16 << 20, 1 << 16, 128, 4
IMPACT = 1_000_000  # no impact is larger

_BETWEEN = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _BETWEEN[_first : _last + 1] = False
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def term_counts(texts: pa.Array, most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, uint64 hash, how often) of the terms of each text; a long text's terms may come several times."""
    out = []
    for a, b in slices(texts, most):
        for part in _windows(texts[a:b], most):
            words, ptr = split_words(part, True, _BETWEEN)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            key, n = count((ragged(ptr).astype(np.uint64) << np.uint64(32)) | coded.indices.to_numpy().astype(np.uint64))
            hashes = hash_bytes(coded.dictionary)
            out.append(((key >> np.uint64(32)).astype(np.int64) + a, hashes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], n))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _windows(texts: pa.Array, most: int):
    """``texts``, or windows of one long text that end between terms."""
    raw, offs = buffers(texts)
    if len(texts) > 1 or len(raw) <= 2 * most:
        yield texts
        return
    at = 0
    while at < len(raw):
        end = size = min(most, len(raw) - at)
        while at + size < len(raw):
            ends = np.flatnonzero(_BETWEEN[raw[at : at + size]])
            if len(ends):
                end = int(ends[-1]) + 1
                break
            size = end = min(2 * size, len(raw) - at)
        yield pa.array([raw[at : at + end].tobytes()], pa.binary())
        at += end


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32 at the even places."""
    x = x.astype(np.uint64)
    for by, mask in _SPREAD:
        x = (x | (x << np.uint64(by))) & np.uint64(mask)
    return x


def grid(row: np.ndarray, h: np.ndarray, tf: np.ndarray, docs: int, n_docs: int, n_terms: int) -> dict[str, np.ndarray] | None:
    """The arrays of a shard; ``order`` has the document of each column."""
    if not len(row):
        return None
    length = np.bincount(row, tf, docs).astype(np.int64)
    order = np.argsort(length, kind="stable")
    order = order[np.searchsorted(length[order], 1) :]  # without those that have no term
    column = np.zeros(docs, np.int64)
    column[order] = np.arange(len(order))
    m = 75 + 25 * length[order] * n_docs // n_terms
    terms, code = np.unique(h, return_inverse=True)
    # Windows of a long text are summed here.
    key = (code.astype(np.uint64) << np.uint64(32)) | column[row].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    at = runs(key[by])[:-1]
    key, tf = key[by][at], np.add.reduceat(tf[by], at)
    code, col = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    df = np.bincount(code, minlength=len(terms))
    place = np.empty(len(terms), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(terms))
    height = max(1, int(max(len(terms), len(order)) - 1).bit_length())
    cell = (_spread(place[code]) << np.uint64(1)) | _spread(col)
    by = np.argsort(cell)
    cell, tf, col = cell[by], tf[by], col[by]
    top = -(-impact(tf, m[col]) * 255 // IMPACT)
    bits, tops = [], []
    for _ in range(height):
        at = runs(cell >> np.uint64(2))[:-1]
        bits.append(np.bitwise_or.reduceat(np.left_shift(1, (cell & np.uint64(3)).astype(np.int64)), at).astype(np.uint8))
        top = np.maximum.reduceat(top, at)
        tops.append(top.astype(np.uint8))
        cell = cell[at] >> np.uint64(2)
    bits, tops = np.concatenate(bits[::-1]), np.concatenate(tops[::-1])
    many = np.flatnonzero(tf > 255)
    return {
        "height": np.array([height]), "terms": terms, "place": place.astype(np.uint32), "df": df.astype(np.uint32), "m": m, "order": order,
        "nodes": np.array([len(bits)]), "bits": bits[0::2] | np.append(bits[1::2], np.zeros(len(bits) % 2, np.uint8)) << 4, "tops": tops,
        "tf": np.minimum(tf, 255).astype(np.uint8), "many": many.astype(np.uint32), "many_tf": tf[many].astype(np.uint32),
    }


class Treap:
    """A stored shard for descending."""

    def __init__(self, uri: str):
        x = arrays(uri)
        self.height, self.terms, self.place, self.df, self.m = int(x["height"][0]), x["terms"], x["place"], x["df"], x["m"]
        n = int(x["nodes"][0])
        bits = np.empty(2 * len(x["bits"]) + 1, np.uint8)
        bits[0:-1:2], bits[1::2] = x["bits"] & 15, x["bits"] >> 4
        # One more node, without quarters, stands for cells that do not exist.
        self.bits, self.none = np.append(bits[:n], np.uint8(0)), n
        self.first = 1 + np.concatenate([[0], np.cumsum(_ONES[bits[:n]])]).astype(np.int64)
        self.bound = np.append(-(-x["tops"].astype(np.int64) * IMPACT // 255), 0)
        tf = x["tf"].astype(np.int64)
        tf[x["many"]] = x["many_tf"]
        self.tf = np.append(tf, 0)  # the last one for terms that a document lacks
        self.ids, self.known = x["ids"], x["known"]

    def children(self, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The nodes in a quarter of each, numbered from the root level by level; ``none`` where there is none."""
        bits = self.bits[node]
        below = self.first[node] + _ONES[bits & ((1 << quarter) - 1)]
        return np.where((bits >> quarter) & 1, below, -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of documents that hold the k best of those that score ``floor`` or more, and ties."""
        at, there = find(self.terms, terms)
        rows, weights = self.place[at[there]].astype(np.int64), weights[there]
        got_col, got = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(rows):
            return got_col[0], got[0]
        batch = int(np.clip((1 << 18) // len(rows), 8, 512))
        bound, level, col = np.array([int(weights.sum()) * IMPACT]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        node = np.zeros((1, len(rows)), np.int64)
        while len(bound):
            if len(bound) > batch:
                pick = np.argpartition(bound, len(bound) - batch)[len(bound) - batch :]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
            else:
                pick, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            down = level[pick]
            half = (rows[None, :] >> (self.height - 1 - down)[:, None]) & 1
            parts = [(bound[rest], level[rest], col[rest], node[rest])]
            for side in (0, 1):
                child, cols = self.children(node[pick], 2 * half + side), 2 * col[pick] + side
                low = down == self.height - 1
                if low.any():
                    leaf = np.where(child[low] < 0, len(self.tf) - 1, child[low] - self.none)
                    live = (child[low] >= 0).any(1)
                    leaf, cols_low = leaf[live], cols[low][live]
                    scores = (impact(self.tf[leaf], self.m[cols_low][:, None]) * weights).sum(1)
                    good = scores >= floor
                    got.append(scores[good])
                    got_col.append(cols_low[good])
                high = np.flatnonzero(~low)
                below = np.where(child[high] < 0, self.none, child[high])
                top = self.bound[below] @ weights
                good = top >= floor
                parts.append((top[good], down[high][good] + 1, cols[high][good], below[good]))
            found = np.concatenate(got)
            if len(found) > k:
                floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                keep = found >= floor
                got, got_col = [found[keep]], [np.concatenate(got_col)[keep]]
            bound, level, col, node = (np.concatenate([p[i] for p in parts]) for i in range(4))
            open_ = bound >= floor
            if not open_.all():
                bound, level, col, node = bound[open_], level[open_], col[open_], node[open_]
        return np.concatenate(got_col), np.concatenate(got)


def counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for a, b in slices(batch.column(0)):
                raw, offs = buffers(batch.column(0)[a:b])
                own = ~_BETWEEN[raw]
                first = own.copy()
                first[1:] &= ~own[:-1]
                starts = offs[:-1][offs[1:] > offs[:-1]]
                first[starts] = own[starts]
                n[a:b] = np.diff(np.searchsorted(np.flatnonzero(first), offs))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    row = docs.select(text).mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row.docs or 0, row.terms or 0


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(stored rows (shard, docs, points), number of documents with a term): a file per shard of consecutive rows of a partition."""
    spark = docs.sparkSession
    at = shared.folder(spark, "treaps")
    n_docs, n_terms = counts(docs, text)

    def run(batches):
        held, size, rows = [], 0, 0

        def close():
            row = np.concatenate([x[1][0] + x[0] for x in held])
            made = grid(row, np.concatenate([x[1][1] for x in held]), np.concatenate([x[1][2] for x in held]), rows, n_docs, n_terms)
            if made is None:
                return
            ids = pa.concat_arrays([x[2] for x in held])
            order = made.pop("order")
            known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
            uri = f"{at}/{uuid.uuid4().hex}"  # a task that runs again writes files of its own
            put_arrays(uri, **made, known=known, ids=ids.fill_null(0).to_numpy()[order])
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(order)]), pa.array([len(made["tf"])])], names=["shard", "docs", "points"])

        for batch in batches:
            for a, b in slices(batch.column(1), min(shard_bytes, SLICE)):
                part = batch.column(1)[a:b]
                bytes_ = int(buffers(part)[1][-1])
                if rows and (size + bytes_ > shard_bytes or rows + b - a > SHARD_DOCS):
                    yield from close()
                    held, size, rows = [], 0, 0
                held.append((rows, term_counts(part), batch.column(0)[a:b]))
                size, rows = size + bytes_, rows + b - a
        if rows:
            yield from close()

    made = docs.select(F.col(key).cast("long"), text).mapInArrow(run, "shard string, docs long, points long")
    return shared.cut(made, shared.folder(spark, "shards")), n_docs


def _per_task(shards: DataFrame) -> DataFrame:
    """The shards' names, a few to a task."""
    n = shards.count()
    return shards.select("shard").repartition(max(1, -(-n // SHARDS_PER_TASK)), "shard")


def search(shards: DataFrame, n_docs: int, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item with a score above 0."""
    spark = shards.sparkSession
    at = shared.folder(spark, "items")
    items = shared.cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_id"), F.col(text).alias("text")), f"{at}/rows")
    blocks = max(1, -(-items.count() // BLOCK))

    def terms_of(batches):
        for batch in batches:
            row, h, n = term_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(n)], names=["item", "term", "n"])

    block = F.expr(f"pmod(xxhash64(item), {blocks})").alias("block")
    terms = items.select("item", "text").mapInArrow(terms_of, "item long, term long, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))
    terms = shared.cut(terms.select(block, "item", "term", "n"), f"{at}/terms")

    def put_terms(table: pa.Table) -> pa.Table:
        put_arrays(f"{at}/asked-{table.column('block')[0].as_py()}", terms=np.unique(table.column("term").to_numpy().view(np.uint64)))
        return table.select(["block"])[:1]

    asked = [r.block for r in terms.groupBy("block").applyInArrow(put_terms, "block long").collect()]  # a number a block

    def held(batches):
        uris = [u for batch in batches for u in batch.column(0).to_pylist()]
        for b in asked if uris else []:
            wanted = arrays(f"{at}/asked-{b}")["terms"]
            df = np.zeros(len(wanted), np.int64)
            for uri in uris:
                own = arrays(uri)
                i, there = find(own["terms"], wanted)
                df[there] += own["df"][i[there]]
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b)), pa.array(wanted[some].view(np.int64)), pa.array(df[some])], names=["block", "term", "df"])

    df = _per_task(shards).mapInArrow(held, "block long, term long, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = terms.join(df, ["block", "term"]).select("block", "item", "term", (weight * F.col("n")).alias("weight")).where("weight > 0")

    def put_items(table: pa.Table) -> pa.Table:
        item, term, w = (table.column(c).to_numpy() for c in ("item", "term", "weight"))
        by = np.lexsort((term, item))
        put_arrays(f"{at}/items-{table.column('block')[0].as_py()}", item=item[by], term=term[by].view(np.uint64), weight=w[by])
        return table.select(["block"])[:1]

    ready = [r.block for r in weighed.groupBy("block").applyInArrow(put_items, "block long").collect()]

    def ranked(batches):
        from pyspark import TaskContext

        uris = [u for batch in batches for u in batch.column(0).to_pylist()]
        for b in ready if uris else []:
            x = arrays(f"{at}/items-{b}")
            cuts = runs(x["item"])
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * (len(cuts) - 1)
            for uri in uris:
                treap = Treap(uri)
                for i, (first, end) in enumerate(zip(cuts[:-1], cuts[1:])):
                    score, ids, known = best[i]
                    cols, found = treap.best(x["term"][first:end], x["weight"][first:end], k, int(score[-1]) if len(score) == k else 1)
                    score, ids, known = np.append(score, found), np.append(ids, treap.ids[cols]), np.append(known, treap.known[cols])
                    by = np.lexsort((ids, ~known, -score))[:k]
                    best[i] = score[by], ids[by], known[by]
            sizes = [len(s) for s, _, _ in best]
            ids = pa.array(np.concatenate([i for _, i, _ in best]), mask=~np.concatenate([n for _, _, n in best]))
            task = np.full(sum(sizes), TaskContext.get().partitionId() // 64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x["item"][cuts[:-1]], sizes)), pa.array(task), ids, pa.array(np.concatenate([s for s, _, _ in best]))], names=["item", "task", "doc_id", "score"])

    found = _per_task(shards).mapInArrow(ranked, "item long, task long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The k best of 64 tasks, then of all.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).where(F.col("rank") <= k)
    every = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return items.select("item", "item_id").join(every, "item").select("item_id", "rank", "doc_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    shards, n_docs = build(docs)
    return search(shards, n_docs, items)

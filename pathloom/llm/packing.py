"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt by hash to shards of a few thousand.
Each shard is bred on several islands (each a task's row): a chromosome is a set
of bins; crossover injects the donor's best-filled bins whole, drops the bins
that hold a piece twice, lets displaced pieces take the places of smaller ones
where a bin gets fuller by it, and best-fits the rest by descending size; mutation
empties the worst-filled bins.  After each epoch every island hands its
elite to the next one of the ring.  A shard is done as soon as it reaches the
lower bound of its bin count: no packing has fewer bins, so that further
generations could change nothing.  Where best-fit falls short the generations run, up
to a number and as long as some of the last ones found a better packing;
each epoch's table holds their number (``generations``), and epochs end when all
shards are done.

A shard has a bounded number of pieces whatever the input is, so memory and time
per task stay the same.  Sharding leaves one partly filled bin per shard; those of
``JOINED`` shards are then packed together in the same way.

Defined cases: a null or empty text is its end id alone; a text longer than a
sequence is cut from its end, so that its first piece may be shorter; repeated
rows are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encode import SLICE, encoder, with_end
from .words import slices

PIECES_PER_SHARD, ISLANDS, EPOCHS, JOINED = 4096, 3, 3, 256
POPULATION, OFFSPRING, PATIENCE = 6, 120, 12
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's tokens."""

    def run(batches):
        shared.release()  # what an earlier stage has mapped in this worker
        own = encoder(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                ids, ptr = with_end(*own.encode(batch.column(1)[a:b]), end)
                ids, size = ids.astype("<u4"), np.diff(ptr)
                n = -(-size // most)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                stop = size[row] - (n[row] - 1 - piece) * most
                start = np.maximum(stop - most, 0)
                base = ptr[:-1][row]
                crc = [zlib.crc32(ids[x:y]) for x, y in zip((base + start).tolist(), (base + stop).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _PIECES)


def lower_bound(size: np.ndarray, room: int) -> int:
    """Bins that any packing needs: the larger of the volume bound and the pairing bounds."""
    if not len(size):
        return 0
    s = np.sort(size)
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // room)
    for k in [0, *np.unique(s[s <= room // 2]).tolist()]:
        big = len(s) - int(np.searchsorted(s, room - k, "right"))  # no piece of size k or more fits beside them
        half = int(np.searchsorted(s, room // 2, "right"))
        small = int(np.searchsorted(s, k))
        middle = len(s) - big - half
        free = middle * room - int(total[len(s) - big] - total[half])
        volume = int(total[half] - total[small])
        best = max(best, big + middle + max(0, -(-(volume - free) // room)))
    return best


class Bins:
    """A chromosome: the bin of each piece (-1: none) and the room left in each bin."""

    def __init__(self, bin_of: np.ndarray, left: np.ndarray):
        self.bin_of, self.left = bin_of, left

    def fitness(self, room: int) -> tuple:
        fill = (room - self.left) / room
        return -len(fill), float(np.mean(fill * fill)) if len(fill) else 0.0

    def place(self, pieces: np.ndarray, size: np.ndarray, room: int, rng: random.Random | None = None) -> "Bins":
        """Best-fit ``pieces`` by descending size; with ``rng`` neighbours in that order may swap."""
        order = pieces[np.argsort(-size[pieces], kind="stable")].tolist()
        if rng is not None:
            for i in range(len(order) - 1):
                if rng.random() < 0.1:
                    order[i], order[i + 1] = order[i + 1], order[i]
        bin_of, left = self.bin_of.copy(), self.left.tolist()
        by_left: dict[int, list[int]] = {}
        mask = 0  # bit r: a bin has r left
        for b, r in enumerate(left):
            if r:
                by_left.setdefault(r, []).append(b)
                mask |= 1 << r
        for p in order:
            z = int(size[p])
            fits = mask >> z
            if fits:
                r = z + (fits & -fits).bit_length() - 1
                b = by_left[r].pop()
                if not by_left[r]:
                    mask &= ~(1 << r)
            else:
                r, b = room, len(left)
                left.append(room)
            left[b] = rest = r - z
            bin_of[p] = b
            if rest:
                by_left.setdefault(rest, []).append(b)
                mask |= 1 << rest
        return Bins(bin_of, np.array(left, np.int64))

    def exchanged(self, pieces: np.ndarray, size: np.ndarray) -> tuple["Bins", np.ndarray]:
        """Each of ``pieces``, the largest first, takes the place of a smaller one if its bin gets fuller: (bins, pieces without a bin)."""
        bin_of, left, out = self.bin_of.copy(), self.left.copy(), []
        for p in pieces[np.argsort(-size[pieces], kind="stable")].tolist():
            held = np.flatnonzero((bin_of >= 0) & (size < size[p]))
            after = left[bin_of[held]] + size[held] - size[p]
            fits = np.flatnonzero(after >= 0)
            if not len(fits):
                out.append(p)
                continue
            k = fits[np.argmin(after[fits])]
            q = int(held[k])
            bin_of[p], left[bin_of[q]] = bin_of[q], after[k]
            bin_of[q] = -1
            out.append(q)
        return Bins(bin_of, left), np.array(out, np.int64)

    def without(self, bins: np.ndarray) -> tuple["Bins", np.ndarray]:
        """The chromosome without some bins, and the pieces they held."""
        gone = np.zeros(len(self.left), bool)
        gone[bins] = True
        held = (self.bin_of >= 0) & gone[self.bin_of]
        new = np.cumsum(~gone) - 1
        bin_of = np.where(held | (self.bin_of < 0), -1, new[self.bin_of])
        return Bins(bin_of, self.left[~gone]), np.flatnonzero(held)


def best_fit(size: np.ndarray, room: int, rng: random.Random | None = None) -> Bins:
    return Bins(np.full(len(size), -1, np.int64), np.zeros(0, np.int64)).place(np.arange(len(size)), size, room, rng)


def crossover(receiver: Bins, donor: Bins, size: np.ndarray, room: int, rng: random.Random) -> Bins:
    """The receiver with a share of the donor's best-filled bins in it."""
    best = np.argsort(donor.left, kind="stable")
    n = max(1, int(len(best) * rng.uniform(0.1, 0.5)))
    first = rng.randrange(max(1, len(best) // 2))
    chosen = np.zeros(len(donor.left), bool)
    chosen[best[first : first + n]] = True
    injected = chosen[donor.bin_of]
    rest, displaced = receiver.without(np.unique(receiver.bin_of[injected]))
    into = len(rest.left) + np.cumsum(chosen) - 1
    bin_of = np.where(injected, into[donor.bin_of], rest.bin_of)
    child = Bins(bin_of, np.concatenate([rest.left, donor.left[chosen]]))
    child, displaced = child.exchanged(displaced[~injected[displaced]], size)
    return child.place(displaced, size, room, rng)


def mutate(x: Bins, size: np.ndarray, room: int, rng: random.Random) -> Bins:
    """Empty the worst-filled bins and a few others, and place their pieces again."""
    n = len(x.left)
    worst = np.argsort(-x.left, kind="stable")[: max(2, n // 50)]
    some = [rng.randrange(n) for _ in range(max(2, n // 50))]
    rest, pieces = x.without(np.unique(np.concatenate([worst, some])))
    rest, pieces = rest.exchanged(pieces, size)
    return rest.place(pieces, size, room, rng)


def evolve(size: np.ndarray, room: int, elite: list[Bins], seed: int) -> tuple[Bins, int, bool]:
    """One epoch of an island: (best chromosome, generations bred, whether it has reached the lower bound, which ends it)."""
    rng, bound = random.Random(seed), lower_bound(size, room)
    key = lambda b: b.fitness(room)
    pool = list(elite) or [best_fit(size, room)]
    while len(pool) < POPULATION and len(max(pool, key=key).left) > bound:
        pool.append(best_fit(size, room, rng))
    bred = better = 0
    for _ in range(OFFSPRING):
        pool.sort(key=key, reverse=True)
        if len(pool[0].left) <= bound or bred - better >= PATIENCE:
            break
        a, b = sorted(rng.sample(range(len(pool)), 2))
        child = crossover(pool[a], pool[b], size, room, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, room, rng)
        bred += 1
        if key(child) > key(pool[0]):
            better = bred
        pool = [*pool[: POPULATION - 1], child]
    best = max(pool, key=key)
    return best, bred, len(best.left) <= bound


def pack(pieces: DataFrame, room: int, seed: int = 41, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` (a stored table with ``length`` from 1 to ``room`` and a unique long ``rid``) with sequence_id and offset."""
    if islands < 1 or epochs < 1:
        raise ValueError("islands and epochs must be positive")
    spark = pieces.sparkSession
    at = shared.folder(spark, "pack")
    small = pieces.where(F.col("length") < room).select("rid", "length")
    shards = max(1, -(-small.count() // PIECES_PER_SHARD))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "rids": [pdf["rid"].to_numpy("<i8").tobytes()], "sizes": [pdf["length"].to_numpy("<i8").tobytes()]})

    dealt = small.withColumn("shard", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(shards)).cast("int"))
    problem = shared.cut(dealt.groupBy("shard").applyInPandas(gather, "shard int, rids binary, sizes binary"), f"{at}/problem")

    def epoch(number: int):
        def run(frames):
            for pdf in frames:
                bins, fills, bred, done = [], [], [], []
                for r in pdf.itertuples():
                    size = np.frombuffer(r.sizes, "<i8")
                    elite = []
                    for blob in () if r.elite is None else r.elite:
                        bin_of = np.frombuffer(blob, "<i4").astype(np.int64)
                        elite.append(Bins(bin_of, room - np.bincount(bin_of, size).astype(np.int64)))
                    got, n, at_bound = evolve(size, room, elite, hash((seed, number, r.shard, r.island)))
                    bred.append(n)
                    done.append(at_bound)
                    bins.append(got.bin_of.astype("<i4").tobytes())
                    fills.append([float(x) for x in got.fitness(room)])
                yield pd.DataFrame({"shard": pdf["shard"], "island": pdf["island"], "own": bins, "fit": fills, "generations": bred, "done": done})

        return run

    ring = problem.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    found = None
    for number in range(epochs):
        state = ring.withColumn("elite", F.lit(None).cast("array<binary>"))
        if found is not None:
            # Each island goes on with its own elite and that of its neighbour in the ring.
            own = found.select("shard", "island", "own")
            moved = found.select("shard", ((F.col("island") + 1) % islands).alias("island"), "own")
            elites = own.unionByName(moved).groupBy("shard", "island").agg(F.collect_list("own").alias("elite"))
            state = ring.join(elites, ["shard", "island"])
        rows = state.repartition("shard", "island").mapInPandas(epoch(number), "shard int, island int, own binary, fit array<double>, generations int, done boolean")
        found = shared.cut(rows, f"{at}/epoch-{number}")
        if found.groupBy("shard").agg(F.max("done").alias("done")).where("NOT done").isEmpty():
            break
    best = found.groupBy("shard").agg(F.max_by("own", F.struct("fit", "island")).alias("own"))

    def places(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                rid, size, bin_of = np.frombuffer(r.rids, "<i8"), np.frombuffer(r.sizes, "<i8"), np.frombuffer(r.own, "<i4").astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                upto = np.cumsum(size[order]) - size[order]
                first = np.searchsorted(bin_of[order], bin_of[order])
                worst = int(np.argmin(np.bincount(bin_of, size)))
                yield pd.DataFrame({"rid": rid[order], "length": size[order], "sequence_id": (r.shard << 32) + bin_of[order], "offset": upto - upto[first], "worst": bin_of[order] == worst})

    def join_worst(pdf: pd.DataFrame) -> pd.DataFrame:
        """The worst-filled bins of some shards, packed together."""
        pdf = pdf.sort_values("rid")
        size, names = pdf["length"].to_numpy(np.int64), pdf["sequence_id"].to_numpy()
        group = int(pdf["group"].iloc[0])
        kinds, bin_of = np.unique(names, return_inverse=True)
        got, _, _ = evolve(size, room, [Bins(bin_of.astype(np.int64), room - np.bincount(bin_of, size).astype(np.int64)), best_fit(size, room)], hash((seed, group)))
        if len(got.left) < len(kinds):
            kinds, bin_of = (1 << 62) + (group << 32) + np.arange(len(got.left)), got.bin_of
        order = np.argsort(bin_of, kind="stable")
        upto = np.cumsum(size[order]) - size[order]
        first = np.searchsorted(bin_of[order], bin_of[order])
        return pd.DataFrame({"rid": pdf["rid"].to_numpy()[order], "sequence_id": kinds[bin_of[order]], "offset": upto - upto[first]})

    packed = problem.join(best, "shard").select("shard", "rids", "sizes", "own").mapInPandas(places, "rid long, length long, sequence_id long, offset long, worst boolean")
    packed = shared.cut(packed, f"{at}/packed")
    worst = packed.where("worst").withColumn("group", F.floor(F.shiftright("sequence_id", 32) / JOINED).cast("long"))
    joined = worst.groupBy("group").applyInPandas(join_worst, "rid long, sequence_id long, offset long")
    placed = packed.where("NOT worst").select("rid", "sequence_id", "offset").unionByName(joined)
    full = pieces.where(F.col("length") >= room).select(*pieces.columns, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < room).join(placed, "rid").select(*full.columns).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, room: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    at = shared.folder(docs.sparkSession, "pieces")
    pieces = shared.cut(cut_pieces(docs, tokenizer, end, room, key, text).withColumn("rid", F.monotonically_increasing_id()), at)
    return pack(pieces, room).drop("rid")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

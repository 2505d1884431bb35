"""Questions to hash shards and answers back, without tables that every task opens.

A task gathers the keys of a run of rows, a *flush*, stores what it will need
again as one file, and ships the distinct keys in blocks: one block for each hash
shard that the keys fall into.  A shard's task has the blocks of all flushes
before it, works on that slice of the keys alone and answers block by block; the
answers of a flush come to one task, which maps the flush's one file.  So files
are opened once a flush and once a shard, whatever the number of either.

Blocks stay long however many shards there are: beyond ``FAN`` shards a flush's
block is for a group of neighbouring ones, and tasks in between gather the blocks
of a group from many flushes and cut them by shard anew (``deal``).  They store
where each key came from, and the answers return the same way (``back``).

A flush is named by its place and by a digest of what it ships.  A task that runs
again on the same rows writes the same file and name; if it sees other rows, the
answers under the old name are incomplete and the flush's task raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BLOCK = "shard long, flush string, n long, block binary"
SCHEMA = pa.schema([("shard", pa.int64()), ("flush", pa.string()), ("n", pa.int64()), ("block", pa.binary())])
_SMALL = 512
#: Groups of shards that flushes ship blocks to, keys that are dealt on together, and batches of them for a dealing task.
FAN, BATCH, BATCHES = 2048, 1 << 20, 16
#: Shard ``s`` of kind ``k`` has the number ``k * KIND + s``: blocks of several kinds may travel together.
KIND = 1 << 40


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers as byte planes, each column in the fewest bytes that hold it, compressed if that pays."""
    head, planes = [], []
    for c in columns:
        c = narrow(c)
        head.append(c.dtype.itemsize)
        planes.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    body = b"".join(planes)
    if len(body) < _SMALL:
        return bytes([0, *head]) + body
    return bytes([1, *head]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(block: bytes, n: int, columns: int) -> list[np.ndarray]:
    """The uint64 columns of a packed block of ``n`` rows."""
    sizes, body = list(block[1 : 1 + columns]), block[1 + columns :]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body) if block[0] else body, np.uint8)
    at, out = 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(f"<u{size}").ravel().astype(np.uint64))
        at += size * n
    return out


def narrow(c: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds the values."""
    top = int(c.max()) if len(c) else 0
    return c.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of uint64 hashes; ascending hashes have ascending shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values, and the length."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values))


def sum_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys and the sums of values over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = runs(keys)[:-1]
    return [keys[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]]


def count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    keys = np.sort(keys)
    at = runs(keys)
    return keys[at[:-1]], np.diff(at)


def span_of(shards: int) -> int:
    """Neighbouring shards that share a flush's block."""
    return -(-shards // FAN)


def cells(flush: str, shard: np.ndarray, *columns: np.ndarray, span: int = 1) -> pa.RecordBatch:
    """One block for each ``span`` neighbouring shards that have rows; ``shard`` ascends."""
    shard = shard // span
    at = runs(shard).tolist()
    rows = [(int(shard[a]), flush, b - a, pack(*[c[a:b] for c in columns])) for a, b in zip(at[:-1], at[1:])]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(SCHEMA.types)], schema=SCHEMA)


def flush_name(number: int, *columns: np.ndarray) -> str:
    """Name of a task's flush by its place and what it ships."""
    from pyspark import TaskContext

    own, digest = TaskContext.get(), xxhash.xxh3_128()
    for c in columns:
        digest.update(np.ascontiguousarray(c).view(np.uint8))
    return f"{own.partitionId() if own else 0:06d}-{number:06d}-{digest.hexdigest()}"


class Blocks:
    """The blocks of one shard as columns, and answers in their order."""

    def __init__(self, pdf: pd.DataFrame, columns: int):
        self.rows = pdf
        self.shard = int(pdf["shard"].iloc[0])
        sizes = pdf["n"].to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        parts = [unpack(b, n, columns) for b, n in zip(pdf["block"], sizes)]
        self.columns = [np.concatenate([p[k] for p in parts]) for k in range(columns)]

    def answers(self, *columns: np.ndarray) -> pd.DataFrame:
        blocks = [pack(*[c[a:b] for c in columns]) for a, b in zip(self.ends[:-1], self.ends[1:])]
        return pd.DataFrame({"shard": self.rows["shard"].to_numpy(), "flush": self.rows["flush"].to_numpy(), "n": self.rows["n"].to_numpy(), "block": blocks})


def gathered(pdf: pd.DataFrame, columns: int, want: int) -> list[np.ndarray]:
    """A flush's answers in the order of its shards; ``want``: how many keys it shipped."""
    pdf = pdf.sort_values("shard")
    parts = [unpack(b, n, columns) for b, n in zip(pdf["block"], pdf["n"])]
    if sum(pdf["n"]) != want:
        raise RuntimeError("a flush has lost answers: its rows came in another order when its task ran again")
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(columns)]


def _dealing(at: str, columns, shard_of, answered: bool, most: int):
    """Blocks of groups to blocks of shards, ``most`` keys or a little more at a time."""

    def run(batches):
        held, n, number = [], 0, 0

        def dealt():
            kind = held[0][0] // KIND
            own = [np.concatenate([h[3][k] for h in held]) for k in range(columns(kind))]
            to = shard_of(kind, own)
            order = np.argsort(to, kind="stable")
            name = flush_name(number, np.array([h[0] for h in held], np.int64), *own) if answered else ""
            if answered:
                flushes = "\n".join(h[1] for h in held).encode()
                put_arrays(f"{at}/dealt-{name}", order=narrow(order), groups=np.array([h[0] for h in held], np.int64), sizes=np.array([h[2] for h in held], np.int64), flushes=np.frombuffer(flushes, np.uint8))
            return cells(name, kind * KIND + to[order], *[c[order] for c in own])

        for batch in batches:
            for group, flush, size, block in zip(*[c.to_pylist() for c in batch.columns]):
                if group < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((group, flush, size, block), SCHEMA.types)], schema=SCHEMA)
                    continue
                if held and (n >= most or group // KIND != held[0][0] // KIND):
                    yield dealt()
                    held, n, number = [], 0, number + 1
                held.append((group, flush, size, unpack(block, size, columns(group // KIND))))
                n += size
        if held:
            yield dealt()

    return run


def deal(asked: DataFrame, at: str, shards: int, columns, shard_of, answered: bool = True) -> DataFrame:
    """Blocks of groups of shards to blocks of shards; as they are where a group is one shard.

    ``columns(kind)``: how many columns a block has; ``shard_of(kind, columns)``: the
    shards of its keys.  Where nothing is ``answered``, nothing is kept for
    ``back``.  Rows of negative shards pass.
    """
    span = span_of(shards)
    if span == 1:
        return asked
    # In the order of groups and flushes, so that a task that runs again deals the same.
    slices = F.pmod(F.xxhash64("block"), F.lit(-(-span // BATCHES)))
    rows = asked.withColumn("slice", slices).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "flush").drop("slice")
    return rows.mapInArrow(_dealing(at, columns, shard_of, answered, BATCH), BLOCK)


def back(answered: DataFrame, at: str, shards: int, columns) -> DataFrame:
    """Answers to dealt blocks to answers to the blocks that the flushes shipped; ``columns(kind)``: how many an answer has."""
    if span_of(shards) == 1:
        return answered

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stored = arrays(f"{at}/dealt-{pdf['flush'].iloc[0]}")
        groups, sizes, order = stored["groups"], stored["sizes"], stored["order"]
        got = gathered(pdf, columns(int(groups[0]) // KIND), len(order))
        own = []
        for g in got:
            own.append(np.empty(len(g), g.dtype))
            own[-1][order] = g
        ends = np.cumsum(sizes)
        blocks = [pack(*[c[b - n : b] for c in own]) for b, n in zip(ends.tolist(), sizes.tolist())]
        return pd.DataFrame({"shard": groups, "flush": stored["flushes"].tobytes().decode().split("\n"), "n": sizes, "block": blocks})

    return answered.groupBy("flush").applyInPandas(run, BLOCK)


def put_arrays(uri: str, **arrays: np.ndarray) -> None:
    """Store named arrays as one file, each at a multiple of eight bytes."""
    names, head, body, at = list(arrays), [], [], 0
    for name in names:
        a = np.ascontiguousarray(arrays[name])
        raw = a.view(np.uint8).ravel()
        head.append(f"{name}:{a.dtype.str}:{at}:{len(raw)}")
        body += [raw.tobytes(), bytes(-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    text = ";".join(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    shared.put(uri, [np.array([len(text)], "<i8").tobytes(), text, *body])


def arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a stored file, mapped into memory."""
    raw = shared.view(uri)
    size = int(np.frombuffer(raw, "<i8", 1)[0])
    out = {}
    for entry in bytes(raw[8 : 8 + size]).decode().strip().split(";"):
        name, kind, at, n = entry.split(":")
        out[name] = np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, 8 + size + int(at))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value in sorted ``keys``, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted

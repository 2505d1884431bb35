"""Line dedup: Bloom filters of once-seen and twice-seen line hashes.

1. Every task hashes its documents' normalised lines, stores their digests and
   ships only sorted hash blocks, one per hash shard (``exchange``).
2. Each shard streams its blocks through a filter of once-seen hashes; a hash
   that is already there is a suspect.  A second filter holds the suspects, and
   the blocks are answered by it: a bit for each hash.
3. Only lines in that second filter (repeats and a few false positives) are
   shuffled with their ids, as 128-bit digests, for the exact count of
   documents and the choice of the document that keeps the line.
4. What a document loses comes back to it by (id, hash of the text): a join that
   Spark broadcasts or shuffles by the stored size of the losses.

Shards grow in number with the documents, so a shard's filters stay of one size,
and a shard's filters are seen by its own task alone.  Suspects of one digest are
pre-aggregated per task: a line in a third of all documents costs no task more
than any other.

Defined cases: a null text counts as one empty line and stays null; a null id is
one id of its own, below all others; rows of equal id are one document; lines
whose key is shorter than ``min_chars`` always stay; an empty table gives no
rows; other columns stay (those named as outputs are replaced).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .exchange import BLOCK, Blocks, arrays, back, cells, deal, flush_name, gathered, put_arrays, shard_of, span_of

SPACE = b" \t\n\x0b\x0c\r"
#: Hashes that a task holds before it ships them, and documents per hash shard.
FLUSH, DOCS_PER_SHARD = 1 << 19, 100_000
BITS_PER_KEY, PROBES = 12, 6
_NULL_ID = -(1 << 63)


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None where it is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # of bytes: A-Z alone


def _digests(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct 128-bit digests of a text's countable keys."""
    if not text or len(text) < min_chars:
        return []
    found = {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (k := _key(line, min_chars)) is not None}
    return [xxhash.xxh3_128_digest(k) for k in found]


def _as_pairs(digests: bytes) -> np.ndarray:
    """(n, 2) uint64; the first column is the hash that filters and shards use."""
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


class Bloom:
    """A Bloom filter over uint64 hashes with vectorised double hashing.

    Many filters may lie in one array of bytes: ``first`` and ``size`` are then the
    place of each hash's own filter.
    """

    def __init__(self, bits: np.ndarray, first=0, size=None):
        self.bits, self.first, self.size = bits, first, len(bits) if size is None else size

    @classmethod
    def of_size(cls, keys: int) -> "Bloom":
        return cls(np.zeros(max(64, keys * BITS_PER_KEY // 8 + 1), np.uint8))

    def _at(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(byte, bit) of the k-th probe."""
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        at = (low * np.uint64(0x9E3779B1) + np.uint64(k) * high * np.uint64(0x85EBCA77)) % (np.asarray(self.size, np.uint64) * np.uint64(8))
        return self.first + (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)

    def add(self, h: np.ndarray) -> None:
        for k in range(PROBES):
            at, bit = self._at(h, k)
            np.bitwise_or.at(self.bits, at, np.uint8(1) << bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for k in range(PROBES):
            at, bit = self._at(h, k)
            out &= (self.bits[at] >> bit & np.uint8(1)).astype(bool)
        return out


def _asked(h: np.ndarray) -> np.ndarray:
    """Sorted hashes; one that two documents of a flush have is there twice, which makes it a suspect."""
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    keep[2:] = h[2:] != h[:-2]
    return h[keep]


def _ship(at: str, min_chars: int, shards: int):
    """Documents (id, hash of the text, text) to blocks of line hashes; their digests are stored."""
    span = span_of(shards)

    def run(batches):
        shared.forget()  # what other stages have left in this worker
        ids, texts, digests, n, number = [], [], [], 0, 0

        def flush():
            pairs = _as_pairs(b"".join(digests))
            h = _asked(pairs[:, 0])
            name = flush_name(number, np.array(ids, np.int64), pairs)
            put_arrays(f"{at}/lines-{name}", ids=np.array(ids, np.int64), texts=np.array(texts, np.int64), pairs=pairs)
            return cells(name, shard_of(h, shards), h, span=span)

        for batch in batches:
            for own, hashed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if d := _digests(text.as_py(), min_chars):
                    ids += [_NULL_ID if own is None else own] * len(d)
                    texts += [hashed] * len(d)
                    digests += d
                    n += len(d)
                if n >= FLUSH:
                    yield flush()
                    ids, texts, digests, n, number = [], [], [], 0, number + 1
        if n:
            yield flush()

    return run


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's blocks to a bit for each hash: whether the filter of twice-seen hashes has it."""
    blocks = Blocks(pdf, 1)
    (hashes,) = blocks.columns
    once, twice = Bloom.of_size(len(hashes)), []
    for a, b in zip(blocks.ends[:-1].tolist(), blocks.ends[1:].tolist()):
        h = hashes[a:b]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        fresh = h[~again]
        seen = once.has(fresh)
        twice += [h[again], fresh[seen]]
        once.add(fresh[~seen])
    found = np.unique(np.concatenate(twice))
    suspects = Bloom.of_size(len(found))
    suspects.add(found)
    return blocks.answers(suspects.has(hashes).astype(np.uint8))


def _suspected(at: str):
    """A flush's answers to (digest, id, hash of the text) of its suspected lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stored = arrays(f"{at}/lines-{pdf['flush'].iloc[0]}")
        pairs = stored["pairs"].view("<u8").reshape(-1, 2)
        h = _asked(pairs[:, 0])
        (bits,) = gathered(pdf, 1, len(h))
        hit = bits[np.searchsorted(h, pairs[:, 0])] > 0
        own = pairs[hit].tobytes()
        return pd.DataFrame({"digest": [own[i : i + 16] for i in range(0, len(own), 16)], "id": stored["ids"][hit], "t": stored["texts"][hit]})

    return run


def _rebuild(min_chars: int, schema: pa.Schema, text_name: str):
    """Documents with ``__gone``, the digests of the lines that they lose, to their new texts."""

    def run(batches):
        for batch in batches:
            texts, total, dropped = [], [], []
            for gone, text in zip(batch.column(batch.schema.get_field_index("__gone")), batch.column(batch.schema.get_field_index(text_name))):
                text = text.as_py()
                if not gone.is_valid or text is None:
                    texts.append(text)
                    total.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                gone = set(gone.as_py())
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                kept = [x for x in lines if (k := _key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            new = {text_name: pa.array(texts, schema.field(text_name).type), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in schema], schema=schema)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and n_lines (before), n_dropped.

    A line whose key (stripped, A-Z lower-cased) has ``min_chars`` characters and
    is in ``min_docs`` documents stays only in the document of the largest id.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    losses = shared.folder(spark, "losses")
    own = {"__id": F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)), "__t": F.xxhash64(text)}
    with shared.scratch(spark):
        at = shared.folder(spark, "lines")
        shards = max(4, -(-docs.count() // DOCS_PER_SHARD))
        asked = docs.select(F.col(key).cast("long").alias("id"), own["__t"].alias("t"), F.col(text).alias("text")).mapInArrow(_ship(at, min_chars, shards), BLOCK)
        asked = deal(asked, at, shards, lambda _: 1, lambda _, own: shard_of(own[0], shards))
        answered = back(asked.groupBy("shard").applyInPandas(_suspects, BLOCK), at, shards, lambda _: 1)
        suspects = shared.cut(answered.groupBy("flush").applyInPandas(_suspected(at), "digest binary, id long, t long"), f"{at}/suspects")
        often = suspects.groupBy("digest").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("keep")).where(F.col("docs") >= min_docs)
        often = shared.cut(often.drop("docs"), f"{at}/often")
        lost = suspects.join(often, "digest").where("id <> keep")
        lost = shared.cut(lost.groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("digest").alias("__gone")), losses)
    out = docs.select(*docs.columns, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    # One plan at every size: a broadcast of small losses would only hide what large ones cost.
    joined = docs.withColumns(own).join(lost.hint("merge"), ["__id", "__t"], "left")
    return joined.select(*docs.columns, "__gone").mapInArrow(_rebuild(min_chars, to_arrow_schema(out), text), out)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))



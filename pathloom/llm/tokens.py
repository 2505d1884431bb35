"""Token ids in ORC files.

Documents are put in ascending id order by a range shuffle and a sort within
partitions, encoded whole, and written as ORC: integers run-length encoded,
a row index every ``stride`` rows, and Bloom filters on the document ids.
Readers take stripes in parallel; a filter on ids skips files and stripes by
their statistics and row groups by row index and Bloom filter.

Every record holds the number of its file in the order (``part``) and the place
of its first id among the file's ids (``at``).  The place among all ids is the sum
of the lower files' token counts (one row per file) plus ``at``.

Defined cases: a null or empty text has the end id alone; a null document id
comes first; rows of equal id keep their own records in the order of a hash of
their texts, by which they may also be spread over several files; an empty table
gives an empty folder of files; other columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .encode import SLICE, encoder, with_end
from .words import slices

SCHEMA = "doc_id long, n_tokens int, part int, at long, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, part, at, ids) of every document in its partition's order; ``end`` closes each."""

    def run(batches):
        from pyspark import TaskContext

        own, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                ids, ptr = with_end(*own.encode(batch.column(1)[a:b]), end)
                values = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(ids.view(np.int32)))
                cols = [batch.column(0)[a:b], pa.array(np.diff(ptr).astype(np.int32)), pa.array(np.full(b - a, part, np.int32)), pa.array(at + ptr[:-1]), values]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "part", "at", "ids"])
                at += len(ids)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, at: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text", stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Write the token ids of ``docs`` as ORC files in ascending id order at ``at``."""
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("__h", F.xxhash64("text")).repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h")
    rows = encode_documents(ordered, tokenizer, end, "doc_id", "text")
    # Names of ORC's own settings.
    writer = rows.write.mode("overwrite").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_bytes)).orc(at)


def read_tokens(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, part, at, ids); with ``doc_ids`` only theirs, the rest skipped by metadata."""
    rows = spark.read.schema(SCHEMA).orc(at)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_places(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def sums(batches):
        for batch in batches:
            part, doc, at, ids = (batch.column(k) for k in range(4))
            ptr = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
            yield pa.RecordBatch.from_arrays([part, doc, at, pa.array(np.diff(ptr).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).orc(at)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("__all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = files.select("part", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__before"))  # one row per file
    read = rows.select("part", "doc_id", "at", "ids").mapInArrow(sums, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(firsts), "part").select("doc_id", (F.col("__before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = shared.folder(spark, "tokens")
    write_tokens(docs, at, public_tokenizers.path("word_bpe_49k.json"))
    return token_places(spark, at)

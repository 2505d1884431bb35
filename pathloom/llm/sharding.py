"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, each gets its fractional
rank (rank - 1/2) / rows of the source, all rows are put in the order of the
fractional ranks and this order is cut into equal runs.  Every shard then holds
each source in the proportion of the whole, and row counts differ by one at most.

No source and no shard is ever gathered in one task: ranks come from counts of
hash ranges (prefix-summed) plus a row number within one range.

Defined cases: a null source is a source of its own; null ids take part like
values (of many rows with one id, or none, ``ties`` spread the ranks' work);
repeated rows get places of their own; an empty table gives no rows;
input columns stay (one whose name is an output name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a source's hash range, and of a range of the whole order (whose counts pass through one task).
ROWS_PER_RANGE, PLACES_PER_RANGE = 2_000, 20_000


def stable_hash(seed: int, *cols: Column) -> Column:
    """md5 of the seed and the values; the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def _range_of(hashed: Column, ranges: int) -> Column:
    """Number of the range of md5 values, in their order."""
    return F.floor(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("long")


def interleave(docs: DataFrame, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards-1) and ``slot`` (place in it, gapless from 0).

    ``ties``: further columns that spread and order rows of equal source and key.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    docs = docs.drop("shard", "slot")
    total = docs.count()
    ranges, spans = max(1, -(-total // ROWS_PER_RANGE)), max(1, -(-total // PLACES_PER_RANGE))
    h = stable_hash(seed, F.col(key), *[F.col(c) for c in ties])
    rows = docs.withColumns({"__h": h, "__s": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))}).withColumn("__b", _range_of(F.col("__h"), ranges))

    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    starts = counts.select(
        "__s", "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(Window.partitionBy("__s")).alias("__all"),
    )
    order = [F.col("__h"), F.col(key), *[F.col(c) for c in ties]]
    ranked = rows.join(starts, ["__s", "__b"]).withColumn("__r", F.col("__start") + F.row_number().over(Window.partitionBy("__s", "__b").orderBy(*order)))
    placed = ranked.withColumn("__f", (2 * F.col("__r") - 1) / (2 * F.col("__all"))).withColumn("__g", F.floor(F.col("__f") * spans).cast("long"))

    # The place in the whole order: the fractional rank's range starts after all lower ranges.
    per_range = placed.groupBy("__g").agg(F.count("*").alias("__m"))
    firsts = per_range.select("__g", F.coalesce(F.sum("__m").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    pos = F.col("__first") + F.row_number().over(Window.partitionBy("__g").orderBy(F.col("__f"), F.col("__s"), *order)) - 1
    out = placed.join(firsts, "__g").withColumn("__pos", pos).withColumn("shard", F.expr(f"cast(__pos * {n_shards} div {max(total, 1)} as int)"))
    first_of = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", (F.col("__pos") - first_of).cast("long")).select(*docs.columns, "shard", "slot")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8")).cast("long")})
    out = interleave(sized, 40, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

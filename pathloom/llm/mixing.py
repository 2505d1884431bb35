"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has the exponential key -ln(u) / quality weight, u from a seeded
hash of its id and text; smaller keys come first.  Within a source the documents
are sorted by key and their sizes prefix-summed to the source's budget.  A target
above the source's size is met by complete epochs first; only the rest is a
fractional selection.  After the prefix one more document may come in: the one
that brings the source's sum nearest to its target.

A source is never sorted in one task: key ranges are summed first and
prefix-summed, and rows are ordered only within a range.  Ranges go by the
distribution of the keys that the shares of the weights give, so all hold about
as many rows.  Rows alike in all that counts are one entry with a number of
copies; the selection may end inside an entry.  It is a threshold per source, so
it applies to the documents without moving their texts.

Defined cases: a null source is a source of its own and comes last; null or
empty texts have size 0 and are taken 0 words; a source of size 0 has target 0;
of identical rows as many are taken as the budget has room for; an empty table
gives no rows; input columns stay (one whose name is an output name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .sharding import stable_hash

ROWS_PER_RANGE = 2_000
WORD = r"[^\x20\x09-\x0D]+"
ENTRY = ("es", "id", "size", "th")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 to 4: one more for 50 words, for words of 3 to 12 characters on average, and for few symbols."""
    chars = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}", ""))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return 1 + one(size >= 50) + one((chars >= 3 * size) & (chars <= 12 * size)) + one(symbols * 20 <= size)


def targets(sizes: DataFrame, share: float, cap: float, weights: list[float]) -> DataFrame:
    """(s, source_size, target) of each source: weights repeat over the sources in order.

    Targets are min(cap * size, level * weight) for the one level at which they
    sum to ``share`` of all sizes: the limit of handing the excess over again.
    """
    order = Window.orderBy("s")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", cycle).withColumn("cap", cap * F.col("source_size"))
    by = Window.orderBy((F.col("cap") / F.col("w")), "s")
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    x = x.withColumns({"capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), "open": F.sum("w").over(after), "want": F.lit(share) * F.sum("source_size").over(Window.partitionBy())})
    # If all lower ratios are at their caps, the others share what is left; the first source that stays under its cap has the level.
    x = x.withColumn("level", (F.col("want") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("s"), F.col("level"))))
    x = x.withColumn("at", level.over(Window.partitionBy()))
    return x.select("s", "source_size", F.when(F.col("at").isNull() | (F.col("at.level") * F.col("w") > F.col("cap")), F.col("cap")).otherwise(F.col("at.level") * F.col("w")).alias("target"))


def entry_columns(seed: int, source: str, key: str, text: str) -> list[tuple[str, Column]]:
    """What decides about a document, each from those before it: source, size, hash of the text, weight, key."""
    u = (F.conv(F.substring(stable_hash(seed, F.col(key), F.col("__th")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return [
        ("__s", F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))),
        ("__size", word_count(F.col(text))),
        ("__th", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))),
        ("__w", quality_weight(F.col(text), F.col("__size"))),
        ("__es", -F.log(u) / F.col("__w")),
    ]


def with_entries(docs: DataFrame, seed: int, source: str, key: str, text: str) -> DataFrame:
    for name, value in entry_columns(seed, source, key, text):
        docs = docs.withColumn(name, value)
    return docs


def decide(rows: DataFrame, share: float, cap: float, weights: list[float], at: str) -> DataFrame:
    """One row per source: its size, target and where its selection ends.

    ``rows``: a stored (id, s, size, th, w, es) per document.  ``__last`` is the last
    entry taken whole, ``__edge`` one of which ``__edge_n`` copies are taken, ``__close``
    one of which one more copy is taken.
    """
    by_weight = {r.w: r.n for r in rows.groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per weight
    total = max(1, sum(by_weight.values()))
    ranges = max(1, -(-total // ROWS_PER_RANGE))
    below = sum((F.lit(n / total) * (1 - F.exp(-w * F.col("es"))) for w, n in sorted(by_weight.items())), F.lit(0.0))
    kinds = rows.groupBy("s", *ENTRY).agg(F.count("*").alias("n")).withColumn("b", F.floor(ranges * below))
    per = shared.cut(kinds.groupBy("s", "b").agg(F.sum(F.col("size") * F.col("n")).alias("z")), f"{at}/ranges")
    starts = per.select("s", "b", F.coalesce(F.sum("z").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    goal = targets(per.groupBy("s").agg(F.sum("z").alias("source_size")), share, cap, weights)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = shared.cut(goal.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))), f"{at}/goal")
    step = Window.partitionBy("s", "b").orderBy(*ENTRY)
    summed = kinds.join(starts, ["s", "b"]).withColumn("upto", F.col("start") + F.sum(F.col("size") * F.col("n")).over(step)).join(goal.select("s", "rest"), "s")
    entry = F.struct(*ENTRY)
    inside = F.col("upto") <= F.col("rest")
    summed = shared.cut(summed, f"{at}/summed")
    first = summed.groupBy("s").agg(
        F.max(F.when(inside, entry)).alias("last"),
        F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("got"),
        F.min(F.when(~inside, F.struct(*ENTRY, "n"))).alias("edge"),
    )
    ends = goal.select("s", "rest").join(first, "s")
    ends = ends.withColumn("edge_n", F.coalesce(F.floor(F.try_divide(F.col("rest") - F.col("got"), F.col("edge.size"))), F.lit(0)).cast("long"))
    ends = ends.withColumn("gap", F.col("rest") - F.col("got") - F.col("edge_n") * F.coalesce(F.col("edge.size"), F.lit(0)))
    left = summed.where(~inside).join(ends.select("s", "gap"), "s")
    miss = F.abs(F.col("size") - F.col("gap"))
    close = left.where(miss < F.col("gap")).groupBy("s").agg(F.min(F.struct(miss.alias("miss"), *ENTRY, "n")).alias("close"))
    out = goal.join(ends.drop("rest"), "s", "left").join(close, "s", "left")
    return shared.cut(out.select(F.col("s").alias("__s"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("epochs", "last", "edge", "edge_n", "close")]), f"{at}/sources")


def _is(entry: str, key: Column) -> Column:
    e = F.col(entry)
    same = (e["es"] == F.col("__es")) & e["id"].eqNullSafe(key) & (e["size"] == F.col("__size")) & (e["th"] == F.col("__th"))
    return F.coalesce(same, F.lit(False))


def taken_copies(entries: DataFrame, decided: DataFrame, key: str, at: str) -> DataFrame:
    """``entries`` (with the columns of ``with_entries``) with source_size, target and ``copies``."""
    joined = entries.join(decided, "__s")  # a row per source
    own = F.struct(F.col("__es").alias("es"), F.col(key).alias("id"), F.col("__size").alias("size"), F.col("__th").alias("th"))
    # Copies that the selection takes of the row's entry, where it takes neither all nor none.
    some = F.when(_is("__edge", F.col(key)), F.col("__edge_n")).otherwise(F.lit(0)) + _is("__close", F.col(key)).cast("long")
    base = F.when(F.col("__size") == 0, F.lit(0).cast("long")).otherwise(F.col("__epochs") + F.coalesce(own <= F.col("__last"), F.lit(False)).cast("long"))
    keep = [*entries.columns, "source_size", "target"]
    repeated = decided.where("(__edge.n > 1 AND (__edge_n > 0 OR __close.th = __edge.th)) OR __close.n > 1")
    if repeated.isEmpty():
        return joined.select(*keep, (base + F.when(F.col("__size") == 0, F.lit(0)).otherwise(some)).alias("copies"))
    # Rows of an entry of which some copies are taken are numbered through a stored table: partitions are counted, then rows within one.
    at_end = _is("__edge", F.col(key)) | _is("__close", F.col(key))
    rest = joined.where(~at_end).select(*keep, base.alias("copies"))
    ends = shared.cut(joined.where(at_end).select(*keep, base.alias("__base"), some.alias("__some"), F.xxhash64("__s", own).alias("__e"), F.monotonically_increasing_id().alias("__rid")), f"{at}/ends")
    ends = ends.withColumn("__part", F.shiftright("__rid", 33))
    within = ends.withColumn("__k", F.row_number().over(Window.partitionBy("__e", "__part").orderBy("__rid")))
    before = Window.partitionBy("__e").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.groupBy("__e", "__part").agg(F.count("*").alias("__n")).select("__e", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = within.join(starts, ["__e", "__part"])
    chosen = F.when(F.col("__size") == 0, F.lit(0)).otherwise((F.col("__start") + F.col("__k") <= F.col("__some")).cast("long"))
    return rest.unionByName(numbered.select(*keep, (F.col("__base") + chosen).alias("copies")))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: list[float] = (3, 1, 2), seed: int = 29, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, source_size, target and copies (how many times the mix has the document)."""
    docs = docs.drop("size", "source_size", "target", "copies")
    at = shared.folder(docs.sparkSession, "mix")
    entries = with_entries(docs, seed, source, key, text)
    rows = shared.cut(entries.select(F.col(key).alias("id"), *[F.col(c).alias(c[2:]) for c in ("__s", "__size", "__th", "__w", "__es")]), f"{at}/rows")
    out = taken_copies(entries, decide(rows, share, cap, list(weights), at), key, at)
    return out.select(*docs.columns, F.col("__size").alias("size"), "source_size", "target", "copies")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    at = shared.folder(spark, "mix")
    entries = with_entries(docs, 29, "source", "doc_id", "text").drop("text", "source")
    rows = shared.cut(entries.withColumnRenamed("doc_id", "id").select("id", *[F.col(c).alias(c[2:]) for c in ("__s", "__size", "__th", "__w", "__es")]), f"{at}/rows")
    stored = rows.select(F.col("id").alias("doc_id"), *[F.col(c).alias(f"__{c}") for c in ("s", "size", "th", "w", "es")])
    out = taken_copies(stored, decide(rows, 1.5, 2.0, [3, 1, 2], at), "doc_id", at)
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"))

"""Quality rules: text statistics and cross-document line frequency, in SQL functions only.

Lines are normalised (stripped, lower-cased) and hashed; each host's lines are
counted by distinct documents.  A line in more than ``min_docs`` documents of its
host (and, if a ``max_share`` is given, in more than that share of them) is
boilerplate and goes; a document that keeps less than ``min_left`` of its words is
rejected.

The lists of such lines may be of any size: they stay rows, joined by (host,
line hash) to the documents' line hashes, and what is found comes back to the
documents by (host, hash of the text).  Spark broadcasts either where its stored
size allows and else joins by shuffle with skew splitting.  Where ``clean_text``
is not asked for, no text is shuffled.

Defined cases: null or empty texts have no words and fail the base rule; a null
host is a host of its own; repeated rows count as documents of their own; an
empty table gives no rows; other columns stay (those named as outputs are
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the array has twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))

    def places(h: Column) -> Column:
        def doubled(s: Column) -> Column:
            near = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: near(e, k - 1) | near(e, k + 1)), lambda e: e["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), doubled)

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: let(windows(w), count)).cast("long")


def with_stats(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the statistics and ``__at``, hash and words of each line that is not blank."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACE, " " * len(SPACE)), " ", -1), "")
    arrays = docs.withColumns({"__words": words, "__lines": full_lines(text)})
    return arrays.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__words")),
            "__at": hashed_lines(F.col("__lines")),
        }
    ).drop("__words", "__lines")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(SPACE))))


def full_lines(text: str) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)


def hashed_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))


def row_keys(host: str, text: str) -> dict[str, Column]:
    """Host and hash of the text: rows with both the same have the same lines."""
    return {"__h": F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n")), "__key": F.xxhash64(F.col(text))}


def boilerplate(each: DataFrame, hosts: DataFrame, min_docs: int, max_share: float | None) -> DataFrame:
    """(__h, line): hosts and hashes of the lines above the limits, of a row per document and line."""
    counted = each.groupBy("__h", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    if max_share is not None:
        counted = counted.join(hosts.groupBy("__h").agg(F.count("*").alias("n")), "__h").where(F.col("docs") > max_share * F.col("n"))
    return counted.select("__h", "line")


def quality_rules(docs: DataFrame, min_docs: int = 10, max_share: float | None = None, min_left: float = 0.3, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``kept`` and ``clean_text`` (without boilerplate lines)."""
    docs = docs.drop(*STATS)
    at = shared.folder(docs.sparkSession, "boilerplate")
    keys = docs.select(*[v.alias(k) for k, v in row_keys(host, text).items()], text)
    each = keys.select("__h", "__key", F.explode(F.array_distinct(F.transform(full_lines(text), line_hash))).alias("line"))
    often = shared.cut(boilerplate(each, keys, min_docs, max_share), f"{at}/lines")
    found = shared.cut(each.join(often, ["__h", "line"]).groupBy("__h", "__key").agg(F.collect_set("line").alias("__often")), f"{at}/texts")
    # One plan at every size: a broadcast of few lines would only hide what many cost.
    out = with_stats(docs, text).withColumns(row_keys(host, text)).join(found.hint("merge"), ["__h", "__key"], "left")
    gone = lambda h: F.array_contains(F.col("__often"), h)
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: (F.length(F.btrim(x, F.lit(SPACE))) == 0) | ~gone(line_hash(x)))
    out = out.withColumn("clean_text", F.when(F.col("__often").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n")))
    lost = F.when(F.col("__often").isNull(), F.lit(0)).otherwise(F.aggregate(F.filter("__at", lambda x: gone(x["line"])), F.lit(0), lambda a, x: a + x["n"]))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - lost) >= min_left * F.col("n_words"))).select(*docs.columns, *STATS)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

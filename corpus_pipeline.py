"""The corpus pipeline: five operators, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` stores each stage's result in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import jaccard, linededup, mixing, packing, quality, shared


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``docs`` with another text, and n_chars as it is then."""
    out = docs.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that more than ten documents of their host have.

    A null or empty text fails (fewer than ten words); a null source is a host of its own;
    repeated rows are judged alike, each as a document; an empty table stays empty.
    """
    return _with_text(quality.quality_rules(docs).where("kept"), F.col("clean_text"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a line that five documents share stays in the one of the largest id (null: below all others).

    A null text stays null; rows of one id count as one document and keep the line in all of
    them; an empty table stays empty.
    """
    return _with_text(linededup.dedup_lines(docs), F.col("text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones (five words, similarity 0.8): the smallest id, null last.

    Of rows that repeat an id and a text one stays; null and empty texts are linked with
    nothing.  Columns named ``__row`` and ``__hash`` are refused.
    """
    columns = docs.columns
    if reserved := {"__row", "__hash"} & set(columns):
        raise ValueError(f"reserved column names: {sorted(reserved)}")
    # Ids may be null or repeated: rows go by a number that the stored copy fixes.
    docs = shared.cut(docs.withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.md5(F.col("text").cast("binary"))}), shared.folder(spark, "rows"))
    found = jaccard.similar_documents(docs, 5, 80, 100, key="__row").select(F.col("doc_id").alias("__row"), "component_id")
    rows = shared.cut(found.join(docs.select("__row", "doc_id", "__hash"), "__row"), shared.folder(spark, "groups"))

    def later(keys: list[str]) -> DataFrame:
        """Rows that are not the first of theirs with the same ``keys``."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__row"))
        groups = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.count("*").alias("n"), first["__row"].alias("kept")).where("n > 1")
        same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        return rows.join(groups, same).where("__row <> kept").select("__row")

    # Texts stay where they are: each row looks its number up among those that go.
    gone = shared.row_set(later(["component_id"]).unionByName(later(["doc_id", "__hash"])), shared.folder(spark, "gone"))
    return docs.where(~gone(F.col("__row"))).select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, once for each time it takes them.

    A null source is a source of its own; documents without words are taken no times; of
    identical rows as many are taken as there is room for; an empty table stays empty.  A
    column named ``__copy`` is refused.
    """
    if "__copy" in docs.columns:
        raise ValueError("reserved column name: __copy")
    mixed = mixing.mix(docs)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(*docs.columns, times.alias("__copy")).drop("__copy")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it lies in which sequence.

    A null or empty text is its end id alone; rows of one id, or none, are packed each for itself.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        at = shared.folder(spark, f"pipeline-{name}")
        with shared.scratch(spark):
            docs = shared.cut(stage(spark, docs, sf_dir), at)
        if before is not None:
            shared.remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle components and the packing can't be stated in SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None

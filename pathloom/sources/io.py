"""Scans, sinks and file-system helpers.

A source is a DataFrame, a catalog table name, or a path with the format
``parquet``/``HDFS`` or ``orc``.  Months are filtered on the partition column,
which prunes directories; columns are pruned by later selections.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, table, source: str = "table", time: str | None = None, times: Iterable[str] | None = None) -> DataFrame:
    """Rows of a source, of the given months only."""
    if isinstance(table, DataFrame):
        df = table
    elif source in ("table", "Online", "catalog"):
        df = spark.table(table)
    elif source in ("parquet", "HDFS"):
        df = spark.read.parquet(table)
    elif source == "orc":
        df = spark.read.orc(table)
    else:
        raise ValueError(f"unknown source {source!r}")
    return df if times is None or time is None else df.where(F.col(time).isin(list(times)))


def read_partitions(spark: SparkSession, root: str, times: Iterable[str], time: str = "dt") -> DataFrame:
    """Named partition directories only, with their partition column."""
    return spark.read.option("basePath", root).parquet(*[f"{root.rstrip('/')}/{time}={t}" for t in times])


def project(df: DataFrame, columns: dict[str, str], predicates: Iterable[str] = (), time: str | None = None, at: str | None = None) -> DataFrame:
    """Columns under new names where all SQL predicates hold (and the month is ``at``)."""
    if time is not None and at is not None:
        df = df.where(F.col(time) == at)
    for p in predicates:
        if p:
            df = df.where(F.expr(p))
    return df.select(*[F.col(c).alias(new) for c, new in columns.items()])


def write_parquet(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Overwrite a folder, or only the partitions that ``df`` has.

    Rows of a partition value are spread over tasks by AQE's size target, so a
    large month becomes several files instead of one task's work.
    """
    if partition is None:
        df.write.mode("overwrite").parquet(path)
    else:
        rows = df.hint("rebalance", partition)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, at: str | None = None) -> None:
    """A Parquet table bucketed and sorted by ``keys``, one file a bucket: joins and sums by them read it without an exchange.

    ``at``: the folder of an external table.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", at) if at else writer).saveAsTable(name)


def create_orc_table(spark: SparkSession, name: str, columns: dict[str, str], comments: dict[str, str] | None = None, partition: str = "dt", at: str | None = None) -> None:
    """An ORC table partitioned by a string column, if there is none of the name; ``at``: the folder of an external one."""
    note = lambda c: f" COMMENT '{comments[c]}'".replace("\\", "") if comments and c in comments else ""
    cols = ", ".join(f"`{c}` {t}{note(c)}" for c, t in columns.items() if c != partition)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, `{partition}` string) USING orc PARTITIONED BY (`{partition}`)" + (f" LOCATION '{at}'" if at else ""))


def insert_partition(df: DataFrame, name: str, at: str, partition: str = "dt") -> None:
    """Overwrite one partition of a table with ``df``, columns by the table's order."""
    spark = df.sparkSession
    order = [c for c in spark.table(name).columns if c != partition]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*order, F.lit(at).alias(partition)).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


class Store:
    """Files of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def mkdir(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only where that is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(root)
    _made[-1].append(f"{root.rstrip('/')}/pathloom/stored-{uuid.uuid4().hex}")
    return _made[-1][-1]


_made: list[list[str]] = [[]]


def _forget(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        store = Store(spark, folders.pop())
        store._fs.delete(store._at(""), True)


def forget_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in the innermost ``scratch`` (outside of all: in none) so far."""
    _forget(spark, _made[-1])


@contextmanager
def scratch(spark: SparkSession):
    """What ``stored`` writes inside is deleted at the end: for work whose result has been written or shown by then."""
    _made.append([])
    try:
        yield
    finally:
        _forget(spark, _made.pop())


@contextmanager
def tidy(spark: SparkSession):
    """The shuffle files of what runs inside are deleted when it has run, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: what several later steps use is made once."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(spark: SparkSession, table, source: str = "table") -> bool:
    """Whether a source is a table in buckets, which a join by them reads as they lie."""
    return isinstance(table, str) and source in ("table", "Online", "catalog") and any(c.isBucket for c in spark.catalog.listColumns(table))


#: Bytes of files whose rows one task takes up where a hop joins and sums edges: in memory, with every sort and
#: map of such a stage, these become some fifty times as many.
PART_BYTES = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """The bytes of the files that a plan reads, from a listing of their folders; 0 for rows that lie in none."""
    jvm, folders = df.sparkSession.sparkContext._jvm, {}
    for f in df.inputFiles():
        folder, name = f.rsplit("/", 1)
        folders.setdefault(folder, set()).add(name)
    total = 0
    for folder, names in folders.items():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder + "/"))
        for s in at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
            total += s.getLen() if s.getPath().toUri().getRawPath().rsplit("/", 1)[1] in names else 0
    return total


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt by its keys into parts that grow in number with its files, not in size.

    AQE alone joins parts until a task reads 64 MB of compressed rows, whatever these become in
    memory.  Inputs of fewer parts than cores are left to it.
    """
    n = -(-input_bytes(df) // PART_BYTES)
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


class Checkpoint:
    """Named results that a later run takes up again.

    A result's manifest is written after its data, so an interrupted write is
    done again; the manifest holds what the result was made of, and another
    making is not taken for it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def done(self, name: str, made_of: dict | None = None) -> bool:
        if not self.store.exists(f"{name}/manifest.json"):
            return False
        return json.loads(self.store.read_text(f"{name}/manifest.json")).get("made_of") == made_of

    def get(self, name: str, make, made_of: dict | None = None) -> DataFrame:
        data = f"{self.store.root}/{name}/data"
        if not self.done(name, made_of):
            df = make()
            write_parquet(df, data)
            self.store.write_text(f"{name}/manifest.json", json.dumps({"made_of": made_of, "columns": df.columns}))
        return self.spark.read.parquet(data)

    def names(self) -> list[str]:
        return [n for n in self.store.list() if self.store.exists(f"{n}/manifest.json")]


class MonthlyCheckpoint(Checkpoint):
    """Named results by month, of which a later run makes the missing months only.

    Results are partitioned by the month; a result's manifest holds the months that are done (also
    those without rows) and what it was made of, and is written after the data.  ``made`` has the months that this object made, by name.
    """

    def __init__(self, spark: SparkSession, root: str, time: str = "Feature_Time"):
        super().__init__(spark, root)
        self.time = time
        self.made: dict[str, list[str]] = {}

    def months(self, name: str, made_of: dict | None = None) -> list[str]:
        """The months of a result that are done."""
        if not self.store.exists(f"{name}/manifest.json"):
            return []
        kept = json.loads(self.store.read_text(f"{name}/manifest.json"))
        return kept["months"] if kept["made_of"] == made_of else []

    def get(self, name: str, make, made_of: dict | None = None) -> DataFrame:
        """The result of the months in ``made_of["times"]``; ``make`` takes those that are missing."""
        wanted = (made_of or {}).get("times")
        if wanted is None:
            raise ValueError("results by month need the months")
        of = {k: v for k, v in made_of.items() if k != "times"}
        done, data = self.months(name, of), f"{self.store.root}/{name}/data"
        missing = [t for t in wanted if t not in done]
        if missing or not self.store.exists(f"{name}/manifest.json"):
            df = make(missing)
            self.store.mkdir(f"{name}/data")
            if not done:
                df.write.mode("overwrite").partitionBy(self.time).parquet(data)
            else:
                write_parquet(df, data, self.time)
            note = {"made_of": of, "months": sorted({*done, *missing}), "schema": df.schema.json()}
            self.store.write_text(f"{name}/manifest.json", json.dumps(note))
            self.made[name] = missing
        schema = T.StructType.fromJson(json.loads(json.loads(self.store.read_text(f"{name}/manifest.json"))["schema"]))
        return self.spark.read.schema(schema).parquet(data).where(F.col(self.time).isin(list(wanted))).select(*schema.names)

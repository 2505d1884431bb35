"""Folders and files that driver and executors share.

The place is the session's ``spark.checkpoint.dir``; only where that is unset and
the session runs on one machine (tests) a local folder stands in.  Executors write
whole files under a temporary name and rename them, so a lost or repeated task
leaves one complete file.  Files are memory-mapped where the folder is mounted; of
any other store a file, or the asked part of it, is read into memory.  A worker
keeps the files that it used last, up to a number and a size.
"""

from __future__ import annotations

import ctypes
import gc
import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder of its own in the shared folder."""
    at = f"{root(spark)}/pathloom/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    made = store.makeQualified(path).toString()  # with the scheme that workers go by
    if _scopes:
        _scopes[-1].append(made)
    return made


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at its end: for work whose result has been stored elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, *_scopes.pop())


def remove(spark: SparkSession, *uris: str) -> None:
    """Delete folders that no later read needs."""
    for at in uris:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, at: str) -> DataFrame:
    """Write ``df`` as Parquet at ``at`` and read it back: its lineage ends there."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def local_path(uri: str) -> str | None:
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def put(uri: str, parts: list) -> int:
    """Write the buffers ``parts`` as one file; returns its length."""
    own = f"{uri}.{uuid.uuid4().hex}.part"
    n = 0
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(own), "wb") as f:
            for p in parts:
                n += f.write(memoryview(p).cast("B") if len(p) else b"")
        os.replace(local_path(own), path)
        return n
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    own_path = own[len(uri) - len(path) :]
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(own_path) as f:
        for p in parts:
            n += f.write(memoryview(p).cast("B") if len(p) else b"")
    store.move(own_path, path)
    return n


_maps: OrderedDict[str, memoryview] = OrderedDict()
MOST_FILES, MOST_BYTES_READ = 256, 256 << 20


def view(uri: str) -> memoryview:
    """The bytes of a shared file: mapped where it is mounted, else read."""
    if uri in _maps:
        _maps.move_to_end(uri)
        return _maps[uri]
    if (path := local_path(uri)) is not None:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            got = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)) if size else memoryview(b"")
    else:
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(there) as s:
            got = memoryview(s.read())
        while _maps and len(got) + sum(map(len, _maps.values())) > MOST_BYTES_READ:
            _maps.popitem(last=False)
    while len(_maps) >= MOST_FILES:
        _maps.popitem(last=False)
    _maps[uri] = got
    return got


def release() -> None:
    """Forget the worker's files: for tasks that open none and need the memory; files of deleted folders go with them."""
    _maps.clear()


#: What empties the worker's caches of other kinds.
caches: list = []


def forget() -> None:
    """Forget the worker's files and caches and give the memory back: for tasks that use neither."""
    release()
    for clear in caches:
        clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only this C library keeps freed memory


def exists(uri: str) -> bool:
    """Whether a shared file is there."""
    if uri in _maps:
        return True
    if (path := local_path(uri)) is not None:
        return os.path.exists(path)
    from pyarrow import fs

    store, there = fs.FileSystem.from_uri(uri)
    return store.get_file_info(there).type == fs.FileType.File


def piece(uri: str, at: int, size: int) -> memoryview:
    """``size`` bytes of a shared file from ``at``; of a file that is not mounted only these are read."""
    if uri in _maps or local_path(uri) is not None:
        return view(uri)[at : at + size]
    from pyarrow import fs

    store, there = fs.FileSystem.from_uri(uri)
    with store.open_input_file(there) as f:
        return memoryview(f.read_at(size, at))


def column(uri: str, kind: str) -> np.ndarray:
    """A shared file as an array."""
    return np.frombuffer(view(uri), kind)


def row_set(rows: DataFrame, at: str):
    """A function of a long column: whether it is among the one-column ``rows`` (null: no).

    Both hold numbers of ``monotonically_increasing_id`` over one stored table.  The
    set is stored as a sorted array per partition of that table, so a task that reads
    some of its files opens the arrays of these alone.
    """
    part = lambda c: F.shiftright(c, 33)

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["part"].iloc[0])
        put(f"{at}/rows-{k:06d}", [np.unique(pdf["id"].to_numpy(np.int64)).tobytes()])
        return pd.DataFrame({"part": [k], "n": [len(pdf)]})

    ids = rows.toDF("id").where("id is not null")
    stored = cut(ids.withColumn("part", part(F.col("id"))).groupBy("part").applyInPandas(store, "part long, n long"), f"{at}/parts")
    have = {r.part for r in stored.select("part").collect()}  # at most a number per partition

    @F.pandas_udf("boolean")
    def member(x: pd.Series) -> pd.Series:
        own = x.to_numpy(np.int64)
        hit, parts = np.zeros(len(own), bool), own >> 33
        for k in set(parts.tolist()) & have:
            at_k = np.flatnonzero(parts == k)
            known = column(f"{at}/rows-{k:06d}", "i8")
            i = np.minimum(np.searchsorted(known, own[at_k]), len(known) - 1)
            hit[at_k] = known[i] == own[at_k]
        return pd.Series(hit)

    # Without nulls, since pandas would hold a batch with one as floating-point numbers.
    return lambda x: x.isNotNull() & member(F.coalesce(x, F.lit(-1)).cast("long"))

"""Shared files and sets of ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import shared


def test_row_set(spark):
    big = 5 << 33
    ids = spark.createDataFrame([(big + 1,), (0,), (5,), (5,), (None,), (40,)], "x long")
    member = shared.row_set(ids, shared.folder(spark, "test"))
    df = spark.createDataFrame([(big,), (big + 1,), (None,), (0,), (6,), (40,), (7 << 33,)], "x long").coalesce(1)
    got = {r.x: r.m for r in df.withColumn("m", member(F.col("x"))).collect()}
    assert got == {big: False, big + 1: True, None: False, 0: True, 6: False, 40: True, 7 << 33: False}
    none = shared.row_set(ids.where("x > 100 AND x < 200"), shared.folder(spark, "test"))
    assert df.where(none(F.col("x"))).count() == 0


def test_scratch_folders_go(spark):
    kept = shared.folder(spark, "test")
    with shared.scratch(spark):
        gone = shared.folder(spark, "test")
        shared.put(f"{gone}/a", [b"x"])
    assert shared.exists(kept.replace("file:", "") + "/none") is False
    import os

    assert os.path.isdir(shared.local_path(kept)) and not os.path.exists(shared.local_path(gone))


def test_files(spark):
    at = shared.folder(spark, "test")
    assert shared.put(f"{at}/a/b", [np.arange(3).tobytes(), b"", b"12345678"]) == 32
    assert shared.column(f"{at}/a/b", "i8")[:3].tolist() == [0, 1, 2]
    shared.put(f"{at}/none", [])
    assert len(shared.view(f"{at}/none")) == 0
    with pytest.raises(FileNotFoundError):
        shared.view(f"{at}/missing")
    shared.remove(spark, at)
    with pytest.raises(FileNotFoundError):
        open(shared.local_path(f"{at}/a/b"))

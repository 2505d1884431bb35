"""Feature vectors as ``array<double>`` columns (and ML vectors at the edges)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_vector(text: Column) -> Column:
    """``"(n,[i,..],[v,..])"`` or ``"[v,..]"`` as an array; anything else is null."""
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))
    sparse = r"^\s*\((\d+),\s*\[([^\]]*)\],\s*\[([^\]]*)\]\)\s*$"
    size, at, values = (F.regexp_extract(text, sparse, k) for k in (1, 2, 3))
    entries = F.map_from_arrays(F.transform(numbers(at), lambda x: x.cast("int")), numbers(values))
    spread = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.coalesce(F.element_at(entries, i.cast("int")), F.lit(0.0)))
    empty = F.array().cast("array<double>")
    return F.when(text.rlike(sparse), F.when(size.cast("int") > 0, spread).otherwise(empty)).when(text.rlike(r"^\s*\[[^\]]*\]\s*$"), numbers(text))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def fill_null(column: str, n: int) -> Column:
    """The vector, or ``n`` zeros where it is null."""
    return F.coalesce(F.col(column), zeros(n)).alias(column)


def merge_vectors(tables: Sequence[DataFrame], keys: Sequence[str], column: str, widths: Sequence[int]) -> DataFrame:
    """Full outer join of vector tables, missing vectors as zeros, concatenated in order."""
    out = tables[0].withColumnRenamed(column, "__v0")
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumnRenamed(column, f"__v{i}"), list(keys), "outer")
    return out.select(*keys, F.concat(*[F.coalesce(F.col(f"__v{i}"), zeros(n)) for i, n in enumerate(widths)]).alias(column))


def left_join_vectors(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Left join; vectors of unmatched rows are zeros."""
    out = left.join(right.select(*keys, *columns), list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), zeros(n)) for c, n in zip(columns, widths)})

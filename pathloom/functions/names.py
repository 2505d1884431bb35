"""Column names and types."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: characters outside this set become "_".
_ODD = re.compile("[^一-龥a-zA-Z0-9_]")


def sanitize(df: DataFrame) -> DataFrame:
    """Replace odd characters of column names; names that would coincide raise."""
    names = [_ODD.sub("_", c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"column names coincide: {names}")
    return df.toDF(*names)


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns, in order."""
    gone = set(without)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in gone]


def comments(df: DataFrame) -> dict[str, str]:
    """Column comments carried in the schema (the name where there is none)."""
    return {f.name: f.metadata.get("comment", f.name) for f in df.schema}


def shortened(names: list[str], most: int = 128) -> dict[str, str]:
    """Long names to ``Feature_Column_{i}``; coinciding results raise."""
    out = {n: n if len(n) <= most else f"Feature_Column_{i}" for i, n in enumerate(names)}
    if len(set(out.values())) < len(out):
        raise ValueError("shortened names coincide")
    return out


def suffixed(columns: Iterable[str], table: str, boilerplate: Iterable[str] = ()) -> dict[str, str]:
    """``{column}___{table}`` in lower case, the boilerplate parts of the table's name left out."""
    for b in boilerplate:
        table = table.replace(b, "")
    return {c: f"{c}___{table}".lower() for c in columns}


def positional(tables: list[list[str]]) -> list[dict[str, str]]:
    """``Feature_{n}`` numbered through all tables."""
    n, out = 0, []
    for cols in tables:
        out.append({c: f"Feature_{n + k}" for k, c in enumerate(cols)})
        n += len(cols)
    return out

"""The operators as functions from DataFrames to DataFrames; Catalyst chooses how they run.

scan and range_scan read, where and project shape rows, join combines, aggregate and distinct group, sort and limit order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.expressions import sort_key

#: Aggregates by name; count_star takes no argument.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
JOINS = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of a Parquet table; with columns, those in that order (repeats allowed)."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def range_scan(spark: SparkSession, path: str, column: str, low: Any = None, high: Any = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with low <= column <= high (an end that is None is open); row groups out of range are skipped, nulls never pass."""
    df = spark.read.parquet(path)
    df = df.filter(F.col(column).isNotNull())
    if low is not None:
        df = df.filter(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.filter(F.col(column) <= F.lit(high))
    return df if columns is None else df.select(*columns)


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true (neither false nor null)."""
    return df.filter(predicate)


def project(df: DataFrame, items: Mapping[str, Column | str] | Sequence[str]) -> DataFrame:
    """Columns by name and order, or expressions by their output name."""
    if isinstance(items, Mapping):
        return df.select(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in items.items()))
    return df.select(*items)


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Column, kind: str = "inner") -> DataFrame:
    """Left columns, then right ones (semi and anti: left only). Null keys match nothing; anti keeps rows with null keys.

    `on` is a list of (left column, right column) equalities, or any condition. Which side is built or broadcast is left
    to the sizes that Spark knows.
    """
    if not isinstance(on, Column):
        if not on:
            raise ValueError("a join needs a key or a condition")
        condition = None
        for a, b in on:
            same = left[a] == right[b]
            condition = same if condition is None else condition & same
        on = condition
    return left.join(right, on, JOINS[kind])


def aggregate(df: DataFrame, keys: Sequence[str | Column], aggs: Mapping[str, tuple[str, str | Column | None]]) -> DataFrame:
    """Keys, then aggregates by output name as (function, argument); ("count", None) counts rows.

    Nulls form one group. Without keys there is one row, even for no input. Sums of whole numbers are 64 bits wide.
    """
    columns = []
    for name, (function, argument) in aggs.items():
        if argument is None:
            if function != "count":
                raise ValueError(f"{function} needs an argument")
            columns.append(F.count(F.lit(1)).alias(name))
        else:
            columns.append(AGGREGATES[function](argument).alias(name))
    if not columns:
        return distinct(df.select(*keys))
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, keys: Sequence[str | Column | tuple]) -> DataFrame:
    """Keys are columns or (column, descending[, nulls first]); nulls last by default, in both directions."""
    out = []
    for key in keys:
        value, *rest = key if isinstance(key, tuple) else (key,)
        out.append(sort_key(F.col(value) if isinstance(value, str) else value, *rest))
    return df.orderBy(*out)


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if n is None else df.limit(n)

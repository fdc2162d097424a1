"""The dialect's types and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

#: The seven types, and two that only expressions have: PRED (a condition) and NULL.
SPARK = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType()}
NUMBERS = ("INT", "BIGINT", "DOUBLE")
INT_RANGE, BIGINT_RANGE = 1 << 31, 1 << 63


def of_spark(kind: T.DataType) -> str:
    """The dialect's type of a Spark column; narrower numbers count as the next wider type, others as themselves."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INT"
    if isinstance(kind, T.LongType):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "VARCHAR"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, T.DateType):
        return "DATE"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return kind.simpleString().upper()


def of_int(value: int) -> str:
    return "INT" if -INT_RANGE <= value < INT_RANGE else "BIGINT"


def wider(a: str, b: str) -> str:
    return max(a, b, key=NUMBERS.index)

"""Expression helpers: integer division, truth of numbers, predicates as numbers, null ordering, typed literals."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_TIMESTAMP = re.compile(r"(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})(\.\d{1,6})?")


def int_div(a: Column, b: Column, wide: bool = False) -> Column:
    """Division of whole numbers, cut toward zero; an error on zero. `wide`: 64 bits, else 32."""
    return F.call_function("div", a, b).cast("bigint" if wide else "int")


def truthy(value: Column) -> Column:
    """A number as a condition: not zero."""
    return value != 0


def as_number(predicate: Column) -> Column:
    """A predicate as it is projected: 1, 0 or null."""
    return predicate.cast("int")


def sort_key(value: Column, descending: bool = False, nulls_first: bool = False) -> Column:
    """Nulls come last in either direction, unless asked for first."""
    if descending:
        return value.desc_nulls_first() if nulls_first else value.desc_nulls_last()
    return value.asc_nulls_first() if nulls_first else value.asc_nulls_last()


def date_literal(text: str) -> Column:
    return F.lit(parse_date(text))


def timestamp_literal(text: str) -> Column:
    return F.lit(parse_timestamp(text).isoformat(sep=" ")).cast("timestamp_ntz")


def parse_date(text: str) -> dt.date:
    if not _DATE.fullmatch(text):
        raise ValueError(f"invalid DATE '{text}'")
    return dt.date.fromisoformat(text)


def parse_timestamp(text: str) -> dt.datetime:
    if not (m := _TIMESTAMP.fullmatch(text)):
        raise ValueError(f"invalid TIMESTAMP '{text}'")
    return dt.datetime.fromisoformat(f"{m[1]} {m[2]}{(m[3] or '').ljust(7, '0') if m[3] else ''}")

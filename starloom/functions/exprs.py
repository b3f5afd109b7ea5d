"""Time buckets, null defaults and hashes, all inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.plans.model import TimeUnit, spark_type

#: Stands for an unknown time: the described default '00-00-00 00:00:00' is no valid time here.
UNKNOWN_TIME = "0001-01-01 00:00:00"


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ, whatever the session's time zone; floors."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def zoned_epoch_seconds(ts: Column) -> Column:
    """The same for a TIMESTAMP, which is a point in time."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("bigint")


def time_bucket(ts: Column, unit: TimeUnit, data_type: T.DataType | None = None) -> Column:
    """Bucket number floor(epoch / unit) as bigint; null stays null."""
    seconds = zoned_epoch_seconds(ts) if isinstance(data_type, T.TimestampType) else epoch_seconds(ts)
    return F.floor(seconds / F.lit(unit.value)).cast("bigint")


def time_literal(value) -> Column:
    """A bound as TIMESTAMP_NTZ. Goes through text: a Python datetime would shift with the zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def in_window(ts: Column, end, start=None) -> Column:
    """``start <= ts < end``; without a start only the upper bound."""
    condition = ts < time_literal(end)
    return condition if start is None else (ts >= time_literal(start)) & condition


def default_text(text: str, type_text: str) -> str:
    """The value in a described default, SQL text such as ``'x'::uuid`` or ``-1``."""
    body = re.sub(r"::[\w ]+$", "", text.strip())
    quoted = re.fullmatch(r"'((?:[^']|'')*)'", body)
    value = quoted[1].replace("''", "'") if quoted else body
    if isinstance(spark_type(type_text), (T.TimestampNTZType, T.TimestampType, T.DateType)):
        if not re.match(r"\d{4}-\d\d-\d\d", value) or value.startswith("0000"):
            return UNKNOWN_TIME
    return value


def default_literal(text: str, type_text: str) -> Column:
    """The described default, cast to the column's type."""
    return F.lit(default_text(text, type_text)).cast(spark_type(type_text))


def default_sql(text: str, type_text: str) -> str:
    """The same as Spark SQL text."""
    value = default_text(text, type_text).replace("\\", "\\\\").replace("'", "\\'")
    return f"cast('{value}' as {spark_type(type_text).simpleString()})"


def with_default(column: Column, type_text: str, nullable: bool, default: str | None) -> Column:
    """Null becomes the default, but only where the column is declared nullable."""
    if not nullable:
        return column
    if default is None:
        raise ValueError(f"no default for type {type_text}")
    return F.coalesce(column, default_literal(default, type_text))


def any_not_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in columns])


def all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in pairs])


def text_hash32(value: Column) -> Column:
    """Hash of the value as text, 0 .. 2**32-1: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def text_hash60(value: Column) -> Column:
    """The first fifteen hex digits of the MD5 of the value as text, 0 .. 2**60-1."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def row_hash(columns: list[Column], seed: int = 0) -> Column:
    """64-bit hash of whole rows. Nulls count by position: (null, x) differs from (x, null)."""
    mask = reduce(lambda a, b: a + b, [F.when(c.isNull(), F.lit(1 << (i % 62))).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(columns)])
    return F.xxhash64(F.lit(seed), mask, *columns)

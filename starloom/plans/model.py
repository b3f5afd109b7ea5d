"""Data model of a star-schema description.

Types are kept as text: the engine looks at them only to find null defaults, to map
serial ids to plain integers and to choose a Spark type (``spark_type``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    """A described column; ``nullable`` is the declared flag, which parquet reads lose."""

    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class PrimaryKey:
    column: str


@dataclass(frozen=True)
class UniqueKey:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` pairs each local column with the column it refers to in ``table``."""

    table: str
    columns: tuple[tuple[str, str], ...]


Constraint = PrimaryKey | UniqueKey | ForeignKey


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def primary_key(self) -> str | None:
        return next((c.column for c in self.constraints if isinstance(c, PrimaryKey)), None)

    def foreign_keys(self) -> list[ForeignKey]:
        return [c for c in self.constraints if isinstance(c, ForeignKey)]


class TimeUnit(Enum):
    """Bucket sizes in seconds, counted from 1970-01-01; a week starts on a Thursday."""

    SECOND = 1
    MINUTE = 60
    HOUR = 3600
    DAY = 86400
    WEEK = 604800

    @property
    def label(self) -> str:
        return self.name.lower()


class Mode(Enum):
    FULL = "full"
    INCREMENTAL = "incremental"


# --- fact columns -------------------------------------------------------------------


@dataclass(frozen=True)
class FactColumn:
    """Base of the eleven kinds; ``column`` names the target column."""

    column: str

    @property
    def source(self) -> str | None:
        """The source-table column that is read, if any."""
        return self.column


@dataclass(frozen=True)
class DimTime(FactColumn):
    """Event time, stored as a bucket number."""


@dataclass(frozen=True)
class NoDimId(FactColumn):
    """A plain grouping key without a dimension table."""


@dataclass(frozen=True)
class TenantId(FactColumn):
    """A plain grouping key that also leads the composite index."""


@dataclass(frozen=True)
class DimId(FactColumn):
    """A foreign key into an existing table."""

    table: str = ""


@dataclass(frozen=True)
class DimVal(FactColumn):
    """A value that goes into the derived dimension ``table``."""

    table: str = ""


@dataclass(frozen=True)
class Measure(FactColumn):
    source_column: str | None = None

    @property
    def source(self) -> str | None:
        return self.source_column


class FactCount(Measure):
    """Row count, or count of non-null values of the source column."""


class FactCountDistinct(Measure):
    """Distinct-count sketch over the source column or the primary key."""


class FactSum(Measure):
    pass


class FactAverage(Measure):
    """Kept as a count and a sum, so that it can be aggregated again."""


class FactMax(Measure):
    pass


class FactMin(Measure):
    pass


KEY_KINDS = (NoDimId, TenantId)


@dataclass(frozen=True)
class Fact:
    name: str
    table: str
    columns: tuple[FactColumn, ...]
    persistent: bool = True
    parents: tuple[str, ...] = ()

    def of_kind(self, *kinds: type) -> list[FactColumn]:
        return [c for c in self.columns if isinstance(c, kinds)]

    def time_column(self) -> str:
        """The first time column bounds every load."""
        return self.of_kind(DimTime)[0].column


@dataclass(frozen=True)
class Settings:
    dim_prefix: str = "dim_"
    fact_prefix: str = "fact_"
    time_unit: TimeUnit = TimeUnit.MINUTE
    avg_count_suffix: str = "_count"
    avg_sum_suffix: str = "_sum"
    dim_id_column: str = "id"
    dim_id_type: str = "serial"
    count_type: str = "integer"
    distinct_error_rate: float = 0.05
    fact_infix: str = "_by_"
    dependencies_file: str = "dependencies.json"
    facts_file: str = "facts.json"
    dimensions_file: str = "dimensions.json"
    missing_id: int = -1
    suffix_template: str = "{{suff}}"


@dataclass(frozen=True)
class Env:
    """A description that passed validation; made by ``starloom.plans.validate.make_env``."""

    tables: tuple[Table, ...]
    facts: tuple[Fact, ...]
    settings: Settings = field(default_factory=Settings)
    defaults: tuple[tuple[str, str], ...] = ()

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)

    def fact(self, name: str) -> Fact | None:
        return next((f for f in self.facts if f.name == name), None)

    def default_for(self, type_text: str) -> str | None:
        """Default literal of the first key, in key order, that the type starts with."""
        return default_for(dict(self.defaults), type_text)


def default_for(defaults: dict[str, str], type_text: str) -> str | None:
    return next((defaults[k] for k in sorted(defaults) if type_text.startswith(k)), None)


# Type text (lower case, without length) -> Spark type.
_PLAIN_TYPES = {
    "bigint": T.LongType(),
    "bigserial": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "double precision": T.DoubleType(),
    "integer": T.IntegerType(),
    "json": T.StringType(),
    "real": T.FloatType(),
    "serial": T.IntegerType(),
    "smallint": T.ShortType(),
    "smallserial": T.ShortType(),
    "text": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp with time zone": T.TimestampType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "uuid": T.StringType(),
}


def spark_type(type_text: str) -> T.DataType:
    """Spark type of a described type; unknown text becomes a string."""
    text = type_text.strip().lower()
    if text in _PLAIN_TYPES:
        return _PLAIN_TYPES[text]
    if m := re.fullmatch(r"(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if text in ("numeric", "decimal"):
        return T.DecimalType(38, 10)
    return T.StringType()


def spark_schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c.type), c.nullable) for c in table.columns])

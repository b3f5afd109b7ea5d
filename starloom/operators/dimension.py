"""Loading of derived dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.exprs import all_equal, any_not_null, in_window, with_default
from starloom.plans import derive
from starloom.plans import model as m
from starloom.sources.shared import staged

#: Rows of a dimension that one task numbers; more are numbered range by range.
ONE_TASK = 2_000_000

Tables = Callable[[str], DataFrame]


def defaulted(env: m.Env, table: m.Table, column: str, ref=None):
    """A described column with its null default; ``ref`` is the DataFrame column to read."""
    c = table.column(column)
    return with_default(F.col(column) if ref is None else ref, c.type, c.nullable, env.default_for(c.type))


def dimension_values(env: m.Env, fact: m.Fact, dim: str, source: DataFrame, end, start=None) -> DataFrame:
    """Distinct, null-defaulted values of a dimension among the source rows of the window.

    Rows whose dimension columns are all null give no value: the fact stores the missing id.
    """
    table = env.table(fact.table)
    columns = derive.new_dimension_columns(fact)[dim]
    rows = source.filter(in_window(F.col(fact.time_column()), end, start)).filter(any_not_null([F.col(c) for c in columns]))
    named = [defaulted(env, table, c).alias(derive.dim_column_name(dim, c)) for c in columns]
    return rows.select(*named).distinct()


def assign_ids(values: DataFrame, id_column: str, after: Column | None = None) -> DataFrame:
    """Ids in the order of all columns, counted from 1 or from behind ``after`` (a scalar subquery or a
    literal). The order, and so the id, doesn't depend on partitioning.

    The numbering runs in one task: see ``with_ids``.
    """
    columns = values.columns
    number = F.row_number().over(W.orderBy(*columns))
    return values.select((number if after is None else number + after).cast("int").alias(id_column), *columns)


def assign_ids_ranged(
    values: DataFrame, id_column: str, staged: Callable[[DataFrame], DataFrame], after: Column | None = None
) -> DataFrame:
    """The same ids as ``assign_ids`` for dimensions too large for one task.

    Rows are range-partitioned and staged with their partition number, so that ranges stay as
    they are; each range is numbered on its own behind the rows of the ranges before it.
    """
    columns = values.columns
    ranged = staged(values.repartitionByRange(*columns).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))  # one row for each partition
    number = F.row_number().over(W.partitionBy("__range").orderBy(*columns))
    rows = ranged.withColumn("__number", number).join(F.broadcast(offsets), "__range")
    id_value = F.col("__number") + F.col("__before")
    return rows.select((id_value if after is None else id_value + after).cast("int").alias(id_column), *columns)


def with_ids(values: DataFrame, id_column: str, after: Column | None = None, one_task: int | None = None) -> DataFrame:
    """``values`` with ids, numbered in one task if their counted number is within ONE_TASK, else range by range.
    Both give the same ids."""
    values = staged(values, "dimension")
    limit = ONE_TASK if one_task is None else one_task
    if values.limit(limit + 1).count() > limit:
        return assign_ids_ranged(values, id_column, staged, after)
    return assign_ids(values, id_column, after)


def dimension_full(env: m.Env, fact: m.Fact, dim: str, source: DataFrame, end) -> DataFrame:
    """All values up to ``end``, with ids."""
    return with_ids(dimension_values(env, fact, dim, source, end), env.settings.dim_id_column)


def dimension_increment(env: m.Env, fact: m.Fact, dim: str, source: DataFrame, existing: DataFrame, end, start) -> DataFrame:
    """Values of the window that ``existing`` doesn't hold, with ids behind its largest one."""
    id_column = env.settings.dim_id_column
    values = dimension_values(env, fact, dim, source, end, start)
    known = existing.select(*[F.col(c).alias(f"__known_{c}") for c in values.columns])
    new = values.join(known, all_equal([(F.col(c), F.col(f"__known_{c}")) for c in values.columns]), "left_anti")
    return with_ids(new, id_column, existing.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar())

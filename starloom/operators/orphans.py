"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    target: DataFrame,
    pairs: list[tuple[str, str]],
    match: str = "simple",
    unknown: dict[str, list] | None = None,
) -> DataFrame:
    """Rows of ``refs`` whose reference, ``pairs`` of (column, column of target), breaks the declared rule.

    References are grouped by which of their columns are null, and each group is anti-joined with
    the target on the columns that are not. The mask of nulls is part of the join key and the target is laid out once
    for each mask, so that both sides are read once and joined once:

    * simple: a reference with any null is satisfied,
    * partial: a reference is satisfied if some target row agrees in the columns that are not null,
    * full: a reference is satisfied if all its columns are null, broken if only some are.

    A reference that is null altogether is satisfied under every rule. Values in ``unknown`` (for
    instance -1) count as null. Nulls on the target's side match nothing. Rows of ``refs`` come
    back as they are, repeats included; the target's columns never clash, since only its key
    columns are used, under names of their own. All columns but those keep any name.
    """
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}")
    unknown = unknown or {}

    def missing(c: str) -> Column:
        listed = unknown.get(c)
        return F.col(c).isNull() | F.col(c).isin(listed) if listed else F.col(c).isNull()

    every = (1 << len(pairs)) - 1
    mask = reduce(lambda a, b: a + b, [F.when(missing(c), 1 << i).otherwise(0) for i, (c, _) in enumerate(pairs)])
    rows = refs.withColumn("__mask", mask).filter("__mask = 0" if match == "simple" else f"__mask <> {every}")
    # under the full rule nothing answers a reference with some nulls: it is broken
    masks = range(every) if match == "partial" else [0]
    laid = target.select(F.explode(F.array(*map(F.lit, masks))).alias("__tm"), *[F.col(t).alias(f"__target_{i}") for i, (_, t) in enumerate(pairs)])
    for i in range(len(pairs)):
        masked = F.col("__tm").bitwiseAND(F.lit(1 << i)) > 0
        laid = laid.filter(masked | F.col(f"__target_{i}").isNotNull()).withColumn(f"__target_{i}", F.when(~masked, F.col(f"__target_{i}")))
    on = F.col("__mask") == F.col("__tm")
    for i, (c, _) in enumerate(pairs):
        on = on & F.when(~missing(c), F.col(c)).eqNullSafe(F.col(f"__target_{i}"))
    return rows.join(laid, on, "left_anti").drop("__mask")


def dimension_orphans(
    facts: DataFrame, dims: dict[str, tuple[str, DataFrame]], carry: list[str], missing_id: int = -1
) -> DataFrame:
    """``dim_table, missing_id`` and the ``carry`` columns, each combination once.

    ``dims`` maps a dimension's name to (fact column, dimension). The missing-value id counts as null. A reference is
    the composite key of dimension and id, so the facts are read once and joined once.
    """
    kinds = {facts.schema[c].dataType for c, _ in dims.values()}
    kind = kinds.pop() if len(kinds) == 1 else "bigint"
    one = [F.struct(F.lit(n).alias("dim_table"), F.col(c).cast(kind).alias("missing_id")) for n, (c, _) in dims.items()]
    refs = facts.select(F.explode(F.array(*one)).alias("__ref"), *carry).select("__ref.*", *carry).filter("missing_id is not null").distinct()
    rows = [d.select(F.lit(n).alias("__dim"), F.col("id").cast(kind).alias("__id")) for n, (_, d) in dims.items()]
    target = reduce(lambda a, b: a.unionByName(b), rows)
    return orphan_references(refs, target, [("dim_table", "__dim"), ("missing_id", "__id")], unknown={"missing_id": [missing_id]})


def orphan_counts(orphans: DataFrame, period: Column, changes: DataFrame | None = None) -> DataFrame:
    """``dim_table, period_id, known_as, n_references, n_missing_ids`` from ``dimension_orphans``.

    ``changes`` (``dim_table, dim_id, change, noted_at``) tells what became of a missing row: its
    newest note counts, of several at one instant the alphabetically last. Without a note: unknown.
    """
    rows = orphans.withColumn("period_id", period)
    if changes is not None:
        note = F.max(F.struct("noted_at", "change")).alias("note")
        notes = changes.groupBy(F.col("dim_table").alias("__t"), F.col("dim_id").alias("__i")).agg(note)
        rows = rows.join(notes, (F.col("dim_table") == F.col("__t")) & (F.col("missing_id") == F.col("__i")), "left")
        rows = rows.withColumn("known_as", F.coalesce(F.col("note.change"), F.lit("unknown")))
    else:
        rows = rows.withColumn("known_as", F.lit("unknown"))
    # first per id: the distinct count needs no second pass over the rows, and no id is a hot spot
    by_id = rows.groupBy("dim_table", "period_id", "known_as", "missing_id").agg(F.count(F.lit(1)).alias("n"))
    return by_id.groupBy("dim_table", "period_id", "known_as").agg(
        F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_missing_ids")
    )

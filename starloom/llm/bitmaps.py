"""Distinct counts over huge identifier sets: multiresolution bitmaps.

An identifier's hash picks a slice, each with half the probability of the one before, and a bit in
the slice's small bitmap. Partial results merge by OR. Coarse slices fill up first; a count adds up
linear counts of the slices that aren't saturated, scaled by the share of the hash space they
hold. So the relative error stays about the same from a few identifiers to the largest sets.

With b bits a slice, the counted slices hold at least 2 b / 3 hashed identifiers or all of them,
which gives a standard error near 0.9 / sqrt(b): 2 % for the 2,048 bits used here, at any count up
to b * 2 ** (LEVELS - 1). Sets far smaller than b are counted almost exactly: two identifiers share a
bit now and then, which makes a count of a few too small by one.

Everything is built from the engine's own aggregates (bit_or over words of 32 bits), so partial
aggregation merges the bitmaps of a task before anything is shuffled, and a hot group sends no
more than one bitmap from each task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.exprs import text_hash60

#: Slices: the last takes all that is left of the geometric series.
LEVELS = 32
#: Bits of a slice, a power of two. They are kept in words of 32.
BITS = 2048
#: A slice with more than this share of its bits set is saturated.
FULL = 0.75


def slice_of(h: Column) -> Column:
    """Number of trailing ones of the hash's upper part, at most LEVELS - 1: slice i has probability 2 ** -(i+1)."""
    upper = F.shiftright(h, 24)  # 36 bits
    lowest_zero = F.bitwise_not(upper).bitwiseAND(upper + 1)
    return F.least(F.bit_count(lowest_zero - 1), F.lit(LEVELS - 1)).cast("int")


def bit_of(h: Column, bits: int = BITS) -> Column:
    """Position in the slice's bitmap, from the hash's lower 24 bits."""
    return h.bitwiseAND(F.lit(bits - 1)).cast("int")


def bitmap_rows(df: DataFrame, keys: list[str], values: list[str], bits: int = BITS) -> DataFrame:
    """``keys, field, level, word, mask``: the partial result. Null values are no identifiers.

    All ``values`` are taken in one pass. An empty group has no rows. Keys may be null.
    """
    items = F.array(*[F.struct(F.lit(v).alias("field"), text_hash60(F.col(v)).alias("h")) for v in values])
    rows = df.select(*keys, F.explode(items).alias("i")).filter("i.h is not null")
    h = F.col("i.h")
    bit = bit_of(h, bits)
    rows = rows.select(
        *keys,
        F.col("i.field").alias("field"),
        slice_of(h).alias("level"),
        F.shiftright(bit, 5).alias("word"),
        F.expr("shiftleft(1L, cast(i.h & 31 as int))").alias("mask"),
    )
    return merge_bitmaps(rows, keys)


def merge_bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Partial results put together for coarser (or the same) keys."""
    return rows.groupBy(*keys, "field", "level", "word").agg(F.bit_or("mask").alias("mask"))


def estimates(rows: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``keys, field, n_distinct`` (bigint) of merged bitmaps."""
    slices = rows.groupBy(*keys, "field", "level").agg(F.sum(F.bit_count("mask")).alias("ones"))
    full = F.col("ones") > F.lit(int(FULL * bits))
    # the slices counted are those beyond the last saturated one; the last slice of all is always counted
    linear = F.lit(float(bits)) * F.ln(F.lit(float(bits)) / F.greatest(F.lit(bits) - F.col("ones"), F.lit(1)))
    slices = slices.withColumns({"n": linear, "base": F.when(full & (F.col("level") < LEVELS - 1), F.col("level") + 1).otherwise(0)})
    groups = slices.groupBy(*keys, "field").agg(
        F.max("base").alias("base"), F.sort_array(F.collect_list(F.struct("level", "n"))).alias("slices")  # LEVELS at most
    )
    counted = F.filter("slices", lambda s: s["level"] >= F.col("base"))
    total = F.aggregate(counted, F.lit(0.0), lambda a, s: a + s["n"])
    # slices 0 .. base-1 hold 1 - 2 ** -base of the hash space
    scaled = total * F.pow(F.lit(2.0), F.col("base").cast("double"))
    return groups.select(*keys, "field", F.round(scaled).cast("bigint").alias("n_distinct"))


def distinct_cube(df: DataFrame, keys: list[str], values: list[str], bits: int = BITS) -> DataFrame:
    """``keys, grouping, field, n_distinct`` for every combination of keys, the empty one included.

    ``grouping`` names the keys of a combination (joined by '+', or 'all'); keys outside it are
    null. Rows are hashed once, for the finest combination; each coarser one merges the bitmaps of
    a combination with one key more, whose exchange Spark uses again.
    """
    merged: dict[tuple[str, ...], DataFrame] = {tuple(keys): bitmap_rows(df, keys, values, bits)}
    types = dict(df.dtypes)
    for n in range(len(keys) - 1, -1, -1):
        for chosen in combinations(keys, n):
            finer = next(c for c in merged if len(c) == n + 1 and set(chosen) <= set(c))
            merged[chosen] = merge_bitmaps(merged[finer], list(chosen))
    parts = []
    for chosen, rows in merged.items():
        named = [F.col(k) if k in chosen else F.lit(None).cast(types[k]).alias(k) for k in keys]
        counts = estimates(rows, list(chosen), bits)
        parts.append(counts.select(F.lit("+".join(chosen) or "all").alias("grouping"), *named, "field", "n_distinct"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_of(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial results of separate runs, for instance of separate days, as one."""
    return merge_bitmaps(reduce(lambda a, b: a.unionByName(b), parts), keys)

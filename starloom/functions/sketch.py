"""Distinct-count sketches stored as a map from bucket to rank (HyperLogLog registers).

A row's key text is hashed to 32 bits. The low bits choose one of m buckets; the rank is the
position of the leading one among the low 31 bits of the bucket's smallest hash. Sketches merge
by the larger rank of each bucket. The error rate decides m.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.exprs import text_hash32


def bucket_count(error_rate: float) -> int:
    """Smallest power of two of at least (1.04 / error) ** 2."""
    return 1 << math.ceil(2 * math.log2(1.04 / error_rate))


def bucket_of(value: Column, buckets: int) -> Column:
    return text_hash32(value).bitwiseAND(F.lit(buckets - 1))


def low_bits(value: Column) -> Column:
    return text_hash32(value).bitwiseAND(F.lit(2**31 - 1))


def rank_of(smallest: Column) -> Column:
    """31 minus the whole binary logarithm; both 0 and 1 give 31."""
    return (F.lit(32) - F.length(F.bin(smallest))).cast("int")


def sketch_rows(df: DataFrame, keys: list[str], value: str, error_rate: float) -> DataFrame:
    """``keys, bnum, rho``: the registers of each group as rows. Null values have none."""
    buckets = bucket_count(error_rate)
    hashed = df.filter(F.col(value).isNotNull()).select(
        *keys, bucket_of(F.col(value), buckets).alias("bnum"), low_bits(F.col(value)).alias("__low")
    )
    return hashed.groupBy(*keys, "bnum").agg(rank_of(F.min("__low")).alias("rho"))


def registers_json(bnum: Column, rho: Column) -> Column:
    """Aggregate: registers of a group as JSON, buckets in text order; ``{}`` when there are none."""
    pair = F.when(bnum.isNotNull(), F.struct(bnum.cast("string").alias("k"), rho.alias("v")))
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair))))


def parse_registers(sketch: Column) -> Column:
    return F.from_json(sketch, "map<string,int>")


def merge_sketches(df: DataFrame, keys: list[str], sketch: str) -> DataFrame:
    """One sketch for each value of ``keys``, equal to the sketch of all rows together."""
    rows = df.select(*keys, F.explode_outer(parse_registers(F.col(sketch))).alias("bnum", "rho"))
    best = rows.groupBy(*keys, "bnum").agg(F.max("rho").alias("rho"))
    return best.groupBy(*keys).agg(registers_json(F.col("bnum"), F.col("rho")).alias(sketch))


def estimate(sketch: Column, buckets: int) -> Column:
    """Distinct count told by a sketch: linear counting while buckets stay empty, else the harmonic mean."""
    ranks = F.map_values(parse_registers(sketch))
    filled = F.size(ranks)
    harmonic = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + F.pow(F.lit(2.0), -r.cast("double")))
    total = harmonic + (F.lit(buckets) - filled)
    alpha = 0.7213 / (1 + 1.079 / buckets)
    # the rank is taken after the bucket's own bits were drawn from the same 32 bits, so the
    # leading zeros are those of 31 bits
    raw = F.lit(alpha * buckets * buckets) / total
    empty = F.lit(buckets) - filled
    linear = F.lit(float(buckets)) * F.ln(F.lit(float(buckets)) / empty)
    return F.when((raw <= 2.5 * buckets) & (empty > 0), linear).otherwise(raw)

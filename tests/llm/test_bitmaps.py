"""Distinct counts: error bound, merging, combinations, edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from starloom.llm import bitmaps as bm


@pytest.mark.parametrize("n", [1, 50, 1000, 5000, 20_000, 100_000, 700_000])
def test_error_is_bounded_at_every_size(spark, n):
    df = spark.range(0, n * 3, 1, 4).select((F.col("id") % n).alias("v"))
    got = bm.estimates(bm.bitmap_rows(df, [], ["v"]), []).first()["n_distinct"]
    assert abs(got / n - 1) < 3.5 * 0.9 / math.sqrt(bm.BITS)


def test_many_sets_stay_within_the_standard_error(spark):
    df = spark.range(0, 400_000, 1, 4).select((F.col("id") % 40).alias("g"), F.col("id").alias("v"))
    errors = [r["n_distinct"] / 10_000 - 1 for r in bm.estimates(bm.bitmap_rows(df, ["g"], ["v"]), ["g"]).collect()]
    rms = math.sqrt(sum(e * e for e in errors) / len(errors))
    assert len(errors) == 40 and rms < 0.026 and abs(sum(errors) / 40) < 0.012


def test_slices_are_geometric(spark):
    df = spark.range(100_000).select(bm.slice_of(bm.text_hash60(F.col("id"))).alias("s"))
    shares = {r["s"]: r["count"] / 100_000 for r in df.groupBy("s").count().collect()}
    for i in range(5):
        assert abs(shares[i] / 2 ** -(i + 1) - 1) < 0.08


def test_merged_parts_equal_the_whole(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7000).alias("v"))
    parts = [bm.bitmap_rows(df.filter(F.col("v") % 2 == i), [], ["v"]) for i in (0, 1)]
    whole = bm.bitmap_rows(df, [], ["v"])
    assert set(map(tuple, bm.union_of(parts, []).collect())) == set(map(tuple, whole.collect()))
    by_group = bm.bitmap_rows(df, ["g"], ["v"])
    assert set(map(tuple, bm.merge_bitmaps(by_group, []).collect())) == set(map(tuple, whole.collect()))


def test_cube_with_nulls_and_repeats(spark):
    data = [(1, "a", 5, "x"), (1, "a", 5, "x"), (1, None, 6, "y"), (2, "a", None, "x"), (None, "a", 5, None)] * 3
    df = spark.createDataFrame(data, "day int, pub string, m int, s string")
    got = {(r["grouping"], r["day"], r["pub"], r["field"]): r["n_distinct"] for r in bm.distinct_cube(df, ["day", "pub"], ["m", "s"]).collect()}
    want = {}
    for d, p, m, s in data:
        for name, day, pub in (("day+pub", d, p), ("day", d, None), ("pub", None, p), ("all", None, None)):
            for field, v in (("m", m), ("s", s)):
                if v is not None:
                    want.setdefault((name, day, pub, field), set()).add(v)
    assert got == {k: len(v) for k, v in want.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "g int, v int")
    assert bm.distinct_cube(df, ["g"], ["v"]).count() == 0


def test_extra_columns(spark):
    df = spark.range(50).selectExpr("id % 2 as g", "id as v", "1 as field", "2 as level", "3 as mask", "'x' as grouping", "4 as V2")
    got = {r["g"]: r["n_distinct"] for r in bm.distinct_cube(df, ["g"], ["v"]).filter("grouping = 'g'").collect()}
    assert set(got) == {0, 1} and all(abs(n - 25) <= 1 for n in got.values())

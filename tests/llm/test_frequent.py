"""The heavy-light sketch: bounds always hold, nothing above the threshold is missed."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.llm import frequent as fr


def zipf(n, seed):
    rng = random.Random(seed)
    return [f"v{int(1 / (rng.random() + 1e-4) ** 1.2)}" for _ in range(n)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=400))
def test_bounds_hold_in_tiny_sketches(values):
    s = fr.HeavyLight(buckets=2, slots=2, light=8, evict=2)
    for v in values:
        s.add([str(v)], [hash((v, 1)) & (2**63 - 1)], [1])
    exact, held = Counter(map(str, values)), {}
    for _, v, n in s.slots_held():
        held[v] = n
    for v, n in exact.items():
        h = hash((int(v), 1)) & (2**63 - 1)
        low = held.get(v, 0)
        assert low <= n <= low + s.light[(h >> 16) % 8]
    assert sum(held.values()) + sum(s.light) == len(values)


def test_found_is_exact(spark, monkeypatch):
    values = zipf(20_000, 3) + [None] * 500 + ["", "  ", " \t"] * 100 + [" v1"] * 150
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, None, i) for i, v in enumerate(values)], "a string, b string, __n int").repartition(6)
    kept = [v for v in values if v and v.strip()]
    want = {v for v, n in Counter(kept).items() if n >= 0.005 * len(kept)}
    assert {(r["field"], r["item"]) for r in fr.found_items(df, ["a", "b"], 0.005).collect()} == {("a", v) for v in want}
    # so few slots and counters that values above the threshold lose their slots: they are found all the same
    for name, n in (("BUCKETS", 1), ("SLOTS", 1), ("LIGHT", 16)):
        monkeypatch.setattr(fr, name, n)
    monkeypatch.setattr(fr.HeavyLight.__init__, "__defaults__", (1, 1, 16, 2))
    assert {r["item"] for r in fr.found_items(df, ["a"], 0.005).collect()} == want


def test_bounds_and_top(spark):
    values = zipf(30_000, 5)
    df = spark.createDataFrame([(v,) for v in values], "a string").repartition(5)
    parts = fr.sketch_parts(df, ["a"])
    exact = Counter(values)
    got = fr.frequent_items(parts).collect()
    assert all(r["low"] <= exact[r["item"]] <= r["high"] for r in got)
    top = [r["item"] for r in fr.top_items(parts, 10).collect()]
    assert len(top) == 10 and set(top) == {v for v, _ in exact.most_common(10)}


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "a string")
    assert fr.found_items(df, ["a"], 0.1).count() == 0
    long = spark.createDataFrame([("x" * 100_000,), ("y",)], "a string")
    assert fr.found_items(long.select(F.col("a"), F.col("a").alias("A2")), ["a"], 0.4).count() == 2


def test_the_merged_sketch_does_not_grow_with_the_tasks(spark):
    """A hundred tasks give a sketch no larger than ten, and its bounds hold."""
    rng = random.Random(6)
    values = [f"hot{rng.randrange(5)}" if rng.random() < 0.3 else f"v{rng.randrange(10**9)}" for _ in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values], "a string")
    exact, total = Counter(values), len(values)

    hashed = df.distinct().select("a", F.xxhash64("a").alias("h")).collect()
    lookup = {r["a"]: r for r in hashed}
    sizes = {}
    for n in (10, 100):
        rows = []
        for i in range(n):
            part = values[i * total // n : (i + 1) * total // n]
            s, mine = fr.HeavyLight(), Counter(part)
            s.add(list(mine), [lookup[v]["h"] & (2**64 - 1) for v in mine], list(mine.values()))
            rows += [("a", "heavy", b, v, c) for b, v, c in s.slots_held()] + [("a", "light", at, None, c) for at, c in enumerate(s.light) if c]
        parts = fr.merged(spark.createDataFrame(rows, fr._DDL)).cache()
        sizes[n] = parts.count()
        assert parts.filter("part = 'heavy'").count() <= fr.BUCKETS * fr.SLOTS and parts.agg(F.sum("n")).first()[0] == total
        got = {r["item"]: (r["low"], r["high"]) for r in fr.frequent_items(parts).collect()}
        assert all(low <= exact[v] <= high for v, (low, high) in got.items()) and {f"hot{i}" for i in range(5)} <= set(got)
        parts.unpersist()
    assert max(sizes.values()) <= fr.BUCKETS * fr.SLOTS + fr.LIGHT

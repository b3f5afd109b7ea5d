"""The general data-processing operators against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from starloom.operators import balance as ba
from starloom.operators import changes as ch
from starloom.operators.orphans import dimension_orphans, orphan_counts, orphan_references
from starloom.operators.rolling import idle_days, rolling_totals

T0 = datetime(2024, 3, 10)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1: new or changed records ----------------------------------------------------------


def test_ranges_merge_and_cover(spark):
    rng = random.Random(1)
    given = [(u, a, a + rng.choice([0, 1, 5, 40, -3])) for u in "ab" for a in (rng.randrange(200) for _ in range(30))]
    given += [(None, 1, 9), ("a", None, 4), ("b", 5, None), ("a", -25, -3), ("a", -25, -3)]
    ranges = ch.merged_ranges(spark.createDataFrame(given, "u string, lo bigint, hi bigint"), "u", "lo", "hi", 16)
    got = sorted(map(tuple, ranges.select("unit", "lo", "hi").collect()))
    for (u, _, hi), (v, lo, _) in zip(got, got[1:]):
        assert u != v or hi <= lo
    points = [(u, p) for u in ("a", "b", "c", None) for p in [*range(-30, 250), None]]
    marked = ch.mark_covered(spark.createDataFrame(points, "u string, p bigint"), F.col("u"), F.col("p"), ranges, 16)
    assert marked.columns == ["u", "p", "covered"] and marked.count() == len(points)
    for u, p, covered in marked.collect():
        assert covered == any(u is not None and u == v and None not in (p, lo, hi) and lo <= p < hi for v, lo, hi in given)


def test_ranges_by_shuffle_are_the_same(spark, monkeypatch):
    ranges = ch.merged_ranges(spark.createDataFrame([("a", 0, 50), ("b", 7, 9)], "u string, lo bigint, hi bigint"), "u", "lo", "hi", 16)
    points = spark.range(60).select(F.expr("if(id % 2 = 0, 'a', 'b')").alias("u"), F.col("id").alias("p"))
    one = rows(ch.mark_covered(points, F.col("u"), F.col("p"), ranges, 16))
    monkeypatch.setattr(ch, "BROADCAST_RANGES", 0)
    assert rows(ch.mark_covered(points, F.col("u"), F.col("p"), ranges, 16)) == one


EVENTS = "id string, created_at timestamp_ntz, publisher_id int, city string, arrived_at timestamp_ntz"
LOG = "run_id bigint, shard int, read_from timestamp_ntz, read_upto timestamp_ntz, logged_at timestamp_ntz, status string"


def at(h, us=0):
    return T0 + timedelta(hours=h, microseconds=us)


def pending(spark, events, log):
    return rows(ch.unprocessed_sessions(spark.createDataFrame(events, EVENTS), spark.createDataFrame(log, LOG)))


def test_sessions_left_to_process(spark):
    log = [
        (1, 0, at(0), at(5), at(6), "started"), (1, 0, at(0), at(5), at(7), " COMMITTED "), (1, 0, at(0), at(5), at(7), " COMMITTED "),
        (2, 0, at(5), at(9), at(9), "committed"), (2, 0, at(5), at(9), at(10), "rolled back"), (3, 1, at(0), at(9), at(9), "started"),
        (4, 0, None, at(9), at(9), "committed"), (5, 0, at(9), at(2), at(9), "committed"), (6, 0, at(5), at(9), None, "committed"), (7, 0, at(5), at(9), at(9), None),
    ]
    minute = int((at(1) - datetime(1970, 1, 1)).total_seconds() // 60)
    events = [
        ("read", at(1), 4, "x", at(2)), ("edge", at(1), 4, "x", at(5)), ("last", at(1), 4, "x", at(5, -1)), ("shard", at(1), 5, "x", at(2)),
        ("again", at(1), 4, "x", at(2)), ("again", at(1), 4, "x", at(8)), ("fixed", at(1), 4, "x", at(2)), ("fixed", at(1), 4, "y", at(8)),
        ("null", at(1), 4, None, at(2)), ("null", at(1), 4, "y", at(8)), ("twice", at(1), 4, "x", at(8)), ("twice", at(1), 4, "x", at(8)),
        ("back", at(1), 4, "x", at(2)), ("back", at(1), 4, "y", at(8)), ("back", at(1), 4, "x", at(9)), (None, at(1), 4, "x", at(8)), ("no", at(1), 4, "x", None),
    ]
    want = [("edge", 4), ("fixed", 4), ("null", 4), ("shard", 5), ("twice", 4)]
    assert pending(spark, events, log) == [(s, p, minute) for s, p in want]


def test_sessions_without_log_or_events(spark):
    assert pending(spark, [], []) == []
    assert len(pending(spark, [("a", at(1), 1, "x", at(2))], [])) == 1


def test_extra_columns_are_content(spark):
    log = [(1, 1, at(0), at(5), at(6), "committed")]
    events = spark.createDataFrame([("a", at(1), 1, "x", at(2)), ("a", at(1), 1, "x", at(8))], EVENTS)
    odd = events.withColumns({"session_id": F.lit(1), "was_read": F.lit(2), "__unit": F.lit(3), "h1": F.col("arrived_at").cast("string")})
    logs = spark.createDataFrame(log, LOG).withColumns({"unit": F.lit(1), "lo": F.lit(9), "last": F.lit("z")})
    assert ch.unprocessed_sessions(events, logs).count() == 0
    assert ch.unprocessed_sessions(odd.drop("h1"), logs).count() == 0 and ch.unprocessed_sessions(odd, logs).count() == 1


def test_micros(spark):
    x = datetime(2024, 3, 10, 2, 30, 59, 123456)
    for v in (x, datetime(1969, 12, 31, 23, 59, 59, 999999)):
        got = spark.createDataFrame([(v,)], "x timestamp_ntz").select(ch.micros(F.col("x"))).first()[0]
        assert got == (v - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def test_versions_and_deltas(spark, tmp_path):
    table = ch.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.latest().version == 0
    v1 = table.append(spark.range(10).coalesce(1))
    v2 = table.append(spark.range(10, 15).coalesce(1))
    v3 = table.delete_where(F.col("id").isin(3, 12))
    v4 = table.delete_where(F.col("id").isin(4, 12))
    v5 = table.replace_files(list(v1.files), spark.range(100, 102).coalesce(1))
    assert rows(table.delta(v1, v2)) == [(i, "insert") for i in range(10, 15)]
    assert rows(table.delta(v2, v3)) == [(12, "delete"), (3, "delete")]
    assert rows(table.delta(v3, v4)) == [(4, "delete")]
    assert rows(table.delta(v4, v2)) == [(12, "insert"), (3, "insert"), (4, "insert")]
    assert rows(table.delta(v4, v5)) == sorted([(i, "delete") for i in range(10) if i not in (3, 4)] + [(100, "insert"), (101, "insert")], key=repr)
    assert table.delta(v5, v5) is None
    # a delta takes any version to any other
    for a in (v1, v3, v5):
        for b in (v2, v4, v5):
            have = Counter(r[0] for r in table.read(a).collect())
            delta = table.delta(a, b)
            for i, change in delta.collect() if delta is not None else []:
                have[i] += 1 if change == "insert" else -1
            assert +have == Counter(r[0] for r in table.read(b).collect()) and min(have.values()) >= 0


def test_processing_survives_failures(spark, tmp_path):
    source, sink = (ch.VersionedTable(spark, str(tmp_path / n)) for n in ("in", "out"))
    double = lambda df: df.filter("_change = 'insert'").select((F.col("id") * 2).alias("x"))
    source.append(spark.range(3))
    ch.process_new(source, sink, "job", double)
    source.append(spark.range(3, 6))

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ch.process_new(source, sink, "job", dies)
    # the output was written, the commit never came
    sink._write(double(source.delta(source.at(1), source.latest())))
    ch.process_new(source, sink, "job", double)
    before = sink.latest()
    assert ch.process_new(source, sink, "job", double) == before
    assert sorted(r[0] for r in sink.read().collect()) == [0, 2, 4, 6, 8, 10]
    with pytest.raises(ch.CommitConflict):
        sink.append(spark.range(1).select(F.col("id").alias("x")), base=sink.at(1))
    assert sink.latest() == before


def files_read(df):
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


def test_a_delta_reads_changed_files_only(spark, tmp_path):
    table = ch.VersionedTable(spark, str(tmp_path / "t"))
    v1 = table.append(spark.range(1000).repartition(10))
    some = table.read().first()[0]
    v2 = table.delete_where(F.col("id") == some)
    d = table.difference(v1, v2)
    assert not d.added and not d.removed and len(d.changed) == 1
    assert rows(table.delta(v1, v2)) == [(some, "delete")]
    data = {f for f in files_read(table.delta(v1, v2)) if f in {x.rsplit("/", 1)[-1] for x in v1.files}}
    assert len(data) == 1 and len(v1.files) == 10


def test_rewrites_are_no_changes(spark, tmp_path):
    table = ch.VersionedTable(spark, str(tmp_path / "t"))
    v1 = table.append(spark.range(100).repartition(3))
    v2 = table.delete_where(F.col("id") < 10)
    v3 = table.append(spark.range(200, 220))
    v4 = table.compact()
    v5 = table.delete_where((F.col("id") == 50) | (F.col("id") == 205))
    v6 = table.compact()
    assert len(v4.files) < len(v3.files) + 2 and table.delta(v3, v4) is None and table.delta(v2, v2) is None
    assert rows(table.delta(v4, v5)) == [(205, "delete"), (50, "delete")] == rows(table.delta(v3, v6)) == rows(table.delta(v4, v6))
    # a row that came and went between the two versions doesn't show
    want = sorted([(i, "delete") for i in [*range(10), 50]] + [(i, "insert") for i in range(200, 220) if i != 205], key=repr)
    assert rows(table.delta(v1, v6)) == want == rows(table.delta(v1, v5))
    assert sorted(r[0] for r in table.read().collect()) == [i for i in [*range(10, 100), *range(200, 220)] if i not in (50, 205)]
    assert rows(table.delta(v6, v1)) == sorted([(i, "insert" if c == "delete" else "delete") for i, c in want], key=repr)


def test_versions_by_shuffle(spark, tmp_path, monkeypatch):
    from starloom.sources import versions

    monkeypatch.setattr(versions, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(ch, "BROADCAST_SESSIONS", 0)
    test_versions_and_deltas(spark, tmp_path)
    test_sessions_by_versions(spark, tmp_path)


def test_empty_versions(spark, tmp_path):
    table = ch.VersionedTable(spark, str(tmp_path / "t"))
    assert table.compact().version == 0
    v1 = table.append(spark.range(5))
    v2 = table.replace_files(list(v1.files))
    assert v2.files == {} and table.read().count() == 0 and table.read().columns == ["id"]
    assert table.delta(v1, v2).count() == 5 and table.delta(v2, table.delete_where(F.col("id") > 0)) is None


def test_sessions_by_versions(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.choice("abcdefgh") + str(rng.randrange(30)), at(rng.randrange(40)), rng.randrange(1, 9), rng.choice(["x", "y", None]), at(rng.randrange(40))) for _ in range(600)]
    events += [(None, at(1), 1, "x", at(3)), ("q", at(1), 2, "x", None)]
    log = [(i, rng.randrange(4), at(a := rng.randrange(40)), at(a + rng.randrange(12)), at(i), rng.choice(["committed", "COMMITTED", "failed"])) for i in range(20)]
    folder = str(tmp_path / "events here%20.parquet")
    spark.createDataFrame(events, EVENTS).repartition(4).write.parquet(folder)
    logs = spark.createDataFrame(log, LOG)
    read = spark.read.parquet(folder)
    want = pending(spark, events, log)
    sink = ch.process_sessions(read, logs, str(tmp_path / "p"))
    assert want and rows(ch.pending_sessions(sink)) == want
    before = sink.latest()
    assert before.properties["processed.sessions"] == "2"
    ch.process_sessions(read, logs, str(tmp_path / "p"))
    assert sink.latest() == before
    # nothing was read so far; nothing is left
    assert rows(ch.pending_sessions(ch.process_sessions(read, logs.limit(0), str(tmp_path / "q")))) == pending(spark, events, [])
    every = spark.createDataFrame([(i, i, at(-9), at(99), at(1), "committed") for i in range(4)], LOG)
    assert ch.pending_sessions(ch.process_sessions(read.filter("arrived_at is not null"), every, str(tmp_path / "r"))).count() == 0


def test_sessions_of_empty_tables_by_versions(spark, tmp_path):
    folder = str(tmp_path / "none.parquet")
    spark.createDataFrame([], EVENTS).write.parquet(folder)
    got = ch.pending_sessions(ch.process_sessions(spark.read.parquet(folder), spark.createDataFrame([], LOG), str(tmp_path / "p")))
    assert got.count() == 0 and got.columns == ["session_id", "publisher_id", "created_at_minute_id"]


def test_adopted_and_own_files(spark, tmp_path):
    folder = str(tmp_path / "else where.parquet")
    spark.range(10).write.parquet(folder)
    table = ch.VersionedTable(spark, f"{tmp_path}/a table")
    v1 = table.adopt(spark.read.parquet(folder).inputFiles(), lambda rows: rows.filter("id > 7"))
    v2 = table.append(spark.range(20, 25))
    v3 = table.delete_where(F.col("id").isin(3, 21))
    assert sorted(r[0] for r in table.read().collect()) == [0, 1, 2, 4, 5, 6, 7, 20, 22, 23, 24]
    assert rows(table.delta(v2, v3)) == [(21, "delete"), (3, "delete")] and table.delta(v1, v3).filter("_change = 'delete'").count() == 1
    assert spark.read.parquet(folder).count() == 10  # what was adopted stays as it is


# --- 4: rolling totals ---------------------------------------------------------------------


def brute_totals(amounts, periods):
    out = {}
    for k in {k for k, _ in amounts}:
        days = [d for q, d in amounts if q == k]
        for d in range(min(days), max(days) + max(periods)):
            out[k, d] = (amounts.get((k, d), 0), *(sum(amounts.get((k, x), 0) for x in range(d - p + 1, d + 1)) for p in periods))
    return out


@pytest.mark.parametrize("periods", [(7, 30), (3,), (1, 2, 5)])
def test_rolling_totals(spark, periods):
    rng = random.Random(4)
    data = [(rng.choice([1, 2, None]), rng.choice([rng.randrange(20), 150]), rng.choice([None, 0, -2, 3, 3])) for _ in range(60)]
    amounts = defaultdict(int)
    for k, d, a in data:
        amounts[k, d] += a or 0
    df = spark.createDataFrame([*data, (1, None, 5)], "k int, d int, n int")
    got = rolling_totals(df, "k", F.col("d"), F.col("n"), periods)
    want = brute_totals(amounts, periods)
    assert {(r["k"], r["day_id"]): (r["day_total"], *(r[f"total_{p}"] for p in periods)) for r in got.collect()} == want
    assert got.count() == len(want)
    first = got.filter("day_total <> 0").first()
    assert first[f"average_{periods[0]}"] == first[f"total_{periods[0]}"] / periods[0]
    found = {tuple(r) for r in idle_days(rolling_totals(df, "k", F.col("d"), F.col("n"), periods, quiet=False), "k", periods).collect()}
    assert found == {(k, d, p) for (k, d), (own, *totals) in want.items() for p, x in zip(periods, totals) if own == 0 and x > 0}


def test_rolling_extra_columns(spark):
    df = spark.createDataFrame([(1, 5, 2)], "d int, own int, day_id int").withColumns({"__k": F.lit(0), "next": F.lit(1)})
    assert rows(rolling_totals(df, "d", F.col("own"), F.col("day_id"), (2,)).drop("average_2")) == [(1, 5, 2, 2), (1, 6, 0, 2)]


def test_rolling_empty(spark):
    assert rolling_totals(spark.createDataFrame([], "k int, d int, n int"), "k", F.col("d"), F.col("n")).count() == 0


# --- 5: orphans --------------------------------------------------------------------------------


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_orphans_under_each_rule(spark, match):
    values = [None, 1, 2, 9]
    refs = [(a, b, c) for a in values for b in values for c in (1, None)] * 2
    target = [(1, 1, 1), (2, 1, None), (None, 9, 1), (1, 1, 1)]

    def broken(r):
        nulls = [x is None for x in r]
        if all(nulls) or (match == "simple" and any(nulls)):
            return False
        if match == "full" and any(nulls):
            return True
        return not any(all(x is None or x == y for x, y in zip(r, t)) for t in target)

    df = spark.createDataFrame(refs, "a int, b int, c int")
    other = spark.createDataFrame(target, "c int, a int, b int")  # names clash with those of the references
    got = orphan_references(df, other, [("a", "c"), ("b", "a"), ("c", "b")], match)
    assert rows(got) == sorted([r for r in refs if broken(r)], key=repr)


def test_dimension_orphans(spark):
    facts = spark.createDataFrame([(1, 5, 7), (1, 5, 7), (2, -1, 8), (None, 6, 7), (3, None, 9)], "geo int, agent int, minute int")
    dim = spark.createDataFrame([(5,), (None,)], "id int")
    got = dimension_orphans(facts, {"g": ("geo", dim), "a": ("agent", dim)}, ["minute"])
    assert rows(got) == [("a", 6, 7), ("g", 1, 7), ("g", 2, 8), ("g", 3, 9)]
    notes = spark.createDataFrame([("g", 1, "deleted", T0), ("g", 1, "restored", at(1)), ("g", 1, "restored", at(1)), ("a", 1, "deleted", at(3))], "dim_table string, dim_id int, change string, noted_at timestamp_ntz")
    counts = orphan_counts(got, F.col("minute") * 0, notes)
    assert rows(counts) == [("a", 0, "unknown", 1, 1), ("g", 0, "restored", 1, 1), ("g", 0, "unknown", 2, 2)]
    assert dimension_orphans(facts.limit(0), {"g": ("geo", dim)}, ["minute"]).count() == 0


# --- 6: uneven keys --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def uneven(spark):
    hot = spark.range(6000).select(F.lit(1).alias("k"), "id")
    nulls = spark.range(500).select(F.lit(None).cast("int").alias("k"), "id")
    return hot.unionByName(spark.range(6000, 12000).select((F.col("id") % 900 + 2).cast("int").alias("k"), "id")).unionByName(nulls)


def test_tasks_get_even_loads(spark, uneven):
    plan = ba.plan_placement(ba.key_loads(uneven, "k"), "k", 8)
    assert set(plan.shards) == {1, None} and sum(plan.planned) == uneven.count() and max(plan.planned) < 1.2 * 12500 / 8
    out = ba.balanced(uneven, "k", 8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.35 * 12500 / 8
    spread = out.filter("k > 1").groupBy("k").agg(F.countDistinct("__task").alias("n")).agg(F.max("n")).first()[0]
    assert spread == 1  # light keys stay whole


def test_a_heavy_null_key_is_split(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 5 > 2, F.col("id") % 700).cast("int").alias("k"), "id")
    placement = ba.plan_placement(ba.key_loads(df, "k"), "k", 8)
    assert None in placement.shards and len(set(placement.shards[None])) > 3
    small = spark.range(700).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    for out in (ba.balanced(df, "k", 8, placement), ba.balanced_join(df, small, ["k"], 8, "left")):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 1.5 * 100_000 / 8


def test_the_plan_does_not_grow_with_the_tasks(spark, uneven):
    size = lambda tasks: len(ba.balanced(uneven, "k", tasks)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(400) - size(8)) < 500


def test_split_keys(spark, uneven):
    for tasks in (1, 8):
        placement = ba.plan_placement(ba.key_loads(uneven, "k"), "k", tasks, share=0.04)
        got = {r["k"]: r["n_rows"] for r in ba.split_keys(spark, placement, "k", 0.04).collect()}
        assert got == {1: 6000, None: 500}
    assert ba.split_keys(spark, ba.plan_placement(ba.key_loads(uneven.limit(0), "k"), "k", 4), "k", 0.1).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join_is_a_join(spark, uneven, how):
    small = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30), (77777, 1)], "k int, v int")
    big = uneven.withColumn("d", (F.col("id") % 3).cast("int"))
    got = ba.balanced_join(big, small.withColumn("d", F.lit(1)), ["k", "d"], 8, how)
    want = big.join(small.withColumn("d", F.lit(1)), ["k", "d"], how)
    assert rows(got.select("k", "id", "d", "v")) == rows(want.select("k", "id", "d", "v"))


def test_clashing_names_in_a_join(spark, uneven):
    small = spark.createDataFrame([(1, 10, "x")], "k int, id int, ID2 string")
    got = ba.balanced_join(uneven.withColumn("id2", F.lit(0)), small, ["k"], 4, "inner")
    assert got.columns == ["k", "id", "id2", "__task", "right_id", "right_ID2"] and got.count() == 6000


def test_join_adds_no_exchange(spark, uneven):
    small = spark.range(5000).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ba.balanced_join(uneven, small, ["k"], 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = plan.count("Exchange") - plan.count("BroadcastExchange")  # the placement itself is broadcast
    assert shuffles == 2 and plan.count("shufflepartitionidpassthrough") == 2


def test_heavy_keys_and_empty(spark, uneven):
    assert rows(ba.heavy_keys(ba.key_loads(uneven, "k"), 0.3)) == [(1, 6000)]
    empty = uneven.limit(0)
    assert ba.balanced(empty, "k", 4).count() == 0 and ba.heavy_keys(ba.key_loads(empty, "k"), 0.3).count() == 0

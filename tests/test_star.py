"""Loads on small hand-made tables: nulls, repeats, unmatched parents, odd times, empty tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from starloom.functions import sketch as sk
from starloom.functions.exprs import default_literal, in_window, row_hash, time_bucket
from starloom.operators.dimension import assign_ids, assign_ids_ranged, dimension_full, dimension_increment
from starloom.operators.fact import load_fact, merge_facts
from starloom.plans import build, ddl, derive, sqltext
from starloom.plans import model as m
from starloom.sources.shared import staged
from starloom.sources.store import TableStore
from starloom.streaming.microbatch import current, stream_fact, windowed_counts
from test_plans import AD, CLICK, CLICKS, DEFAULTS, VISIT, VISITS, env
from starloom.plans.validate import make_env

END = datetime(2100, 1, 1)
V = "id string, seen_at timestamp_ntz, shop int, city_name string, city_land string, browser string, spent int"
C = "id string, at timestamp_ntz, shop int, visit_id string, ad_id int, kind string"


def t(minute, second=0):
    return datetime(2024, 3, 10, 2, minute, second)


@pytest.fixture(scope="module")
def tables(spark):
    visits = [
        ("a", t(30), 1, "Ulm", None, "x", 5), ("b", t(30, 59), 1, "Ulm", None, "x", None), ("c", t(31), 1, None, None, None, 7),
        ("d", t(31), 1, None, "D", "x", None), ("e", datetime(1969, 12, 31, 23, 59, 59), 2, "", "D", "y", 1),
    ]
    clicks = [("p", t(40), 1, "a", 3, "k"), ("q", t(40), 1, "zz", None, "k"), ("r", t(40), 2, "a", 3, "l"), ("s", t(40), 1, None, 9, "k")]
    out = {
        "visits": spark.createDataFrame(visits, V), "clicks": spark.createDataFrame(clicks, C),
        "ads": spark.createDataFrame([(3, "n")], "id int, name string"),
    }
    e = env()
    out["dim_city"] = dimension_full(e, VISITS, "city", out["visits"], END)
    out["dim_agent"] = dimension_full(e, VISITS, "agent", out["visits"], END)
    out["dim_kind"] = dimension_full(e, CLICKS, "kind", out["clicks"], END)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("unit", list(m.TimeUnit))
def test_buckets_floor_and_ignore_the_zone(spark, unit):
    times = [datetime(1969, 12, 31, 23, 59, 59, 500000), datetime(1970, 1, 1), datetime(2024, 3, 10, 2, 30), datetime(2024, 2, 29, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(x,) for x in [*times, None]], "x timestamp_ntz")
    got = [r[0] for r in df.select(time_bucket(F.col("x"), unit)).collect()]
    want = [int((x - datetime(1970, 1, 1)).total_seconds() // unit.value) for x in times]
    assert got == [*want, None]


def test_bounds_ignore_the_zone(spark):
    df = spark.createDataFrame([(t(30),), (t(31),), (None,)], "x timestamp_ntz")
    assert df.filter(in_window(F.col("x"), t(31))).count() == 1
    assert df.filter(in_window(F.col("x"), END, t(31))).count() == 1


def test_defaults(spark):
    got = spark.range(1).select(
        default_literal("'a''b'", "text"), default_literal("'00-00-00 00:00:00'", "timestamp").cast("string"),
        default_literal("'{}'::json", "json"), default_literal("-1", "numeric(9,6)"), default_literal("false", "boolean"),
    ).first()
    assert got[0] == "a'b" and got[1] == "0001-01-01 00:00:00" and got[2] == "{}" and got[3] == -1 and got[4] is False


def test_dimension_values(tables):
    assert rows(tables["dim_city"]) == [(1, "", "D"), (2, "?", "D"), (3, "Ulm", "?")]
    assert rows(tables["dim_agent"]) == [(1, "x"), (2, "y")]


def test_dimension_increment_continues_ids(spark, tables):
    e = env()
    old = dimension_full(e, VISITS, "city", tables["visits"], t(30))
    new = dimension_increment(e, VISITS, "city", tables["visits"], old, END, t(30))
    assert rows(old) == [(1, "", "D")] and rows(new) == [(2, "?", "D"), (3, "Ulm", "?")]
    none = dimension_increment(e, VISITS, "city", tables["visits"], spark.createDataFrame([], old.schema), END, t(31))
    assert rows(none) == [(1, "?", "D")]


def test_ranged_ids_equal_plain_ones(spark):
    values = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), F.lit("x").alias("b"))
    assert rows(assign_ids(values, "id")) == rows(assign_ids_ranged(values, "id", staged))


def test_fact(tables):
    got = {(r["shop"], r["city_id"], r["agent_id"]): r for r in load_fact(env(), VISITS, tables.__getitem__, END).collect()}
    assert set(got) == {(1, 3, 1), (1, -1, -1), (1, 2, 1), (2, 1, 2)}
    a = got[1, 3, 1]
    assert (a["n"], a["money"], a["mean_count"], a["mean_sum"]) == (2, 5, 1, 5)
    assert got[1, 2, 1]["money"] is None and got[2, 1, 2]["seen_at_minute_id"] == -1


def test_parents_give_dimensions_only(tables):
    got = {r["shop"]: r for r in load_fact(env(), CLICKS, tables.__getitem__, END).collect() if r["ad_id"] == 3}
    assert (got[1]["city_id"], got[1]["agent_id"], got[1]["n"]) == (3, 1, 1)
    assert (got[2]["city_id"], got[2]["agent_id"]) == (-1, -1)  # the parent belongs to another shop
    assert sum(r["n"] for r in load_fact(env(), CLICKS, tables.__getitem__, END).collect()) == 4


def test_several_sketches_share_one_pass(spark, tables):
    columns = (m.DimTime("seen_at"), m.FactCountDistinct("a", "city_name"), m.FactCount("n"), m.FactCountDistinct("b", "spent"), m.FactMax("top", "spent"), m.FactCountDistinct("c", "id"))
    fact = m.Fact("many", "visits", columns)
    e = make_env([VISIT], [fact], None, DEFAULTS)
    df = load_fact(e, fact, tables.__getitem__, END)
    one = {c.column: load_fact(e2, f2, tables.__getitem__, END) for c in columns if isinstance(c, m.FactCountDistinct)
           for f2 in [m.Fact("one", "visits", (columns[0], c))] for e2 in [make_env([VISIT], [f2], None, DEFAULTS)]}
    for name, alone in one.items():
        assert rows(df.select("seen_at_minute_id", name)) == rows(alone)
    assert sorted((r["n"], r["top"] or 0) for r in df.collect()) == [(1, 1), (2, 5), (2, 7)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 1


def test_rows_without_parent_are_spread(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load_fact(env(), CLICKS, tables.__getitem__, END)._jdf.queryExecution().executedPlan().toString()
        got = rows(load_fact(env(), CLICKS, tables.__getitem__, END))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "pmod(xxhash64(s0__id" in plan and got == rows(load_fact(env(), CLICKS, tables.__getitem__, END))


def test_two_ids_for_a_value_fail(tables):
    twice = tables | {"dim_agent": tables["dim_agent"].unionByName(tables["dim_agent"].withColumn("id", F.col("id") + 9))}
    with pytest.raises(Exception, match="more than one id"):
        load_fact(env(), VISITS, twice.__getitem__, END).collect()


def test_empty_tables(spark, tables):
    empty = {n: spark.createDataFrame([], df.schema) for n, df in tables.items()}
    assert load_fact(env(), CLICKS, empty.__getitem__, END).count() == 0
    assert dimension_full(env(), VISITS, "city", empty["visits"], END).count() == 0


def test_extra_columns_do_not_clash(tables):
    noisy = tables | {"visits": tables["visits"].withColumns({"n": F.lit(9), "__b": F.lit(1), "s0__shop": F.lit(2), "city_id": F.lit(4)})}
    assert rows(load_fact(env(), VISITS, noisy.__getitem__, END)) == rows(load_fact(env(), VISITS, tables.__getitem__, END))


def test_unaligned_parts_merge(tables):
    e, get = env(), tables.__getitem__
    cut = datetime(2024, 3, 10, 2, 30, 30)
    parts = load_fact(e, VISITS, get, cut), load_fact(e, VISITS, get, END, cut)
    assert rows(merge_facts(e, VISITS, *parts)) == rows(load_fact(e, VISITS, get, END))


def test_sketch_error_and_merge(spark):
    assert sk.bucket_count(0.05) == 512
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    one = df.groupBy().agg(F.lit(1))
    whole = sk.sketch_rows(df, [], "v", 0.05)
    parts = sk.sketch_rows(df, ["g"], "v", 0.05).groupBy("g").agg(sk.registers_json(F.col("bnum"), F.col("rho")).alias("s"))
    merged = sk.merge_sketches(parts.withColumn("k", F.lit(1)), ["k"], "s")
    direct = whole.groupBy().agg(sk.registers_json(F.col("bnum"), F.col("rho")).alias("s"))
    assert merged.first()["s"] == direct.first()["s"]
    n = merged.select(sk.estimate(F.col("s"), 512)).first()[0]
    assert abs(n / 20000 - 1) < 0.15 and one.count() == 1
    empty = spark.createDataFrame([("{}",)], "s string").select(sk.estimate(F.col("s"), 512)).first()[0]
    assert empty == 0


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", ""), ("", "x")], "a string, b string")
    assert df.select(row_hash([F.col("a"), F.col("b")])).distinct().count() == 4


def test_constraint_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (None, 2), (3, None)], "a int, b int")
    assert rows(ddl.key_violations(df, ["a", "b"])) == [(1, 2, 2)]
    target = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ddl.reference_violations(df, target, [("b", "a"), ("a", "b")]).count() == 2


def test_refreshes(spark, tables, tmp_path):
    e, sources = env(), str(tmp_path / "src")
    for n in ("visits", "clicks", "ads"):
        tables[n].write.parquet(f"{sources}/{n}.parquet")
    full, parts = (TableStore(spark, str(tmp_path / d), sources) for d in ("full", "parts"))
    assert build.full_refresh(e, full, END)[-1] == "fact_click_by_minute"
    with pytest.raises(build.UnalignedWindow):
        build.incremental_refresh(e, parts, END, t(30, 5))
    build.incremental_refresh(e, parts, t(31), datetime(1900, 1, 1))
    build.incremental_refresh(e, parts, END, t(31))
    for fact in ("fact_visit_by_minute", "fact_click_by_minute"):
        assert full.read(fact).agg(F.sum("n")).first() == parts.read(fact).agg(F.sum("n")).first()
    assert sorted(r["name"] for r in full.read("dim_city").collect()) == sorted(r["name"] for r in parts.read("dim_city").collect())
    build.full_refresh(e, full, END)
    assert full.read("dim_city").count() == 3
    merged = TableStore(spark, str(tmp_path / "merged"), sources)
    build.incremental_refresh(e, merged, t(30, 30), datetime(1900, 1, 1), merge=True)
    build.incremental_refresh(e, merged, END, t(30, 30), merge=True)
    assert merged.read("fact_visit_by_minute").agg(F.sum("n")).first()[0] == 5 and merged.read("fact_visit_by_minute").count() == 4


def test_a_repeated_window_changes_nothing(spark, tables, tmp_path):
    e, sources = env(), str(tmp_path / "src")
    for n in ("visits", "clicks", "ads"):
        tables[n].write.parquet(f"{sources}/{n}.parquet")
    store = TableStore(spark, str(tmp_path / "t"), sources)
    assert "fact_visit_by_minute" in build.incremental_refresh(e, store, t(30, 30), datetime(1900, 1, 1), merge=True)
    before = {n: store.table(n).latest() for n in derive.build_order(e)}
    assert build.incremental_refresh(e, store, t(30, 30), datetime(1900, 1, 1), merge=True) == []
    assert build.incremental_refresh(e, store, t(30), t(29)) == []
    assert before == {n: store.table(n).latest() for n in before}
    with pytest.raises(build.OverlappingWindow):
        build.incremental_refresh(e, store, t(31), t(30))
    # the cut bucket is put together, the files of other buckets stay as they are
    build.incremental_refresh(e, store, END, t(30, 30), merge=True)
    now = store.table("fact_visit_by_minute").latest()
    assert set(before["fact_visit_by_minute"].files) < set(now.files)
    full = TableStore(spark, str(tmp_path / "full"), sources)
    build.full_refresh(e, full, END)
    count = lambda s: s.read("fact_visit_by_minute").agg(F.sum("n"), F.count("n")).first()
    assert count(store) == count(full)
    assert build.incremental_refresh(e, full, t(40), t(30)) == []


def test_sql_text_loads_the_same(spark, tables):
    e, cut = env(suffix_template=""), t(31)
    spark.sql("create database if not exists sqltext")
    spark.sql("use sqltext")
    try:
        for n in ("visits", "clicks", "ads"):
            tables[n].write.mode("overwrite").saveAsTable(n)
        feeds = [(VISITS, "city"), (VISITS, "agent"), (CLICKS, "kind")]
        derived = {f"dim_{d}": next(x for x in derive.dimension_tables(e, f) if x.name == f"dim_{d}") for f, d in feeds}
        derived |= {x.name: x for x in (derive.fact_table(e, VISITS), derive.fact_table(e, CLICKS))}

        def run(mode, *args):
            for f, d in feeds:
                spark.sql(sqltext.dimension_sql(e, f, d, mode).rstrip(";\n"), args=list(args))
            for f in (VISITS, CLICKS):
                spark.sql(sqltext.fact_sql(e, f, mode).rstrip(";\n"), args=list(args))

        def fresh():
            for n, x in derived.items():
                spark.sql(f"drop table if exists {n}")
                spark.createDataFrame([], m.spark_schema(x)).write.saveAsTable(n)

        fresh()
        run(m.Mode.FULL, str(END))
        for n in ("dim_city", "dim_agent", "dim_kind"):
            assert rows(spark.table(n)) == rows(tables[n])
        for f in (VISITS, CLICKS):
            assert rows(spark.table(derive.fact_table_name(e.settings, f))) == rows(load_fact(e, f, tables.__getitem__, END))
        fresh()
        run(m.Mode.INCREMENTAL, str(cut), "1900-01-01 00:00:00")
        run(m.Mode.INCREMENTAL, str(END), str(cut))
        assert sorted(r["id"] for r in spark.table("dim_city").collect()) == [1, 2, 3]
        assert spark.table("fact_visit_by_minute").agg(F.sum("n")).first()[0] == 5
    finally:
        spark.sql("use default")
        spark.sql("drop database sqltext cascade")


def test_large_dimensions_are_numbered_in_ranges(spark, tables, tmp_path, monkeypatch):
    e, sources = env(), str(tmp_path / "src")
    tables["visits"].write.parquet(f"{sources}/visits.parquet")
    monkeypatch.setattr(build, "ONE_TASK", 1)
    got = build.full_dimension(e, TableStore(spark, str(tmp_path), sources), "dim_city", END)
    assert rows(got) == rows(tables["dim_city"]) and got.schema["id"].dataType == tables["dim_city"].schema["id"].dataType


def test_stream(spark, tables, tmp_path):
    e = make_env([VISIT, CLICK, AD], [VISITS], None, DEFAULTS)
    store = TableStore(spark, str(tmp_path / "t"))
    for d in ("dim_city", "dim_agent"):
        store.replace(d, tables[d])
    for i, part in enumerate(tables["visits"].randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(tables["visits"].schema).parquet(str(tmp_path / "in"))
        stream_fact(e, VISITS, store, stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(current(e, VISITS, store)) == rows(load_fact(e, VISITS, tables.__getitem__, END))


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 3), 1), (datetime(2024, 1, 4), 1)], "x timestamp_ntz, k int").select(F.col("x").cast("timestamp").alias("x"), "k")
    df.write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "x", m.TimeUnit.WEEK, ["k"], "1 day")
    q = counts.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("weeks").agg(F.sum("n_rows")).first()[0] == 2 and spark.table("weeks").count() == 2
